"""Main text of web pages by a linear-chain conditional random field.

A page is cut into its leaf blocks, each with features of its ancestor tags,
their classes and ids, and its text. A linear-chain CRF with the labels *main
text* and *furniture* is trained on labelled pages by maximising the penalised
conditional likelihood (forward-backward, full-batch Adam), and Viterbi decoding
labels the blocks of a page together. The labelled pages are invented ones
(``html_training``); others may be given. Training takes seconds, happens once a
driver process, and the few hundred weights go to the workers with the task.

Defined results: a null or empty page, and one without any main text, has the
empty text; markup that is not closed ends with the page; character references
are decoded once; repeated rows are each extracted; an empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from porelight.llm.common import map_batches
from porelight.llm.html_blocks import NAMES, leaf_blocks
from porelight.llm.html_training import labelled_pages

MARKS = "\ue000\ue001"  # private characters, put before the texts of furniture and of main text
Weights = tuple[np.ndarray, np.ndarray]  # of features (F, 2), of transitions (2, 2)


def examples(pages: list[tuple[str, list[tuple[str, int | None]]]]) -> list[tuple[list[list[int]], list[int]]]:
    """(features, labels) of the blocks of labelled pages; a block's label is that of its first labelled piece."""
    found = []
    for page, pieces in pages:
        marked = leaf_blocks("".join(p if label is None else _mark(p, label) for p, label in pieces))
        plain = leaf_blocks(page)
        assert len(marked) == len(plain)
        labels = [next((MARKS.index(c) for c in b.text if c in MARKS), 0) for b in marked]
        if plain:
            found.append(([b.features for b in plain], labels))
    return found


def _mark(piece: str, label: int) -> str:
    """Marks the texts of a piece, which may hold tags of its own."""
    out, inside = [], False
    for c in piece:
        if c == "<":
            inside = True
        elif not inside and not c.isspace() and (not out or out[-1] == ">"):
            out.append(MARKS[label])
        out.append(c)
        if c == ">":
            inside = False
    return "".join(out)


def train(data: list[tuple[list[list[int]], list[int]]], rounds: int = 100, rate: float = 0.2, ridge: float = 0.002) -> Weights:
    n, most, size = len(data), max(len(y) for _, y in data), len(NAMES)
    y, here = np.zeros((n, most), int), np.zeros((n, most), bool)
    for k, (_, labels) in enumerate(data):
        y[k, : len(labels)], here[k, : len(labels)] = labels, True
    x = np.zeros((int(here.sum()), size), np.float32)  # a row for each block, page by page
    for k, f in enumerate(f for features, _ in data for f in features):
        x[k, f] = 1
    gold = np.eye(2, dtype=np.float32)[y] * here[..., None]
    both = here[:, 1:] & here[:, :-1]
    gold_pairs = np.einsum("nta,ntb->ab", gold[:, :-1] * both[..., None], gold[:, 1:] * both[..., None])
    w, v = np.zeros((size, 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    for step in range(1, rounds + 1):
        emit = np.zeros((n, most, 2))
        emit[here] = x @ w.astype(np.float32)
        alpha, beta = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, most):
            a = np.logaddexp(alpha[:, t - 1, :1] + v[0], alpha[:, t - 1, 1:] + v[1]) + emit[:, t]
            alpha[:, t] = np.where(here[:, t, None], a, alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            nxt = emit[:, t + 1] + beta[:, t + 1]
            b = np.logaddexp(v[:, 0] + nxt[:, :1], v[:, 1] + nxt[:, 1:])
            beta[:, t] = np.where(both[:, t, None], b, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - z[:, None, None]) * here[..., None]
        pairs = np.exp(alpha[:, :-1, :, None] + v + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
        gradients = [(x.T @ (gold - p)[here].astype(np.float32)) / n - ridge * w, (gold_pairs - pairs.sum((0, 1))) / n - ridge * v]
        for k, (param, g) in enumerate(zip((w, v), gradients)):
            m, s = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            param += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w, v


def viterbi(features: list[list[int]], weights: Weights) -> list[int]:
    w, v = weights
    if not features:
        return []
    (v00, v01), (v10, v11) = v.tolist()
    back = []
    emit = [w[f].sum(0).tolist() for f in features]
    a, b = emit[0]
    for e0, e1 in emit[1:]:
        back.append((a + v00 < b + v10, a + v01 < b + v11))
        a, b = max(a + v00, b + v10) + e0, max(a + v01, b + v11) + e1
    label = int(b > a)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]


def main_text(page: str | None, weights: Weights) -> str:
    blocks = leaf_blocks(page or "")
    return " ".join(b.text for b, label in zip(blocks, viterbi([b.features for b in blocks], weights)) if label)


@lru_cache(1)
def fitted(n_pages: int = 400, seed: int = 7) -> Weights:
    return train(examples(labelled_pages(n_pages, seed)))


def extract(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``carry``, text, n_chars."""
    weights = fitted() if weights is None else weights
    held = list(dict.fromkeys([id_col, *carry]))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def make():
        def work(batch):
            texts = [main_text(p, weights) for p in batch.column(html_col).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(c) for c in held] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*held, "text", "n_chars"])

        return work

    return map_batches(pages.select(*dict.fromkeys([*held, html_col])), make, ", ".join(f"`{c}` {kinds[c]}" for c in held) + ", text string, n_chars long")
