"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are estimated: a trusted target from
labelled good documents, and the raw corpus from every document. A document's
score is its log-likelihood ratio over the number of its n-grams, and a fixed
threshold on the score decides, so the same document gets the same verdict
wherever it is met. The target is fitted on a bounded sample of labelled rows
(``max_trusted``); the raw corpus counts cover all documents.

Defined results: a null text has no words; a document shorter than one n-gram
scores 0; without any trusted row every score is 0, which the threshold keeps;
repeated rows are counted and returned as often as they occur; an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porelight.llm.common import filter_batches, map_batches, texts_of

N_GRAM, BUCKETS = 4, 1 << 15
#: Least log-likelihood ratio per n-gram that is kept.
THRESHOLD = -0.4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True


def buckets_of(text: bytes) -> np.ndarray:
    """The hashed n-grams of a text's bytes, one for each position."""
    if len(text) < N_GRAM:
        return np.zeros(0, np.uint32)
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    key = b[: len(b) - 3] | b[1 : len(b) - 2] << 8 | b[2 : len(b) - 1] << 16 | b[3:] << 24
    return (key * np.uint32(2654435761)) >> np.uint32(17)


def n_repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]  # renumbered, so that no product overflows
    _, which, times = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    b, words = np.frombuffer(text, np.uint8), text.split()
    chars = int(((b & 0xC0) != 0x80).sum()) - int(_BLANK[b].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, int(_SYMBOL[b].sum()), len(lines) - len(set(lines)), n_repeat_words(words)


def ngram_counts(docs: DataFrame, trusted: list[int], id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every bucket over the trusted and over all documents. What reaches the driver is two numbers a bucket."""

    def make():
        ids = set(trusted)

        def work(batch):
            raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
            for i, text in zip(batch.column(id_col).to_pylist(), texts_of(batch, text_col)):
                if text:
                    c = np.bincount(buckets_of(text), minlength=BUCKETS)
                    raw += c
                    if i in ids:
                        good += c
            at = np.flatnonzero(raw)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

        return work

    counts = map_batches(docs.select(id_col, text_col), make, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good")).toPandas().to_numpy()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    if len(counts):
        at = counts[:, 0].astype(int)
        raw[at], good[at] = counts[:, 1], counts[:, 2]
    return good, raw


def log_ratio(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of every bucket; all 0 without a target. Half a count is added to each."""
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + 0.5) / (good.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_trusted: int = 20_000) -> np.ndarray:
    """The weight of every bucket. At most ``max_trusted`` labelled rows, those of the lowest hash, make the target."""
    trusted = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(max_trusted)
    return log_ratio(*ngram_counts(docs, [r[0] for r in trusted.collect()], id_col, text_col))


def verdict(text: bytes, weights: np.ndarray, threshold: float) -> tuple:
    """The base counts, base_failed, llr, kept."""
    counts, at = base_counts(text), buckets_of(text)
    llr = float(weights[at].sum(dtype=np.float64) / len(at)) if len(at) else 0.0
    failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
    return (*counts, failed, llr, not failed and llr >= threshold)


def keep_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are kept, with all their columns."""
    weights = weights.astype(np.float32)
    return filter_batches(docs, lambda: lambda batch: [verdict(t or b"", weights, threshold)[-1] for t in texts_of(batch, text_col)])


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: id, ``carry``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept."""
    held = [id_col, *carry]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in held) + ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"
    weights = weights.astype(np.float32)

    def make():
        def work(batch):
            out = []
            for text in texts_of(batch, text_col):
                text = text or b""
                out.append(verdict(text, weights, threshold))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
            return pa.RecordBatch.from_arrays([batch.column(c) for c in held] + [pa.array(x, k) for x, k in zip(zip(*out), kinds)], held + names)

        return work

    return map_batches(docs.select(*dict.fromkeys([*held, text_col])), make, schema)
