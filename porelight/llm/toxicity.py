"""Toxicity: Levenshtein automata over a lexicon trie, and scores by context.

The lexicon is learned from labelled documents: words, and stems that many words
begin with, that are significantly more frequent in toxic documents (likelihood
ratio test). All entries make one trie. A word is matched by running the
Levenshtein automaton of the word against the trie, which is done here for all
entries at once: the states of the product (trie node, edits used) reached by a
prefix of the word make one state of a deterministic automaton, built as it is
needed and kept. Most words leave it after a few letters.

A match is looked at in its context, a window of words on both sides: quotation
marks around it and words of reporting separate quotation from abuse. The
weights of matches are added up, those of misspelled and quoted ones in part,
and a logistic regression on the sum gives the score. Words of clean labelled
documents that are near an entry are no misspellings.

The lexicon and the regression are fitted on at most ``max_labelled`` labelled
rows, those of the lowest hash; every document is scored in full. Only texts are
inputs of a score.

Defined results: a null or empty text has no match and gets the score of the
intercept; without labelled rows of both kinds nothing is learned and every
score is near 0; repeated rows are each scored; rows without an id are
scored and not held out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porelight.llm.common import filter_batches, map_batches

#: Signs that stand for letters in words written to evade a filter.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: Words that report what someone else said or wrote.
REPORTING = frozenset("said says say wrote writes write quote quoted quotes quoting called calls word words term terms insult insults slur sagte schrieb wort nannte dit écrit mot dijo escribió palabra llamó".split())
OPENING, CLOSING = "\"'“”„«»‘’‹›`", "\"'“”„«»‘’‹›`"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
WINDOW = 6
STEM = (4, 7)  # lengths of stems
#: Shares of its weight that a misspelled match and a match in quotation count with.
MISSPELLED, QUOTED = 0.7, 0.15


def words_of(text: str) -> list[str]:
    """Words in lower case without signs at their edges."""
    return [w for t in _TOKEN.findall(text.lower()) if (w := t if t.isalnum() else _EDGE.sub("", t))]


def edits_for(entry: str, stem: bool) -> int:
    """Misspellings forgiven: none in a stem or a short word, for too many clean words are near those."""
    return 0 if stem or len(entry) < 5 else 1 if len(entry) < 9 else 2


@dataclass
class Node:
    next: dict[str, "Node"] = field(default_factory=dict)
    word: float = 0.0  # weight of the word that ends here
    stem: float = 0.0  # weight of the stem that ends here
    limit: int = 0  # most edits that an entry below forgives
    own: int = 0  # edits that the word that ends here forgives
    entry: str = ""


class Matcher:
    """The product of the lexicon's trie and the Levenshtein automaton, made deterministic as words run through it."""

    MOST = 200_000  # states kept; beyond, the automaton is built anew

    def __init__(self, entries: list[tuple[str, bool, float]], strict: frozenset[str] = frozenset()):
        self.root, self.entries = Node(), entries
        for entry, stem, weight in entries:
            node, edits = self.root, 0 if entry in strict else edits_for(entry, stem)
            node.limit = max(node.limit, edits)
            for c in entry:
                node = node.next.setdefault(c, Node())
                node.limit = max(node.limit, edits)
            if stem:
                node.stem = max(node.stem, weight)
            else:
                node.word, node.own, node.entry = max(node.word, weight), edits, entry
        self.reset()

    def reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.items: list[list[tuple[Node, int]]] = []
        self.step: list[dict[str, int]] = []
        self.final: list[tuple[float, int, str]] = []
        self.stem: list[float] = []
        self.start = self._state([(self.root, 0)])

    def _state(self, items: list[tuple[Node, int]]) -> int:
        """Number of the state of these (node, edits) and all that missing letters lead to; -1 if there are none."""
        least: dict[int, tuple[Node, int]] = {}
        todo = list(items)
        while todo:
            node, e = todo.pop()
            if e > node.limit or id(node) in least and least[id(node)][1] <= e:
                continue
            least[id(node)] = (node, e)
            todo += [(n, e + 1) for n in node.next.values()]
        if not least:
            return -1
        key = frozenset((k, e) for k, (_, e) in least.items())
        if key not in self.states:
            ends = [(-e, n.word, n.entry) for n, e in least.values() if n.word and e <= n.own]
            self.states[key] = len(self.items)
            self.items.append(list(least.values()))
            self.step.append({})
            minus, weight, entry = max(ends, default=(0, 0.0, ""))
            self.final.append((weight, -minus, entry))
            self.stem.append(max((n.stem for n, e in least.values() if e == 0), default=0.0))
        return self.states[key]

    def match(self, word: str) -> tuple[float, int, str]:
        """(weight, edits, entry) of the nearest entry; weight 0 if there is none."""
        s, stem = self.start, 0.0
        for c in word:
            t = self.step[s].get(c)
            if t is None:
                after = []
                for node, e in self.items[s]:
                    if c in node.next:
                        after.append((node.next[c], e))
                    after.append((node, e + 1))  # a letter too many
                    after += [(n, e + 1) for k, n in node.next.items() if k != c]  # another letter
                t = self._state(after)
                self.step[s][c] = t
            if t < 0:
                return stem, 0, ""
            s = t
            stem = self.stem[s] or stem
        found = self.final[s]
        return found if found[0] and (found[1] == 0 or not stem) else (stem, 0, "")


@dataclass
class Model:
    """Lexicon entries (entry, is a stem, weight); those that forgive no misspelling; words that are near one and clean all the same; intercept and slope."""

    lexicon: list[tuple[str, bool, float]]
    strict: frozenset[str]
    clean_words: frozenset[str]
    coefficients: tuple[float, float]


class Scorer:
    MOST = 1_000_000  # tokens remembered; beyond, all are forgotten

    def __init__(self, model: Model):
        self.matcher, self.clean_words, self.coefficients = Matcher(model.lexicon, model.strict), model.clean_words, model.coefficients
        self.seen: dict[str, tuple[float, int, str]] = {}

    def look(self, token: str) -> tuple[float, int, str]:
        """Match of a token as it stands in the text, then with look-alike signs read as letters."""
        found = self.matcher.match(token)
        if not found[0] and not token.isalpha():
            word = _EDGE.sub("", token)
            found = self.matcher.match(word)
            if not found[0] and word and not word.isalpha():
                found = self.matcher.match(word.translate(LOOKALIKES))
                if not found[0] and (bare := re.sub(r"[\W\d_]+", "", word)) != word and 2 * len(bare) > len(word):
                    found = self.matcher.match(bare)
            if not found[0] and any(c in "$@!013457" for c in token[:1]):
                found = self.matcher.match(_EDGE.sub("", token.translate(LOOKALIKES)))
        return found

    def hits(self, text: str) -> list[tuple[str, float, int, str, bool]]:
        """(token, weight, edits, entry, quoted) of every match."""
        tokens = _TOKEN.findall(unicodedata.normalize("NFC", text).lower())
        seen, matched = self.seen, {}  # matches of this text are kept apart, for seen may be cleared on the way
        for token in set(tokens):
            found = seen.get(token)
            if found is None:
                if len(seen) > self.MOST or len(self.matcher.items) > Matcher.MOST:
                    seen.clear()
                    self.matcher.reset()
                found = self.look(token)
                if found[1] and _EDGE.sub("", token) in self.clean_words:
                    found = (0.0, 0, "")
                seen[token] = found
            if found[0]:
                matched[token] = found
        return [(t, *matched[t], self.quoted(tokens, k)) for k, t in enumerate(tokens) if t in matched] if matched else []

    @staticmethod
    def quoted(tokens: list[str], k: int) -> bool:
        """Is the match set in quotation marks that open and close within the window, with or without a word of reporting?"""
        if tokens[k][0] in OPENING and tokens[k].rstrip(".,;:!?")[-1:] in CLOSING:
            return True
        before, after = tokens[max(0, k - WINDOW) : k + 1], tokens[k : k + WINDOW + 1]
        opened = any(t[0] in OPENING and not (len(t) > 1 and t.rstrip(".,;:!?")[-1:] in CLOSING) for t in before)
        closed = any(t.rstrip(".,;:!?")[-1:] in CLOSING and t[0] not in OPENING for t in after)
        if opened and closed:
            return True
        return any(_EDGE.sub("", t) in REPORTING for t in tokens[max(0, k - 2) : k])

    def score(self, text: str) -> float:
        z = self.coefficients[0] + self.coefficients[1] * evidence(self.hits(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def evidence(hits: list[tuple[str, float, int, str, bool]]) -> float:
    return math.log1p(sum(w * (MISSPELLED if edits else 1.0) * (QUOTED if quoted else 1.0) for _, w, edits, _, quoted in hits))


def held_out(i: int | None, folds: int = 5) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % folds == 0


def terms_of(text: str) -> set[tuple[str, bool]]:
    """A document's words, and the stems they begin with."""
    own = {w for w in set(words_of(text)) if len(w) >= 3}
    return {(w, False) for w in own} | {(w[:k], True) for w in own for k in range(STEM[0], STEM[1] + 1) if len(w) > k}


def learn_lexicon(sample: DataFrame, n_toxic: int, n_clean: int, least: float = 20.0) -> list[tuple[str, bool, float]]:
    """(entry, is a stem, weight) of the terms whose likelihood ratio statistic is ``least`` or more and that are twenty times as frequent in toxic documents."""

    def make():
        def work(batch):
            toxic, clean = {}, {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts = toxic if label else clean
                for term in terms_of(unicodedata.normalize("NFC", text or "")):
                    counts[term] = counts.get(term, 0) + 1
            terms = list(toxic)  # those of no toxic document in the batch may matter elsewhere
            terms += [t for t in clean if t not in toxic]
            return pa.RecordBatch.from_arrays([pa.array([t[0] for t in terms], pa.string()), pa.array([t[1] for t in terms], pa.bool_()), pa.array([toxic.get(t, 0) for t in terms], pa.int64()), pa.array([clean.get(t, 0) for t in terms], pa.int64())], ["term", "stem", "t", "c"])

        return work

    counts = map_batches(sample, make, "term string, stem boolean, t long, c long").groupBy("term", "stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    n = n_toxic + n_clean
    t, c = F.col("t"), F.col("c")
    part = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    g = 2 * (part(t, (t + c) * n_toxic / n) + part(c, (t + c) * n_clean / n) + part(n_toxic - t, (n - t - c) * n_toxic / n) + part(n_clean - c, (n - t - c) * n_clean / n))
    weight = F.log((t + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))
    found = counts.where(t >= 3).select("term", "stem", "t", g.alias("g"), weight.alias("w")).where((F.col("g") >= least) & (F.col("w") >= math.log(20)))
    rows = sorted(tuple(r) for r in found.collect())  # few of the bounded sample's terms pass the test
    stems = {term: t for term, stem, t, _, _ in rows if stem}
    words = {term: t for term, stem, t, _, _ in rows if not stem}
    entries = []
    for term, stem, t, _, w in rows:
        shorter = [term[:k] for k in range(STEM[0], len(term)) if term[:k] in stems]
        if stem:
            # a stem counts if no shorter one covers it and no single word below it is nearly as frequent
            if not shorter and t > 1.5 * max([0, *(n for x, n in words.items() if x.startswith(term))]):
                entries.append((term, True, w))
        else:
            entries.append((term, False, w))
    kept = {e for e, stem, _ in entries if stem}
    return [(e, stem, w) for e, stem, w in entries if stem or not any(e.startswith(s) and e != s for s in kept)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> tuple[float, float]:
    """Intercept and slope by Newton's method; the slope is not negative, for no match speaks against toxicity."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.array([math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), 1.0])
    penalty, prior = np.array([1e-6, ridge * len(y)]), np.array([0.0, 2.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * (b - prior))
        b = b + np.clip(step, -1, 1)
        b[1] = max(b[1], 0)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = 20_000, folds: int = 5, crowd: int = 2) -> Model:
    """From labelled rows that are not held out."""
    spark = docs.sparkSession
    training = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("id").cast("string")) % folds != 0)
    rows = [tuple(r) for r in training.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_labelled).collect()]
    n_toxic = sum(t > 0 for _, t in rows)
    if not n_toxic or n_toxic == len(rows):
        return Model([], frozenset(), frozenset(), (-30.0, 0.0))
    chosen = F.broadcast(spark.createDataFrame(rows, "id long, toxic int"))  # at most max_labelled rows
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    lexicon = learn_lexicon(sample, n_toxic, len(rows) - n_toxic)

    def make():
        scorer = Scorer(Model(lexicon, frozenset(), frozenset(), (0.0, 0.0)))

        def work(batch):
            hits = [[{"token": _EDGE.sub("", t), "weight": w, "edits": e, "entry": x, "quoted": q} for t, w, e, x, q in scorer.hits(text or "")] for text in batch.column("text").to_pylist()]
            kind = pa.list_(pa.struct([("token", pa.string()), ("weight", pa.float64()), ("edits", pa.int32()), ("entry", pa.string()), ("quoted", pa.bool_())]))
            return pa.RecordBatch.from_arrays([pa.array(hits, kind), batch.column("toxic")], ["hits", "toxic"])

        return work

    rows = [([tuple(h) for h in r[0]], r[1]) for r in map_batches(sample, make, "hits array<struct<token string, weight double, edits int, entry string, quoted boolean>>, toxic int").collect()]
    near: dict[str, set[str]] = {}
    for hits, toxic in rows:
        for token, _, edits, entry, _ in hits:
            if edits and not toxic:
                near.setdefault(entry, set()).add(token)
    # where clean words crowd around an entry, a misspelling can't be told from them
    strict = frozenset(entry for entry, words in near.items() if len(words) > max(crowd, crowd * (len(rows) - n_toxic) // 3000))
    clean_words = frozenset(word for words in near.values() for word in words)
    keep = lambda h: not h[2] or h[3] not in strict and h[0] not in clean_words
    fitted = np.array(sorted((evidence([h for h in hits if keep(h)]), toxic) for hits, toxic in rows), float).reshape(-1, 2)
    if len(set(fitted[:, 1])) < 2:
        return Model([], frozenset(), frozenset(), (-30.0, 0.0))
    return Model(lexicon, strict, clean_words, fit_logistic(fitted[:, 0], fitted[:, 1]))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", most: float = 0.5) -> DataFrame:
    """The rows whose score is below ``most``, with all their columns."""

    def make():
        scorer = Scorer(model)
        return lambda batch: [scorer.score(t or "") < most for t in batch.column(text_col).to_pylist()]

    return filter_batches(docs, make)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), folds: int = 5) -> DataFrame:
    """Per row: id, ``carry``, held_out, score, predicted."""
    held = list(dict.fromkeys([id_col, *carry]))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def make():
        scorer = Scorer(model)

        def work(batch):
            scores = [scorer.score(t or "") for t in batch.column(text_col).to_pylist()]
            out = [held_out(i, folds) for i in batch.column(id_col).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(c) for c in held] + [pa.array(out, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], [*held, "held_out", "score", "predicted"])

        return work

    return map_batches(docs.select(*dict.fromkeys([*held, text_col])), make, ", ".join(f"`{c}` {kinds[c]}" for c in held) + ", held_out boolean, score double, predicted int")
