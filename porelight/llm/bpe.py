"""Byte-level BPE as a monoid tree reduction.

A text is cut into halves, recursively, down to leaves that are encoded on
their own. Two neighbours are joined by encoding again only a window around
their border, which grows until both its ends have provably settled:

* Left end. Where a pre-token ends depends on at most ``LOOK`` characters from
  its end on (contractions look three characters ahead, the white space rule
  one). A left pre-token that ends ``LOOK`` characters before the border or
  earlier is therefore one of the joined text, and the window starts there. The
  left side is split again from the start or from an ``ANCHOR``, a place where
  the pattern always splits.
* Right end. Splitting runs left to right and never looks back. From the first
  place where the window's split and the right side's own split both end a
  pre-token, all that follows is the same, so the window stops there.

Merges never cross a pre-token, so ids outside the window stand. If the two
splits never meet, the window reaches the end of the right side. An element of
the monoid is a list of runs ``(from, to, ids)`` whose borders are ends of
pre-tokens; the empty list is its identity. Decoding joins the bytes of two
halves up the same kind of tree.

Defined results: a null text is taken as empty; an empty text has no ids and the
digests of an empty string; repeated rows are each encoded; an empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from porelight.llm.common import map_batches

#: Characters from a pre-token's end on that can matter for where it ends.
LOOK = 3
#: No pre-token holds a letter and then a space, so one ends behind this match.
ANCHOR = r"\p{L}(?= )"

Run = tuple[int, int, list[int]]


class Codec:
    """Encodes as the tiktoken library does with the same ranks and pattern, without special tokens."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = 512, window: int = 64):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.anchor = regex.compile(ANCHOR)
        self.leaf, self.window = leaf, window

    def encode(self, text: str) -> list[int]:
        runs = self.tree(text, 0, len(text))
        return runs[0][2] if len(runs) == 1 else [i for run in runs for i in run[2]]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def tree(self, text: str, lo: int, hi: int) -> list[Run]:
        """``text[lo:hi]`` encoded on its own."""
        if hi - lo <= self.leaf:
            return self.run(text, lo, hi)
        mid = (lo + hi) // 2
        return self.join(text, self.tree(text, lo, mid), mid, self.tree(text, mid, hi))

    def run(self, text: str, lo: int, hi: int) -> list[Run]:
        return [(lo, hi, self.bpe.encode_ordinary(text[lo:hi]))] if hi > lo else []

    def ends(self, text: str, lo: int, hi: int) -> list[int]:
        return [lo, *(m.end() for m in self.split.finditer(text, lo, hi))]

    def join(self, text: str, left: list[Run], mid: int, right: list[Run]) -> list[Run]:
        lo, hi, size = left[0][0], right[-1][1], self.window
        while True:
            sure = lo if mid - size <= lo else next((m.end() for m in self.anchor.finditer(text, mid - size, mid)), None)
            settled = [e for e in self.ends(text, sure, mid) if e + LOOK <= mid] if sure is not None else []
            if settled or sure == lo:
                start = settled[-1] if settled else lo
                break
            size *= 2
        size = self.window
        while True:
            last = min(hi, mid + size)
            own, window = set(self.ends(text, mid, last)), self.ends(text, start, last)
            met = [k for k, e in enumerate(window) if e in own and (e + LOOK <= last or last == hi)]
            if met:
                window = window[: met[0] + 1]
                break
            size *= 2
        # pre-token by pre-token, for the window cut out of the text could split differently at its end
        ids = [i for a, b in zip(window, window[1:]) for i in self.bpe._encode_single_piece(text[a:b])]
        return self.cut(text, left, start)[0] + [(start, window[-1], ids)] * (window[-1] > start) + self.cut(text, right, window[-1])[1]

    def cut(self, text: str, runs: list[Run], at: int) -> tuple[list[Run], list[Run]]:
        """Both sides of ``at``, an end of a pre-token."""
        before, after = [r for r in runs if r[1] <= at], [r for r in runs if r[0] >= at]
        for lo, hi, ids in runs:
            if lo < at < hi:
                if at - lo < hi - at:
                    left, k = len(text[lo:at].encode()), 0
                    while left > 0:
                        left -= len(self.bytes_of[ids[k]])
                        k += 1
                else:
                    left, k = len(text[at:hi].encode()), len(ids)
                    while left > 0:
                        k -= 1
                        left -= len(self.bytes_of[ids[k]])
                before.append((lo, at, ids[:k]))
                after.insert(0, (at, hi, ids[k:]))
        return before, after


_codecs: dict[tuple, Codec] = {}


def codec(ranks_path: str, pattern: str, leaf: int = 512) -> Codec:
    """One codec a process, for the tables take a while to read."""
    key = (ranks_path, pattern, leaf)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 512) -> DataFrame:
    """Per row: id and ``ids array<int>``."""

    def make():
        own = codec(ranks_path, pattern, leaf)

        def work(batch):
            ids = [own.encode(t or "") for t in batch.column(text_col).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

        return work

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", leaf: int = 512) -> DataFrame:
    """Per row of ``encode_documents``: id and ``bytes binary``."""

    def make():
        own = codec(ranks_path, pattern, leaf)

        def work(batch):
            out = [own.decode(x or []) for x in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.binary())], [id_col, "bytes"])

        return work

    return map_batches(encoded.select(id_col, "ids"), make, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = 512) -> DataFrame:
    """Per row, in one pass that ships no ids: id, n_tokens, ids_sha256, decoded_sha256 of what ``decode`` makes of the ids."""

    def make():
        own = codec(ranks_path, pattern, leaf)

        def work(batch):
            n, a, b = [], [], []
            for text in batch.column(text_col).to_pylist():
                ids = own.encode(text or "")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(own.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
