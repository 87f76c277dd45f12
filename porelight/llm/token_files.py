"""Token-id output: documents encoded, put in order of id, and written as range-coded blocks.

The files are a table in the shared folder, one part per range of ids, whose
rows are blocks: ``part``, ``block`` (from 0), ``n`` ids, ``data`` (see ``range_coder``)
and ``index``, the documents that begin in the block as triples (has id, id,
number of ids) of little-endian 64-bit integers. A part's ids are one stream cut
into blocks of ``block_ids``, so a document may go on in the next block.

Words are encoded by the model of the tokenizers library. It splits a text into words and
encodes each on its own, so what it gives for a word is kept and used again;
texts with characters outside of ``PLAIN``, or with the string of a special token,
are given to it whole. Such a string becomes the special token, as the library has
it without ``add_special_tokens``, which concerns only what is put around a text.

Defined results: a null text is empty and has the end id alone; rows of one id
are in no particular order among themselves; rows without an id come first; an
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porelight.llm import block_coder
from porelight.llm.common import map_batches, shared_folder, texts_of
from porelight.runtime import ship_package

#: Texts of these characters alone are split here as the tokenizer's own normalizer and pattern split them.
PLAIN = "\t\n\x0b\x0c\r -~¡-įı-ſ"
#: The letters and digits among them in lower case.
_LETTER, _DIGIT = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
#: The fixed pattern of this tokenizer's pre-tokenizer, for such texts.
#: Here it finds what is not a word of letters, so that blanks put around its matches leave the pattern's words between blanks.
APART = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_DIGIT}]|[^\x09-\x0d {_LETTER}{_DIGIT}]+"


class WordEncoder:
    """Texts to ids as little-endian 16 or 32-bit integers, ended by ``end_id``."""

    MOST = 400_000  # words kept between batches
    ROWS, ROOM = 10_000, 32 << 20  # texts taken at a time, and their bytes
    #: The characters that bytes have in the library's byte-level form, but for the blank that is between words here.
    CHARACTERS = np.arange(256, dtype="<u4")
    CHARACTERS[[*range(32), *range(127, 161), 173]] = [*range(256, 288), *range(289, 324)]

    def __init__(self, tokenizer_path: str, end_id: int, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        special = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]  # the library finds these strings in texts before it splits them
        self.odd = "|".join([f"[^{PLAIN}]", *(f"(?i:{re.escape(t)})" for t in special)])  # what texts hold that are given to it whole
        self.kind, self.end = kind, np.array([end_id], kind).tobytes()
        self.model = self.tokenizer.model  # for words, which have been normalized and split here
        # the words kept, with the ids of each and in how many batches it was found again
        self.kept, self.ids, self.used = pa.array([], pa.string()), pa.array([], pa.binary()), np.zeros(0, np.int32)

    @property
    def words(self) -> list[str]:
        return self.kept.to_pylist()

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """A binary array with the ids of each text and the end id."""
        rows = min(self.ROWS, max(1, -(-len(texts) // 2)) if texts.nbytes > self.ROOM else self.ROWS)
        if len(texts) > rows:
            return pa.concat_arrays([self.encode_all(texts.slice(at, rows)) for at in range(0, len(texts), rows)])
        odd = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, self.odd), False).to_numpy(zero_copy_only=False)).tolist()
        if not odd:
            return self._plain(pc.fill_null(texts, ""))
        there = np.ones(len(texts), bool)
        there[odd] = False
        plain = self._plain(pc.fill_null(pc.if_else(pa.array(there), texts, ""), "")).to_pylist()
        for k in odd:
            plain[k] = self._whole(texts[k].as_py()) + self.end
        return pa.array(plain, pa.binary())

    def _plain(self, texts: pa.Array) -> pa.Array:
        """Arrow splits the texts into words, numbers these and puts the ids of each in its places; only new ones become Python objects."""
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), APART, r" \0 "))
        coded, behind = split.values.dictionary_encode(), split.offsets.to_numpy()[1:].astype(np.int64) - split.offsets[0].as_py()
        del split  # as large as the texts
        known = pa.concat_arrays([self._words(coded.dictionary), pa.array([self.end], pa.binary())])
        codes = np.insert(coded.indices.to_numpy(), behind, len(known) - 1)  # the end id behind each text
        stream = known.take(pa.array(codes))
        ends = np.frombuffer(stream.buffers()[1], np.int32, len(stream) + 1, 4 * stream.offset)
        bounds = np.append(ends[:1], ends[behind + np.arange(1, len(texts) + 1)])
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds), stream.buffers()[2]])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _words(self, wanted: pa.Array) -> pa.Array:
        """The ids of each of these distinct words."""
        if len(self.kept) > self.MOST:  # the half that was found again most often stays
            stay = np.sort(np.argsort(-self.used, kind="stable")[: self.MOST // 2])
            self.kept, self.ids, self.used = self.kept.take(pa.array(stay)), self.ids.take(pa.array(stay)), self.used[stay] >> 1
        places = pc.fill_null(pc.index_in(wanted, value_set=self.kept), -1).to_numpy().astype(np.int64)
        fresh = np.flatnonzero(places < 0)
        self.used[places[places >= 0]] += 1
        if len(fresh):
            places[fresh] = len(self.kept) + np.arange(len(fresh))
            missing = wanted.take(pa.array(fresh))
            self.kept = pa.concat_arrays([self.kept, missing])
            self.ids = pa.concat_arrays([self.ids, *(self._new(missing.slice(k, 10_000)) for k in range(0, len(missing), 10_000))])
            self.used = np.append(self.used, np.zeros(len(fresh), np.int32))
        return self.ids.take(pa.array(places))

    def _new(self, own: pa.Array) -> pa.Array:
        """The ids of words, by the library's model alone: what it does around that costs more than the model."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), " ")[0].as_buffer()  # one object, then cut: as_py a word costs more
        ids, ends, tokenize = [], [0], self.model.tokenize
        for word in self.CHARACTERS[np.frombuffer(joined, np.uint8)].tobytes().decode("utf-32-le").split(" "):
            ids += [token.id for token in tokenize(word)]
            ends.append(len(ids))
        data = np.array(ids, self.kind)
        return pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.array(ends) * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


#: Columns of the files.
TABLE = "part int, block long, n int, data binary, index binary"

_encoders: dict[tuple, WordEncoder] = {}


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, kind: str, bounds: list[int], id_col: str, text_col: str) -> DataFrame:
    """(part, id, ids) per row. ``bounds`` part the ids; where an id is several bounds at once, its rows are dealt out among their parts."""
    cuts = np.array(bounds, np.int64)

    def make():
        key = (tokenizer_path, end_id, kind)
        if key not in _encoders:
            _encoders[key] = WordEncoder(*key)
        encoder = _encoders[key]

        def work(batch):
            ids = batch.column("id")
            number = np.array([-(1 << 63) if i is None else i for i in ids.to_pylist()], np.int64)
            low, high = np.searchsorted(cuts, number, "left"), np.searchsorted(cuts, number, "right")
            texts = batch.column("text")
            out = encoder.encode_all(texts.cast(pa.string()) if texts.type != pa.string() else texts)
            part = low
            if (high > low).any():
                deal = np.array([zlib.crc32(x) for x in out.to_pylist()], np.int64)
                part = low + deal % (high - low + 1)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), ids, out], ["part", "id", "ids"])

        return work

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), make, "part int, id long, ids binary")


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_bits: int = 16, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 24 << 20, max_parts: int = 20_000, block_ids: int = 2048, lanes: int = 3072) -> None:
    """Writes the files; ``lanes`` blocks are handed on to the coder at a time.

    A part holds about ``part_bytes`` of text, and more where there would be over
    ``max_parts`` of them: the bounds between parts and a row a part are what the
    driver holds. A task streams its part, so its memory does not grow with it.
    """
    total, n = docs.select(F.sum(F.octet_length(text_col)), F.count("*")).first()
    parts = min(max_parts, max(1, -(-(total or 0) // part_bytes)))
    bounds = []
    if parts > 1:
        shares = [k / parts for k in range(1, parts)]
        bounds = docs.select(F.percentile_approx(F.col(id_col).cast("long"), F.array(*map(F.lit, shares)), F.lit(10 * parts)).alias("b")).first()[0] or []
    kind = "<u2" if id_bits <= 16 else "<u4"
    rows = encoded(docs, tokenizer_path, end_id, kind, bounds, id_col, text_col)
    ship_package(docs.sparkSession)

    def blocks(batches):
        _encoders.clear()  # a worker that has encoded words does no more of that
        part, number, stream, held, index = None, 0, [], 0, []
        waiting: list[tuple[np.ndarray, bytes]] = []

        def out():
            nonlocal number
            n = len(waiting)
            made = pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(number, number + n), pa.int64()), pa.array([len(ids) for ids, _ in waiting], pa.int32()), pa.array([ids.tobytes() for ids, _ in waiting], pa.binary()), pa.array([x for _, x in waiting], pa.binary())], ["part", "block", "n", "data", "index"])
            number += n
            waiting.clear()
            return made

        def cut(last):
            """Blocks of what is held; a document is listed in the block in which it begins."""
            nonlocal stream, held, index
            ids = np.frombuffer(b"".join(stream), kind)
            at, known = 0, np.array(index, "<i8").reshape(-1, 4)
            while len(ids) - at >= block_ids or last and len(ids) > at:
                piece = ids[at : at + block_ids]
                lo, hi = np.searchsorted(known[:, 0], [at, at + block_ids])
                waiting.append((piece, known[lo:hi, 1:].tobytes()))
                at += len(piece)
            index = [(x[0] - at, *x[1:]) for x in index if x[0] >= at]
            stream, held = ([ids[at:].tobytes()], len(ids) - at) if at < len(ids) else ([], 0)

        size = np.dtype(kind).itemsize
        for batch in batches:
            for p, i, data in zip(batch.column("part").to_pylist(), batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                if p != part:
                    if part is not None:
                        cut(True)
                        if waiting:
                            yield out()
                    part, number = p, 0
                n = len(data) // size
                index.append((held, int(i is not None), i or 0, n))
                stream.append(data)
                held += n
                if held >= 64 * block_ids:
                    cut(False)
                    if len(waiting) >= lanes:
                        yield out()
        if part is not None:
            cut(True)
            if waiting:
                yield out()

    ordered = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "id")
    ordered.mapInArrow(blocks, TABLE).withColumn("data", block_coder.encoded(docs.sparkSession, "data", id_bits)).write.parquet(path)


def read_tokens(spark, path: str, id_bits: int = 16, lanes: int = 3072) -> DataFrame:
    """(part, id, before, ids): every document from the files, with the number of ids before it in its part."""
    return _read(spark, path, id_bits, lanes, "part int, id long, before long, ids array<int>", lambda ids: ids.astype(np.int32).tolist(), pa.list_(pa.int32()))


def _read(spark, path, id_bits, lanes, schema, digest, kind) -> DataFrame:
    ship_package(spark)
    ids_kind = "<u2" if id_bits <= 16 else "<u4"

    def run(batches):
        part, number, index, held, before = None, 0, [], [], 0
        rows: list[tuple] = []

        def documents():
            nonlocal held, before
            if not index:
                return
            ids, at = np.concatenate(held) if held else np.zeros(0, "<u4"), 0
            while index and at + index[0][2] <= len(ids):
                known, i, n = index.pop(0)
                rows.append((part, i if known else None, before, digest(ids[at : at + n])))
                at += n
                before += n
            held = [ids[at:]] if at < len(ids) else []

        for batch in batches:
            parts, numbers, datas, indexes = (batch.column(c).to_pylist() for c in ("part", "block", "data", "index"))
            for lo in range(0, len(parts), lanes):
                for p, b, ids, x in zip(parts[lo : lo + lanes], numbers[lo : lo + lanes], (np.frombuffer(data, ids_kind) for data in datas[lo : lo + lanes]), indexes[lo : lo + lanes]):
                    if p != part:
                        if index or held:
                            raise ValueError(f"part {part} ends too early")
                        part, number, before = p, 0, 0
                    if b != number:
                        raise ValueError(f"part {p} has block {b} where {number} is due")
                    number += 1
                    index += np.frombuffer(x, "<i8").reshape(-1, 3).tolist()
                    held.append(ids)
                    if len(held) >= 64:
                        documents()
                documents()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], kind)], ["part", "id", "before", "ids"])
                rows.clear()
        if index or held:
            raise ValueError(f"part {part} ends too early")

    # a part's blocks come in order, wherever the reader has split its file
    table = spark.read.schema(TABLE).parquet(path).drop("n")
    parts = table.agg(F.max("part")).first()[0]
    if parts is None:
        return spark.createDataFrame([], schema)
    ordered = table.repartitionById(parts + 1, F.col("part")).sortWithinPartitions("part", "block")
    return ordered.withColumn("data", block_coder.decoded(spark, "data", id_bits)).mapInArrow(run, schema)


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_bits: int = 16, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Writes the files and reads them back: id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path, end_id, id_bits, id_col, text_col, **options)
    digest = lambda ids: {"n": len(ids), "crc": zlib.crc32(ids.astype("<u4").tobytes())}
    kind = pa.struct([("n", pa.int64()), ("crc", pa.int64())])
    read = _read(spark, path, id_bits, 3072, "part int, id long, before long, ids struct<n: long, crc: long>", digest, kind)
    sizes = sorted(tuple(r) for r in spark.read.schema(TABLE).parquet(path).groupBy("part").agg(F.sum("n")).collect())  # a row a part
    starts = list(accumulate((n for _, n in sizes), initial=0))
    table = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part int, first long")
    return read.join(F.broadcast(table), "part").select(F.col("id").alias(id_col), (F.col("first") + F.col("before")).alias("start"), F.col("ids.n").alias("n_tokens"), F.col("ids.crc").alias("ids_crc32"))
