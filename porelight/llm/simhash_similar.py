"""SimHash near-duplicates by similarity: wide fingerprints, probed by the generalised pigeonhole, verified on texts.

Five-word similarity of 0.8 turns 15 % of a SimHash's bits on average, which is
beyond what partitions of 64 bits can probe. So the fingerprints here have 1024:

1. Every document becomes the set of the hashes of its distinct shingles;
   documents with one set are one node. A bit of the fingerprint is set if it is
   set in over half of the set's hashes, mixed anew for each 64 bits.
2. The bits are grouped into partitions so that correlated bits meet. A partition
   with threshold ``t`` is probed with all signatures that differ in up to ``t/2``
   bits on either side. Dynamic programming picks the partitions and their
   thresholds: the least estimated cost, of signature rows and of candidate pairs,
   at which a pair of the bound's similarity shares no bucket with a chance of at
   most ``miss``. Pairs of higher similarity are missed far more rarely. The
   statistics for this come from a bounded sample and decide the cost, not the
   decision on any pair.
3. In every bucket, pairs whose first 256 bits are near are linked by a spanning
   forest; in a large bucket, those near its centre by a star. Components
   of up to ``FEW`` links are sought by one task, those of more in rounds, before
   which links that other buckets repeat are thinned out. Each component of these links is verified on texts against its hub, the
   member with most links. Members that are not similar to the hub are compared, in
   pairs of slots, with all near members of their component that no verified link
   connects them to. Only links of similarity ``similar`` or more, computed on the
   whole sets of whole texts, decide who is grouped.

Defined results: words are as in ``simhash``; a text with fewer words than a
shingle is one shingle; null and blank texts have the empty set and are linked to
each other; repeated rows and rows without an id as in ``simhash``; an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porelight.llm.buckets import deal_around, thinned, tree_links
from porelight.llm.common import bounded, durable, give_back, stored, texts_of
from porelight.llm.components import FEW, components, few_components
from porelight.llm.simhash import ball, flips, label_rows, least_of_groups, row_key
from porelight.runtime import ship_package

WORDS = 16
BITS = 64 * WORDS
CHECK = 4  # words that are compared inside a bucket
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % (1 << 64) for k in range(WORDS)], np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingle_set(text: bytes | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n - shingle + 1))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` words of 64 bits."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):  # so that a byte holds the count of a piece
        mixed = _mixed(hashes[at : at + 255, None] + _ODD)
        counts += np.add.reduce(np.unpackbits(mixed.view(np.uint8).reshape(len(mixed), -1), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def bit_share(similar: float) -> float:
    """Share of bits in which two sets of that similarity and equal sizes differ on average."""
    return math.acos(2 * similar / (1 + similar)) / math.pi


def slices(df: DataFrame, work, schema: str, rows: int = 500) -> DataFrame:
    """``mapInArrow`` over few rows at a time, for sets take more memory than their texts; what was freed goes back to the system."""
    ship_package(df.sparkSession)

    def run(batches):
        pa.default_memory_pool().release_unused()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield work(batch.slice(at, rows))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def wide_fingerprints(keyed: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """(id, row, node, fp) per row of (id, text, row): ``node`` is a 128-bit hash of the whole set."""

    def work(batch):
        sets = [shingle_set(t, shingle, seed) for t in texts_of(batch, text_col)]
        node, fp = ([f(s) for s in sets] for f in (lambda s: xxhash.xxh128_digest(s.tobytes(), seed), lambda s: wide_fingerprint(s).tobytes()))
        return pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("row"), pa.array(node, pa.binary()), pa.array(fp, pa.binary())], ["id", "row", "node", "fp"])

    return slices(keyed, work, f"id {keyed.schema[id_col].dataType.simpleString()}, row long, node binary, fp binary")


def bits_of(fps: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, size: int) -> list[np.ndarray]:
    """Partitions of ``size`` bits or one more; each is grown by the free bit that correlates most with it."""
    m, x = BITS // size, (bits if len(bits) else np.zeros((1, BITS))).astype(np.float32)
    x -= x.mean(axis=0)
    x /= np.maximum(x.std(axis=0), 1e-6)
    tied = np.abs(x.T @ x) / max(len(bits), 1)
    np.fill_diagonal(tied, 0)
    free, groups = np.ones(BITS, bool), []
    for k in range(m):
        left = np.flatnonzero(free)
        group, score = [int(left[np.argmax(tied[np.ix_(left, left)].sum(axis=1))])], np.zeros(BITS)
        free[group[0]] = False
        while len(group) < BITS * (k + 1) // m - BITS * k // m:
            score += tied[group[-1]]
            group.append(int(np.argmax(np.where(free, score, -1))))
            free[group[-1]] = False
        groups.append(np.array(sorted(group)))
    return groups


def within(q: np.ndarray, t: int) -> float:
    """Chance that at most ``t`` of independent bits differ, given each one's chance."""
    apart = np.array([1.0])
    for p in q:
        apart = (np.append(apart * (1 - p), 0) + np.append(0, apart * p))[: t + 1]
    return float(apart.sum())


def allocate(n: int, share: np.ndarray, groups: list[np.ndarray], apart: float, miss: float, row_cost: float = 1.0, pair_cost: float = 0.01) -> tuple[float, list[int]]:
    """Least estimated cost and the thresholds (0 or 2; -1 leaves a partition out) with which pairs that differ in a share ``apart`` of bits are missed with a chance of ``miss`` at most."""
    unit = 0.01
    goal = math.ceil(-math.log(miss) / unit)
    best = np.full(goal + 1, np.inf)  # by what is gained so far of -log(miss), in units, rounded down
    best[0], chosen = 0.0, []
    for g in groups:
        step, picks = best.copy(), np.full(goal + 1, -1)
        came = np.arange(goal + 1)
        for t in (0, 2):
            gain = int(-math.log1p(-min(within(np.full(len(g), apart), t), 1 - 1e-9)) / unit)
            cost = row_cost * n * ball(len(g), t // 2) + pair_cost * n * n / 2 * within(2 * share[g] * (1 - share[g]), t)
            to = np.minimum(np.arange(goal + 1) + gain, goal)
            for a in np.flatnonzero(np.isfinite(best)):
                if best[a] + cost < step[to[a]]:
                    step[to[a]], picks[to[a]], came[to[a]] = best[a] + cost, t, a
        chosen.append((picks, came))
        best = step
    thresholds, at = [], goal
    for picks, came in reversed(chosen):
        thresholds.append(int(picks[at]))
        at = came[at]
    return float(best[goal]), thresholds[::-1]


def plan(n: int, bits: np.ndarray, similar: float, miss: float) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe, over several partition sizes; ``bits`` are those of a sample of the ``n`` fingerprints."""
    share = bits.mean(axis=0) if len(bits) else np.full(BITS, 0.5)
    found = [(allocate(n, share, groups, bit_share(similar), miss), groups) for size in (12, 14, 16, 20, 24, 28) for groups in [group_bits(bits, size)]]
    (_, thresholds), groups = min(found, key=lambda x: x[0][0])
    return [(g.tolist(), t) for g, t in zip(groups, thresholds) if t >= 0]


def signatures(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(key, node, c0, ...): a row per signature, with the words to compare."""

    def work(batch):
        fps = batch.column("fp").to_pylist()
        bits, keys = bits_of(fps), []
        for k, (group, t) in enumerate(parts):
            packed = np.zeros((len(fps), 8), np.uint8)
            own = np.packbits(bits[:, group], axis=1, bitorder="little")
            packed[:, : own.shape[1]] = own
            value = packed.view(np.uint64).ravel()
            keys += [_mixed((value ^ np.uint64(f)) + np.uint64((k + 1) << 40)) for f in flips(list(range(len(group))), t // 2)]
        keys = np.stack(keys, axis=1)
        words = np.frombuffer(b"".join(fps), np.int64).reshape(len(fps), -1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([batch.column("node"), lists, *(pa.array(words[:, c]) for c in range(CHECK))], ["node", "keys", *_checks()])

    one = slices(nodes.select("node", "fp"), work, "node binary, keys array<long>, " + ", ".join(f"{c} long" for c in _checks()))
    return one.select(F.explode("keys").alias("key"), "node", *_checks())


def _checks() -> list[str]:
    return [f"c{k}" for k in range(CHECK)]


def with_texts(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``members`` (..., id, row) with the text of that row; texts of no member are left where they are."""
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))
    wanted = bounded(durable(members.select(F.col("id").alias("wid"), "row").distinct()))
    some = keyed.join(wanted, (keyed["row"] == wanted["row"]) & keyed["id"].eqNullSafe(wanted["wid"]), "left_semi")
    own = members.withColumnsRenamed({"id": "mid", "row": "mrow"})
    return some.dropDuplicates(["id", "row"]).join(own, (F.col("row") == F.col("mrow")) & F.col("id").eqNullSafe(F.col("mid"))).drop("id", "row", "mid", "mrow")


def by_hub(rows: DataFrame, similar: float, shingle: int, seed: int) -> DataFrame:
    """(node, root, hub, ok) for (node, root, hub, n, text): whether each member but the hub is similar to it. Large components are salted, with the hub in each part."""
    parts = F.ceil(F.col("n") / 1024)
    members = rows.withColumn("salt", F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), parts))))
    dealt = members.withColumn("salt", F.explode("salt")).withColumn("member", F.col("node") != F.col("hub"))
    dealt = dealt.select("root", "salt", "member", "node", "hub", "text").repartition("root", "salt").sortWithinPartitions("root", "salt", "member")
    ship_package(rows.sparkSession)

    def run(batches):
        centre = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                member, texts, ok = part.column("member").to_pylist(), texts_of(part, "text"), []
                for is_member, text in zip(member, texts):
                    own = shingle_set(text, shingle, seed)
                    if not is_member:
                        centre = own
                    ok.append(is_member and similarity(own, centre) >= similar - 1e-9)
                out = [*(part.column(c) for c in ("node", "root", "hub")), pa.array(ok)]
                yield pa.RecordBatch.from_arrays(out, ["node", "root", "hub", "ok"]).filter(part.column("member"))

    return dealt.mapInArrow(run, "node binary, root binary, hub binary, ok boolean")


def in_slots(rows: DataFrame, similar: float, near: int, shingle: int, seed: int, slot: int = 128) -> DataFrame:
    """(a, b): verified links between members (root, node, cluster, n, fp, text) of one component that have different clusters."""
    slots = F.ceil(F.col("n") / slot)
    dealt = rows.withColumns({"slots": slots, "own": F.pmod(F.xxhash64("node"), slots)}).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    read = ["root", "lo", "hi", "own", "node", "cluster", "fp", "text"]
    dealt = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).select(*read).repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    ship_package(rows.sparkSession)

    def links(lo, hi, group):
        own, node, cluster, words, texts = zip(*group)
        own, words, made = np.array(own), np.frombuffer(b"".join(words), np.uint64).reshape(len(group), -1)[:, :CHECK], {}
        label = {c: c for c in cluster}

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        def made_of(i):
            if i not in made:
                made[i] = shingle_set(texts[i], shingle, seed)
            return made[i]

        for i in range(len(group) - 1):
            close = np.bitwise_count(words[i + 1 :] ^ words[i]).sum(axis=1, dtype=np.int64) <= near
            if lo != hi:
                close &= own[i + 1 :] != own[i]
            for j in (i + 1 + np.flatnonzero(close)).tolist():
                x, y = find(cluster[i]), find(cluster[j])
                if x != y and similarity(made_of(i), made_of(j)) >= similar - 1e-9:
                    label[x] = y
                    yield node[i], node[j]

    def run(batches):
        at, group = None, []

        def done():
            found = list(links(at[1], at[2], group))
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("root", "lo", "hi")))
            values = zip(*(batch.column(c).to_pylist() for c in ("own", "node", "cluster", "fp")), texts_of(batch, "text"))
            for key, value in zip(keys, values):
                if key != at:
                    if group:
                        yield from done()
                    at, group = key, []
                group.append(value)
        if group:
            yield from done()

    return dealt.mapInArrow(run, "a binary, b binary")


def many_components(met: DataFrame) -> DataFrame:
    """What ``few_components`` returns, by shuffles."""
    degrees = met.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    labels = durable(components(thinned(met)).join(degrees, "node"))
    hubs = labels.groupBy("root").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"), F.count("*").alias("n"))
    return labels.join(hubs, "root").select("node", "root", "hub", "n")


def links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, similar: float, shingle: int, seed: int, miss: float, sample: int, block: int, few: int = FEW) -> DataFrame:
    """(a, b): verified links between different nodes (node, fp, rep)."""
    n = nodes.count()
    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, math.ceil(n / sample)))) == 0).select("fp").limit(2 * sample).collect()
    parts = plan(n, bits_of([r.fp for r in some]) if some else np.zeros((0, BITS), np.uint8), similar, miss)
    share = bit_share(similar)
    near = round(64 * CHECK * share + 3 * math.sqrt(64 * CHECK * share * (1 - share)))
    dealt, stars = deal_around(signatures(nodes, parts), block, "node", _checks(), near)
    trees = tree_links(dealt, "node", _checks(), near)
    met = durable((trees if stars is None else trees.union(stars)).where("a != b").distinct())
    if not met.head(1):
        return met
    give_back(docs.sparkSession)
    members = durable(few_components(met) if met.count() <= few else many_components(met))
    reps = nodes.select("node", "rep.id", "rep.row", "fp")
    said = durable(by_hub(with_texts(docs, members.join(reps.select("node", "id", "row"), "node"), id_col, text_col), similar, shingle, seed))
    edges = said.where("ok").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    open_ = durable(said.where("NOT ok").select("root").distinct())
    if not open_.head(1):
        return edges
    rest = members.join(bounded(open_), "root", "left_semi").join(said.select("node", "ok"), "node", "left")
    rest = rest.withColumn("cluster", F.when(F.coalesce("ok", F.lit(True)), F.col("hub")).otherwise(F.col("node"))).drop("ok", "hub")
    return edges.union(durable(in_slots(with_texts(docs, rest.join(reps, "node"), id_col, text_col), similar, near, shingle, seed)))


def similar_groups(docs: DataFrame, id_col: str, text_col: str, similar: float, shingle: int, seed: int, miss: float, sample: int, block: int) -> DataFrame:
    """(id, row, component) per row of ``docs``."""
    give_back(docs.sparkSession)
    keyed = docs.select(F.col(id_col), F.col(text_col), row_key(id_col, text_col).alias("row"))
    rows = stored(wide_fingerprints(keyed, id_col, text_col, shingle, seed))
    nodes = stored(rows.groupBy("node").agg(F.min("id").alias("first"), F.min(F.struct("row", "id")).alias("rep"), F.first("fp").alias("fp")))
    edges = durable(links(docs, nodes, id_col, text_col, similar, shingle, seed, miss, sample, block))
    give_back(docs.sparkSession)
    return label_rows(rows.select("id", "row", F.col("node").alias("fp")), nodes.select(F.col("node").alias("fp"), "first"), edges, FEW)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = 0.8, shingle: int = 5, seed: int = 42, miss: float = 0.005, sample: int = 1 << 13, block: int = 1 << 10) -> DataFrame:
    """One row per row of ``docs``: id and component_id, the least id of its group."""
    grouped = similar_groups(docs, id_col, text_col, similar, shingle, seed, miss, sample, block)
    return grouped.select(F.col("id").alias(id_col), F.col("component").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = 0.8, shingle: int = 5, seed: int = 42, miss: float = 0.005, sample: int = 1 << 13, block: int = 1 << 10) -> DataFrame:
    """The rows of ``docs`` that are the least id of their group, with all their columns; repeated ids as in ``simhash``."""
    return least_of_groups(docs, id_col, text_col, similar_groups(docs, id_col, text_col, similar, shingle, seed, miss, sample, block))
