"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Every document gets a 64-bit fingerprint; documents with one fingerprint are
   one node from there on, however many they are.
2. The 64 bits are grouped into partitions so that correlated bits meet. With
   ``m`` partitions and thresholds that sum to ``distance - m + 1``, two
   fingerprints within ``distance`` differ in at most the threshold's number of
   bits in at least one partition. Candidate counts are estimated for every
   partition and threshold from bit statistics of all fingerprints; dynamic
   programming allocates the thresholds, and the cheapest ``m`` is taken. The
   choice moves to fewer and longer partitions as the input grows.
3. A partition with threshold ``t`` is probed with the signatures that differ in
   up to ``t/2`` bits on either side. Equal signatures meet in a bucket, where
   every pair is verified in full, but only a spanning forest of each bucket's
   links is emitted. Buckets of over ``block`` rows are split, see ``buckets``.
4. A bucket with more than ``hot`` rows is not compared pairwise at all. Its
   members are linked through the bit patterns at half the distance from them:
   two fingerprints are within ``distance`` exactly if they share one, so this
   finds every link in rows that are proportional to the members. A comparison
   takes two nanoseconds and a member 4162 such rows, so only buckets of very
   many rows are cheaper this way.
5. Connected components give the least document of each group.

Defined results: a null or blank text has fingerprint 0 and is linked like any
other; a text with fewer words than a shingle is one shingle; a bit set in
exactly half the shingles is 0; repeated rows stay and are linked to each other;
rows without an id stay, and a group without any id has a null component; an
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porelight.llm.buckets import deal, tree_links
from porelight.llm.common import bounded, durable, fresh, map_batches, texts_of
from porelight.llm.components import components

BITS = 64
_SALT = [0x9E3779B97F4A7C15 * (k + 1) % (1 << 64) for k in range(BITS)]


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n - shingle + 1)
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # in pieces, so that a very long text takes no more memory than its hashes
        set_in += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, carry: str | None = None) -> DataFrame:
    """(id, fp) per row, and a column of longs to carry; ``fp`` holds the 64 bits as a signed long."""
    more = [carry] * bool(carry)

    def make():
        def work(batch):
            fps = np.array([fingerprint(t, shingle, seed) for t in texts_of(batch, text_col)], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(fps.view(np.int64)), *map(batch.column, more)], ["id", "fp", *more])

        return work

    return map_batches(docs.select(id_col, text_col, *more), make, f"id {docs.schema[id_col].dataType.simpleString()}, fp long" + f", {carry} long" * bool(carry))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set. 4096 sums reach the driver."""

    def make():
        def work(batch):
            bits = np.unpackbits(np.array(batch.column("fp").to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both = (bits.T @ bits).astype(np.int64)
            i, j = np.divmod(np.arange(BITS * BITS), BITS)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.append(i, -1), np.append(j, -1), np.append(both.ravel(), len(bits)))], ["i", "j", "n"])

        return work

    sums, n = np.zeros((BITS, BITS)), 0
    for i, j, k in map_batches(fps.select("fp"), make, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        if i < 0:
            n = k
        else:
            sums[i, j] = k
    return n, sums


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Partitions of nearly equal size; each is grown by the free bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tied = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tied, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = (BITS * (k + 1)) // m - (BITS * k) // m
        group = [max(sorted(free), key=lambda b: tied[b, sorted(free)].sum())]
        free -= set(group)
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: tied[b, group].sum()))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def allocate(n: int, both: np.ndarray, groups: list[list[int]], budget: int, row_cost: float = 1.0, pair_cost: float = 0.01) -> tuple[float, list[int]]:
    """Least estimated cost and the thresholds, which sum to ``budget``; -1 leaves a partition out.

    The cost of a threshold is that of the signature rows to shuffle and of the
    candidate pairs to verify: the pairs of all fingerprints times the chance
    that two differ in that many bits of the partition or fewer.
    """
    p = np.diag(both) / max(n, 1)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        apart = np.array([1.0])  # chances of 0, 1, 2, ... differing bits
        for b in group:
            q = 2 * p[b] * (1 - p[b])
            apart = np.append(apart * (1 - q), 0) + np.append(0, apart * q)
        costs = {-1: 0.0}
        for t in range(budget + len(groups)):
            rows = n * (ball(len(group), t // 2) + (t % 2) * ball(len(group), t // 2 + 1))
            costs[t] = row_cost * rows + pair_cost * n * n / 2 * apart[: t + 1].sum()
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, c in costs.items():
                if used + t not in step or cost + c < step[used + t][0]:
                    step[used + t] = (cost + c, [*chosen, t])
        best = step
    return best[budget]


def ball(bits: int, radius: int) -> int:
    return sum(comb(bits, k) for k in range(radius + 1))


def plan(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe."""
    found = [(allocate(n, both, groups, distance - m + 1), groups) for m in range(2, distance + 2) for groups in [group_bits(n, both, m)]]
    (_, thresholds), groups = min(found, key=lambda x: x[0][0])
    return [(g, t) for g, t in zip(groups, thresholds) if t >= 0]


def flips(bits: list[int], radius: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(bits, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signatures(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp, role): the rows to bring together. Role 0 meets all, 1 and 2 meet each other."""
    probes = []
    for k, (bits, t) in enumerate(parts):
        mask = sum(1 << b for b in bits)
        for role, radius in ((0, t // 2),) if t % 2 == 0 else ((1, t // 2), (2, t // 2 + 1)):
            probes += [(mask, f ^ _SALT[k], role) for f in flips(bits, radius)]
    rows = F.array(*(F.struct(F.lit(_signed(m)).alias("mask"), F.lit(_signed(f)).alias("flip"), F.lit(r).cast("byte").alias("role")) for m, f, r in probes))
    probe = fps.select("fp", F.explode(rows).alias("p"))
    return probe.select(F.col("fp").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("key"), "fp", F.col("p.role").alias("role"))


def star_links(members: DataFrame, distance: int) -> DataFrame:
    """Links of hot buckets' members through shared patterns. For an odd distance the pattern lies nearer to one end."""
    near, far = distance // 2, distance - distance // 2
    all_bits = list(range(BITS))

    def patterns(radius):
        probes = F.explode(F.array(*(F.lit(_signed(f)) for f in flips(all_bits, radius))))
        return members.select("fp", probes.alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))

    # members near one pattern are within the distance of each other and are far members too, so the least stands for them
    hubs = patterns(near).groupBy("z").agg(F.min("fp").alias("hub"))
    return patterns(far).join(hubs, "z").select(F.col("fp").alias("a"), F.col("hub").alias("b")).where("a != b").distinct()


def group_rows(rows: DataFrame, distance: int, hot: int, block: int = 1 << 10) -> DataFrame:
    """``rows`` (id, fp, ...) with ``component``, the least id of the row's group."""
    nodes = durable(rows.groupBy("fp").agg(F.min("id").alias("first")))
    n, both = bit_statistics(nodes)
    near, melted = deal(signatures(nodes, plan(n, both, distance)), block, "fp", hot)
    edges = durable(tree_links(near.withColumn("node", F.col("fp")), "node", ["fp"], distance).distinct())
    if melted is not None:
        edges = edges.union(star_links(melted.select("fp").distinct(), distance))
    return label_rows(rows, nodes, edges)


def label_rows(rows: DataFrame, nodes: DataFrame, edges: DataFrame, few: int = 0) -> DataFrame:
    """``rows`` with ``component``: ``nodes`` (fp, first) are connected by ``edges`` (a, b). ``few`` as in ``components``."""
    if edges.head(1):
        rooted = nodes.join(components(edges, few).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        least = rooted.groupBy("root").agg(F.min("first").alias("component"))
        grouped = durable(rooted.join(least, "root").select("fp", "component"))
    else:
        grouped = nodes.withColumnRenamed("first", "component")
    return rows.join(grouped, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4, seed: int = 42, hot: int = 1 << 18, block: int = 1 << 10) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (least id of its group)."""
    grouped = group_rows(durable(fingerprints(docs, id_col, text_col, shingle, seed)), distance, hot, block)
    return grouped.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4, seed: int = 42, hot: int = 1 << 18, block: int = 1 << 10) -> DataFrame:
    """The rows of ``docs`` that are the least id of their group, with all their columns; see ``least_of_groups``."""
    keyed = docs.select(F.col(id_col), F.col(text_col), row_key(id_col, text_col).alias("row"))
    rows = durable(fingerprints(keyed, id_col, text_col, shingle, seed, carry="row"))
    return least_of_groups(docs, id_col, text_col, group_rows(rows, distance, hot, block))


def row_key(id_col: str, text_col: str) -> Column:
    """With the id itself, the key of a row: rows of one id and one text are the same row, repeated."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def least_of_groups(docs: DataFrame, id_col: str, text_col: str, grouped: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, given the ``component`` of each (id, row).

    Of rows that share the least id of a group, the one with the least hash of id
    and text stays, once. Rows without an id stay only where their whole group has
    none. Rows are told apart by id and hash together.
    """
    grouped = durable(grouped.select("id", "row", "component"))
    losers = grouped.where("component IS NOT NULL AND NOT id <=> component").select("id", "row")
    again = grouped.where("id = component").groupBy("component").agg(F.min("row").alias("stays"), F.count("*").alias("n")).where("n > 1")
    repeated = bool(again.head(1))
    if repeated:
        losers = losers.union(grouped.where("id = component").join(again, "component").where("row != stays").select("id", "row"))
    key, own = fresh(docs, "row_key"), fresh(docs, "row_id")
    gone = bounded(durable(losers.select(F.col("id").alias(own), F.col("row").alias(key)).distinct()))
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    kept = keyed.join(gone, (keyed[key] == gone[key]) & keyed[id_col].eqNullSafe(gone[own]), "left_anti")
    if repeated:
        kept = kept.dropDuplicates([id_col, key])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
