"""Buckets of fingerprints: rows that share a key, verified pair by pair, with only a spanning forest emitted.

A bucket of up to ``block`` rows is one group of a task. A larger one, however
large, is dealt into ``n / block`` slots, and each pair of slots is a group of its
own, so that every pair of its rows still meets in some task and no task holds
more than two slots. Bucket sizes are counted, with partial sums, before any row
of a large bucket is moved.

``deal`` deals out all rows of a large bucket, which makes ``n * n / block`` of
them. ``deal_around`` first links the rows within the distance of the bucket's
centre to it, which connects them; only the rows outside of this star meet it and
each other in pairs of slots. ``thinned`` takes out links that other buckets repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from porelight.llm.common import bounded, durable
from porelight.runtime import ship_package


def deal(rows: DataFrame, block: int, by: str, hot: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (key, ...) with the key of the group of each, and the rows of buckets of over ``hot`` rows, if any."""
    sizes = durable(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    if not sizes.head(1):
        return rows, None
    columns = [c for c in rows.columns if c != "key"]
    tagged = rows.join(bounded(sizes), "key", "left")
    melted = None
    if hot is not None and sizes.where(F.col("n") > hot).head(1):
        melted = tagged.where(F.col("n") > hot).select("key", *columns)
        tagged = tagged.where(F.col("n").isNull() | (F.col("n") <= hot))
    slots = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64(F.lit("slot"), by), slots)
    dealt = tagged.where("n IS NOT NULL").withColumns({"slots": slots, "own": own}).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    group = F.xxhash64(F.lit("group"), "key", F.least("own", "other"), F.greatest("own", "other"))
    return tagged.where("n IS NULL").select("key", *columns).union(dealt.select(group.alias("key"), *columns)), melted


def centres(rows: DataFrame, sizes: DataFrame, node: str, words: list[str], most: int = 512) -> DataFrame:
    """(key, centre, p0, ...): for each bucket of ``sizes`` (key, n) the row that is nearest to the majority of about ``most`` of its rows."""
    ship_package(rows.sparkSession)
    kind, marks = rows.schema[node].dataType.simpleString(), [f"p{k}" for k in range(len(words))]
    some = rows.join(bounded(sizes), "key").where(F.pmod(F.xxhash64(F.lit("centre"), node), F.ceil(F.col("n") / most)) == 0)

    def run(batches):
        for table in whole_buckets(batches):
            key = table.column("key").to_numpy()
            fp = np.stack([table.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            nearest = pa.array([a + int(from_middle(fp[a:b]).argmin()) for a, b in zip(start.tolist(), [*start[1:].tolist(), len(key)])])
            yield table.take(nearest).rename_columns(["key", "centre", *marks]).combine_chunks().to_batches()[0]

    read = some.select("key", node, *words).repartition("key").sortWithinPartitions("key")
    return read.mapInArrow(run, ", ".join(["key long", f"centre {kind}", *(f"{m} long" for m in marks)]))


def deal_around(rows: DataFrame, block: int, by: str, words: list[str], distance: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` (key, ...) that have to meet, with the key of the group and the role of each, and the links (a, b) of the stars, if any."""
    small = rows.withColumn("role", F.lit(0).cast("byte"))
    sizes = durable(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    if not sizes.head(1):
        return small, None
    known = durable(sizes.join(centres(rows, sizes, by, words), "key", "left"))
    columns = [c for c in rows.columns if c != "key"]
    tagged = rows.join(bounded(known), "key", "left")
    small = tagged.where("n IS NULL").select("key", *columns, F.lit(0).cast("byte").alias("role"))
    apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"p{k}"))) for k, w in enumerate(words)), F.lit(0))
    large = tagged.where("n IS NOT NULL").withColumn("core", F.coalesce(apart <= distance, F.lit(False)))
    stars = large.where("core").select(F.col("centre").alias("a"), F.col(by).alias("b"))
    rests = durable(large.where("NOT core").groupBy("key").agg(F.count("*").alias("r")))
    if not rests.head(1):
        return small, stars
    rest_slots, core_slots = F.ceil(F.col("r") / block), F.greatest(F.ceil((F.col("n") - F.col("r")) / block), F.lit(1))
    open_ = large.join(bounded(rests), "key").withColumns({"rest_slots": rest_slots, "core_slots": core_slots})
    open_ = open_.withColumn("own", F.pmod(F.xxhash64(F.lit("slot"), by), F.when(F.col("core"), F.col("core_slots")).otherwise(F.col("rest_slots"))))

    def to(kind, slots, role, pair):
        numbers = F.sequence(F.lit(0).cast("long"), F.col(slots) - 1)
        return F.transform(numbers, lambda k: F.struct(F.xxhash64(F.lit(kind), "key", *pair(k)).alias("key"), F.lit(role).cast("byte").alias("role")))

    # rows outside meet each other, and rows inside
    own = F.col("own")
    outside = F.concat(to("rest", "rest_slots", 0, lambda k: (F.least(own, k), F.greatest(own, k))), to("core", "core_slots", 1, lambda k: (own, k)))
    dealt = open_.select(*columns, F.explode(F.when(F.col("core"), to("core", "rest_slots", 2, lambda k: (k, own))).otherwise(outside)).alias("to"))
    return small.union(dealt.select("to.key", *columns, "to.role")), stars


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect what ``links`` connect, not many more than there are nodes.

    In a round a node keeps its link to the least ``a`` that it has, and its others
    are linked to that one instead of to it. Rounds end when one takes away less
    than a tenth. ``links`` come of trees: what is collected of a node are its
    parents, at first one a group that it is in, later the inner nodes of trees.
    """
    links = durable(links)
    n = links.count()
    while True:
        ends = links.groupBy("b").agg(F.collect_set("a").alias("ends"))
        least = ends.select(F.array_min("ends").alias("a"), F.explode(F.array_append("ends", F.col("b"))).alias("b"))
        links = durable(least.where("a != b").distinct())
        before, n = n, links.count()
        if n > 0.9 * before:
            return links


def _near(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Which rows of ``x`` are within the distance of the rows, or the row, ``y``."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= distance


def from_middle(rows: np.ndarray) -> np.ndarray:
    """How many bits of each row differ from the majority of all."""
    bits = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1), axis=1)
    middle = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(rows)).view(np.uint64)
    return np.bitwise_count(rows ^ middle).sum(axis=1, dtype=np.int64)


def forest(key: np.ndarray, fp: np.ndarray, role: np.ndarray, distance: int, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of the links of a spanning forest of each bucket. Rows are sorted by key; ``fp`` has a column per 64 bits.

    Roles 1 and 2 meet each other only, role 0 meets all. Small buckets are
    compared at all offsets side by side, larger ones by breadth-first search from
    the row that is nearest to the bucket's majority.
    """
    n = len(key)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if n else np.zeros(0, int)
    size = np.diff(np.append(start, n))
    a, b = [], []
    parent, at, d = np.arange(n), np.flatnonzero(np.repeat((size > 1) & (size <= small), size)), 0
    while len(at):
        d += 1
        at = at[at + d < n]
        at = at[key[at] == key[at + d]]
        open_ = at[parent[at] != parent[at + d]]
        near = open_[_near(fp[open_], fp[open_ + d], distance) & ((role[open_] == 0) | (role[open_] != role[open_ + d]))]
        for i in near.tolist():
            x, y = i, i + d
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(i)
                b.append(i + d)
        if len(near):
            while (up := parent[parent] != parent).any():
                parent[up] = parent[parent[up]]
    a, b = [np.array(a, np.int64)], [np.array(b, np.int64)]
    for s, m in zip(start[size > small].tolist(), size[size > small].tolist()):
        rows, sides = fp[s : s + m], role[s : s + m]
        left = np.argsort(from_middle(rows), kind="stable")  # unvisited, nearest to the middle first
        mixed = bool(sides.any())
        while len(left):
            seed, left = left[:1], left[1:]
            front = seed.tolist()
            while front and len(left):
                i = front.pop(0)
                hit = _near(rows[left], rows[i], distance)
                if mixed:
                    hit &= (sides[left] == 0) | (sides[left] != sides[i])
                if hit.any():
                    new = left[hit]
                    left = left[~hit]
                    a.append(np.full(len(new), s + i))
                    b.append(s + new)
                    front += new.tolist()
    return np.concatenate(a), np.concatenate(b)


def whole_buckets(batches):
    """The rows of ``batches``, sorted by key, as tables that end with a bucket."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]).combine_chunks() if rest is not None else table
        key = table.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on in the next batch
        rest, done = table.slice(last), table.slice(0, last)
        if last:
            yield done
    if rest is not None and len(rest):
        yield rest


def tree_links(rows: DataFrame, node: str, words: list[str], distance: int) -> DataFrame:
    """(a, b): nodes linked by the forest of each bucket of ``rows`` (key, node, the words of a fingerprint, role or none)."""
    ship_package(rows.sparkSession)
    kind, roles = rows.schema[node].dataType.simpleString(), "role" in rows.columns
    read = ["key", node, *words, *(["role"] * roles)]

    def run(batches):
        for table in whole_buckets(batches):
            yield from settle(table)

    def settle(table):
        fp = np.stack([table.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
        role = table.column("role").to_numpy() if roles else np.zeros(len(table), np.int8)
        a, b = forest(table.column("key").to_numpy(), fp, role, distance)
        if len(a):
            ids = table.column(node).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])

    return rows.select(*read).repartition("key").sortWithinPartitions("key").mapInArrow(run, f"a {kind}, b {kind}")
