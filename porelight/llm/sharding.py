"""Sharding by longest-processing-time scheduling (LPT).

Rows with equal texts form a group and stay together. Scheduling every group on
the driver would not scale, so the items scheduled are of two kinds, both of a
bounded number: *heavy* groups, those with at least ``1/max_heavy`` of all bytes
(so at most ``max_heavy`` of them), and *bins*, into which all other groups are
hashed. LPT takes the items from the largest down and gives each to the least
loaded shard, kept in a heap.

Defined results: a null text has no bytes and is grouped with empty texts; a
repeated row counts as often as it occurs and its copies get slots of their own;
equal sizes are taken in the order of the item's key, equally loaded shards in
the order of their number; an empty table gives an empty result. Only the id and
the text column are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from porelight.llm.common import durable


def schedule(items: list[tuple[str, int]], n_shards: int) -> dict[str, int]:
    """LPT: item key to shard, from (key, size) pairs."""
    heap = [(0, shard) for shard in range(n_shards)]
    placed = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[key] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24, overhead: int = 8, bins: int = 8192, max_heavy: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law ``bytes``, shard, slot, grown_shard (null).

    ``slot`` numbers the rows of a shard from 0 without a gap. It is the number of
    rows in earlier (item, part) cells of the shard plus the row's rank in its own
    cell; the cells are sized so that none has much over ``1/max_heavy`` of the
    rows unless its ids are equal, and so no task has to sort a whole shard.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = durable(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("crc"), F.unhex(F.md5(text)).alias("digest")))
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bin_of = F.concat(F.lit("bin "), F.pmod(F.xxhash64("digest"), F.lit(bins)).cast("string"))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    # at most max_heavy rows: each has 1/max_heavy of the bytes or more
    heavy = groups.where(F.col("size") * max_heavy >= total).select("digest", F.hex("digest").alias("heavy"), F.col("size").alias("group_size"))
    heavy_rows = heavy.collect()
    heavy = spark.createDataFrame(heavy_rows, heavy.schema)
    keyed = rows.join(F.broadcast(heavy.select("digest", "heavy")), "digest", "left").withColumn("item", F.coalesce("heavy", bin_of))
    light = keyed.where(F.col("heavy").isNull()).groupBy("item").agg(F.sum("size").alias("size")).collect()  # at most `bins` rows
    placed = schedule([(r["heavy"], r["group_size"]) for r in heavy_rows] + [(r["item"], r["size"]) for r in light], n_shards)

    counts = {r["item"]: r["n"] for r in keyed.groupBy("item").agg(F.count("*").alias("n")).collect()}
    most = max(1, -(-n_rows // max_heavy))
    split = spark.createDataFrame([(k, placed[k], -(-n // most)) for k, n in counts.items()], "item string, shard int, parts long")
    celled = keyed.join(F.broadcast(split), "item").withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")))
    cells = celled.groupBy("item", "part").agg(F.count("*").alias("n")).collect()  # at most bins + 2 * max_heavy + ... rows
    offsets, filled = [], defaultdict(int)
    for item, part, n in sorted(tuple(r) for r in cells):
        offsets.append((item, part, filled[placed[item]]))
        filled[placed[item]] += n
    offset = spark.createDataFrame(offsets, "item string, part long, before long")
    rank = F.row_number().over(Window.partitionBy("item", "part").orderBy("id", "crc"))
    return celled.select("id", "size", "crc", "shard", "item", "part").withColumn("rank", rank).join(F.broadcast(offset), ["item", "part"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
