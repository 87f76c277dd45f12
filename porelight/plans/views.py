"""Tables of the driver seen as reads, events, sequences and attributes; each with the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

READ = ["rn"]


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_raw(spark, sf_dir) -> DataFrame:
    """rn, idx, s: raw samples from the events of a user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    clamped = F.least(F.greatest(F.col("value").cast("bigint"), F.lit(-32768)), F.lit(32767)).cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rn"), (F.row_number().over(w) - 1).cast("bigint").alias("idx"), clamped.alias("s"))


def v_ed(spark, sf_dir) -> DataFrame:
    """rn, event_idx, skip, len: detected events from the lines of an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rn"), (F.row_number().over(w) - 1).cast("bigint").alias("event_idx"), (F.col("l_suppkey") % 3).alias("skip"), F.col("l_quantity").cast("bigint").alias("len"))


def v_seq(spark, sf_dir) -> DataFrame:
    """rn, sq: the A, C, G and T of a document."""
    sq = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rn"), sq.alias("sq")).where("sq != ''")


def v_channel(spark, sf_dir) -> DataFrame:
    """One channel per nation."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.lit(8192.0).alias("digitisation"), (F.col("n_nationkey") + 10.0).alias("offset"), F.lit(1400.0).alias("range"), F.lit(4000.0).alias("sampling_rate"))


def v_attr(spark, sf_dir) -> DataFrame:
    """obj, name, value: columns of customers as attributes."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.expr("stack(3, 'name', c_name, 'segment', c_mktsegment, 'nation', cast(c_nationkey AS string)) AS (name, value)")).select(F.col("c_custkey").alias("obj"), "name", "value")


def v_group(spark, sf_dir) -> DataFrame:
    """file_id, gr, gr_ord and what a basecall group says of itself, from the orders of a customer."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    program = F.element_at(F.array(*map(F.lit, PROGRAMS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(
        F.col("o_custkey").alias("file_id"), F.format_string("%03d", F.row_number().over(w) - 1).alias("gr"), (F.row_number().over(w) - 1).alias("gr_ord"), F.col("o_orderkey").alias("key"), program.alias("program"),
        F.concat(F.lit("Analyses/Basecall_"), F.format_string("%03d", F.col("o_orderkey") % 4)).alias("basecall_1d"), F.concat(F.lit("Analyses/EventDetection_"), F.format_string("%03d", F.col("o_orderkey") % 3)).alias("event_detection"),
        F.format_string("%03d", F.col("o_orderkey") % 5).alias("packed_ed_gr"), (F.col("o_orderpriority") != "1-URGENT").alias("have_1d"), (F.col("o_orderstatus") != "P").alias("have_0"),
    )


PROGRAMS = ("ONT Sequencing Workflow", "MinKNOW-Live-Basecalling", "ONT Albacore Sequencing Software", "other")

SQL = {
    "v_raw": "v_raw AS (SELECT user_id AS rn, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, CAST(least(greatest(CAST(trunc(value) AS BIGINT), -32768), 32767) AS INTEGER) AS s FROM events)",
    "v_ed": "v_ed AS (SELECT l_orderkey AS rn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS event_idx, l_suppkey % 3 AS skip, CAST(trunc(l_quantity) AS BIGINT) AS len FROM lineitem)",
    "v_seq": "v_seq AS (SELECT * FROM (SELECT doc_id AS rn, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS sq FROM documents) WHERE sq <> '')",
    "v_channel": "v_channel AS (SELECT n_nationkey, 8192.0::DOUBLE AS digitisation, n_nationkey + 10.0::DOUBLE AS \"offset\", 1400.0::DOUBLE AS \"range\", 4000.0::DOUBLE AS sampling_rate FROM nation)",
    "v_attr": "v_attr AS (SELECT c_custkey AS obj, unnest(['name', 'segment', 'nation']) AS name, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer)",
    "v_group": "v_group AS (SELECT o_custkey AS file_id, printf('%03d', row_number() OVER w - 1) AS gr, row_number() OVER w - 1 AS gr_ord, o_orderkey AS key, ["
    + ", ".join(f"'{p}'" for p in PROGRAMS)
    + "][o_orderkey % 4 + 1] AS program, 'Analyses/Basecall_' || printf('%03d', o_orderkey % 4) AS basecall_1d, 'Analyses/EventDetection_' || printf('%03d', o_orderkey % 3) AS event_detection, printf('%03d', o_orderkey % 5) AS packed_ed_gr, o_orderpriority <> '1-URGENT' AS have_1d, o_orderstatus <> 'P' AS have_0 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))",
}


def with_views(sql: str, *names: str) -> str:
    return f"WITH {', '.join(SQL[n] for n in names)} {sql}"
