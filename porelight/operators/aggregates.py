"""Aggregates over reads: counters, histograms, durations, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of a pack run; all of them add up.
COUNTERS = ("rs_count", "rs_bits", "ed_count", "ed_skip_bits", "ed_len_bits", "fq_count", "fq_bp_bits", "fq_qv_bits", "bp_seq_count", "ev_count", "ev_rel_skip_bits", "ev_skip_bits", "ev_len_bits", "ev_move_bits", "ev_p_model_state_bits", "al_count", "al_template_step_bits", "al_complement_step_bits", "al_move_bits")
DURATIONS = ("rs_total_duration", "rs_called_duration")


def total_counts(counts: DataFrame) -> DataFrame:
    """One row: the sums of all counters that the rows have, 0 for the others."""
    have = set(counts.columns)
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) if c in have else F.lit(0).cast("bigint").alias(c) for c in COUNTERS), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in DURATIONS))


def histogram(values: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """v, n for every v in [low - 1, high]: the values' counts plus one; values outside count as low - 1."""
    v = F.when(F.col(column).between(low, high), F.col(column)).otherwise(low - 1).cast("bigint")
    counts = values.groupBy(v.alias("v")).agg(F.count("*").alias("__n"))
    every = values.sparkSession.range(low - 1, high + 1).withColumnRenamed("id", "v")
    return every.join(counts, "v", "left").select("v", (F.coalesce("__n", F.lit(0)) + 1).alias("n"))


def rarest_and_commonest(counts: DataFrame, k: int = 10) -> DataFrame:
    """end, v, n: the ``k`` least and the ``k`` most frequent values of a histogram, which a trainer reports."""
    least, most = counts.orderBy("n", "v").limit(k), counts.orderBy(F.desc("n"), F.desc("v")).limit(k)
    return least.select(F.lit("least").alias("end"), "v", "n").unionByName(most.select(F.lit("most").alias("end"), "v", "n"))


def mean_bits(counts: DataFrame, code: DataFrame) -> DataFrame:
    """bits: the mean length of a value's code; ``code`` has symbol and len, with the escape as a null symbol. Values without a code take the escape's."""
    escape = code.where("symbol IS NULL").agg(F.max("len").alias("__escape"))
    sized = counts.join(code.where("symbol IS NOT NULL").select(F.col("symbol").alias("v"), "len"), "v", "left")
    return sized.join(F.broadcast(escape)).agg((F.sum(F.coalesce("len", "__escape") * F.col("n")) / F.sum("n")).alias("bits"))  # one row


def called_duration(events: DataFrame, keys: list[str], order: str, start: str, length: str) -> DataFrame:
    """From the first event's start to the last one's end."""
    end = F.max_by(F.col(start) + F.col(length), F.col(order))
    return events.groupBy(*keys).agg((end - F.min_by(start, order)).alias("called"))


def joined_list(rows: DataFrame, keys: list[str], value: Column, order: str, by: str = ",") -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["v"]), by).alias("list"))


def average_bits(data: Column, n: Column) -> Column:
    return F.format_string("%.2f", F.octet_length(data) * 8 / n)


def ratios(totals: DataFrame) -> DataFrame:
    """The report of a pack run in long form: key, value; groups without a count are left out."""
    per = lambda bits, n: F.coalesce(F.try_divide(F.col(bits).cast("double"), F.col(n).cast("double")), F.lit(float("nan")))
    streams = {"rs": ("rs_bits",), "ed": ("ed_skip_bits", "ed_len_bits"), "fq": ("fq_bp_bits", "fq_qv_bits"), "ev": ("ev_rel_skip_bits", "ev_skip_bits", "ev_len_bits", "ev_move_bits", "ev_p_model_state_bits"), "al": ("al_template_step_bits", "al_complement_step_bits", "al_move_bits")}
    lines = [(F.lit(True), "bp_seq_count", F.col("bp_seq_count").cast("double"))]
    for kind, parts in streams.items():
        some = F.col(f"{kind}_count") > 0
        lines.append((some, f"{kind}_count", F.col(f"{kind}_count").cast("double")))
        for p in parts:
            there = some & (F.col(p) > 0)
            lines += [(there, p, F.col(p).cast("double")), (there, f"{p}_per_value", per(p, f"{kind}_count")), (there, f"{p}_per_base", per(p, "bp_seq_count"))]
        lines.append((some, f"{kind}_total_bits", sum((F.col(p) for p in parts), F.lit(0)).cast("double")))
    timed = (F.col("rs_total_duration") > 1e-3) & (F.col("rs_called_duration") > 1e-3)
    lines += [(timed, d, F.col(d)) for d in DURATIONS]
    lines += [(timed, "rs_frac_called", per("rs_called_duration", "rs_total_duration")), (timed, "bp_per_sec", per("bp_seq_count", "rs_called_duration"))]
    rows = F.array(*(F.struct(F.lit(k).alias("line"), ok.alias("ok"), F.lit(name).alias("key"), v.alias("value")) for k, (ok, name, v) in enumerate(lines)))
    return totals.select(F.explode(rows).alias("r")).where("r.ok").select("r.line", "r.key", "r.value").orderBy("line").drop("line")
