"""Listings and dumps: long-form (path, value) lines and tab-separated tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porelight.functions import expr


def lines(rows: DataFrame, *pairs: tuple[Column, Column]) -> DataFrame:
    """file_id, line, path, value for each (path, value) of each row; null values are left out."""
    each = F.array(*(F.struct(F.lit(k).alias("line"), path.alias("path"), value.cast("string").alias("value")) for k, (path, value) in enumerate(pairs)))
    return rows.select("file_id", F.explode(each).alias("l")).select("file_id", "l.line", "l.path", "l.value").where("value IS NOT NULL")


def tracking_lines(files: DataFrame) -> DataFrame:
    """Device and flow cell, and the start as date and time, where they are known."""
    get = lambda k: F.try_element_at("tracking", F.lit(k))
    start = expr.start_time_of(get("exp_start_time"))
    return lines(files, *((F.lit(f"tid/{k}"), get(k)) for k in ("device_id", "asic_id", "flow_cell_id", "exp_script_purpose")), (F.lit("tid/exp_start_date"), F.date_format(start, "yyyy-MM-dd")), (F.lit("tid/exp_start_time"), F.date_format(start, "HH:mm:ss")))


def channel_lines(files: DataFrame) -> DataFrame:
    return lines(files, (F.lit("cid/channel_number"), F.col("channel.channel_number")), (F.lit("cid/sampling_rate"), F.col("channel.sampling_rate").cast("bigint")))


def packed_lines(reads: DataFrame, kind: str) -> DataFrame:
    return lines(reads, (F.concat(F.lit(f"{kind}/"), "rn", F.lit("/packed")), F.col("packed").cast("int")))


def raw_lines(reads: DataFrame, rate: Column) -> DataFrame:
    """``reads``: file_id, rn, packed, params."""
    at = lambda k: F.concat(F.lit("rs/"), "rn", F.lit(f"/{k}"))
    return lines(reads, (at("packed"), F.col("packed").cast("int")), (at("read_number"), F.col("params.read_number")), (at("read_id"), F.col("params.read_id")), (at("start"), expr.as_time(F.col("params.start_time"), rate)), (at("length"), expr.as_time(F.col("params.duration"), rate)))


def group_lines(groups: DataFrame) -> DataFrame:
    """``groups``: file_id, gr, name, version, bc_1d_gr, ed_gr, have_2d, have_1d."""
    at = lambda k: F.concat(F.lit("bc/"), "gr", F.lit(f"/{k}"))
    return lines(groups, (at("id"), F.concat_ws(":", "name", "version")), (at("bc_1d_gr"), F.when(F.col("have_2d"), F.col("bc_1d_gr"))), (at("ed_gr"), F.when(F.col("have_1d"), F.col("ed_gr"))))


def strand_lines(strands: DataFrame) -> DataFrame:
    """``strands``: file_id, gr, st, summary, have and packed flags, params (start_time, duration), rate and n bases of the fastq."""
    at = lambda k: F.concat(F.lit("bc/"), "gr", F.lit("/"), F.col("st").cast("string"), F.lit(f"/{k}"))
    key = F.element_at(F.array(F.lit("basecall_1d_template"), F.lit("basecall_1d_complement"), F.lit("basecall_2d")), F.col("st").cast("int") + 1)
    summary = lambda k: F.when(F.col("have_fastq"), F.try_element_at("summary", F.concat(key, F.lit(f"/{k}"))))
    events = (F.col("st") < 2) & F.col("have_events")
    seconds = F.col("params.duration")
    return lines(
        strands, (at("fastq/packed"), F.when(F.col("have_fastq"), F.col("packed_fastq").cast("int"))), (at("fastq/sequence_length"), summary("sequence_length")), (at("fastq/mean_qscore"), summary("mean_qscore")),
        (at("events/packed"), F.when(events, F.col("packed_events").cast("int"))), (at("events/start"), F.when(events, expr.as_time(F.col("params.start_time"), F.lit(1.0)))), (at("events/length"), F.when(events, expr.as_time(seconds, F.lit(1.0)))),
        (at("bps"), F.when(events, expr.bases_per_second(F.col("n"), seconds))), (at("model"), F.when(F.col("st") < 2, F.col("have_model").cast("int"))), (at("alignment/packed"), F.when((F.col("st") == 2) & F.col("have_alignment"), F.col("packed_alignment").cast("int"))),
    )


def listing(parts: list[DataFrame], delimiter: str = "\t", separator: str = "/") -> DataFrame:
    """file_id, text: all lines of all parts with their delimiters, in order of part and line."""
    every = None
    for k, part in enumerate(parts):
        numbered = part.withColumn("part", F.lit(k))
        every = numbered if every is None else every.unionByName(numbered)
    path = F.replace("path", F.lit("/"), F.lit(separator))
    return every.orderBy("file_id", "part", "path", "line").select("file_id", F.concat(path, F.lit(delimiter), "value").alias("text"))


def short_listing(raw: DataFrame, detected: DataFrame, basecalled: DataFrame) -> DataFrame:
    """file_id, text: the reads with raw samples, the event-detection groups with their reads, the strands with their flags and link."""
    reads = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn_ord", "rn"))), lambda r: r["rn"]), ",")
    rw = raw.select("file_id", F.concat(F.lit("rw\t"), "rn").alias("text"))
    ed = detected.groupBy("file_id", "gr").agg(reads.alias("r")).select("file_id", F.concat(F.lit("ed\t"), "gr", F.lit("\t"), "r").alias("text"))
    two = F.col("st") == 2
    link = F.when(two, F.col("bc_1d_gr")).otherwise(F.col("ed_gr"))
    bc = basecalled.select("file_id", F.concat_ws("\t", F.when(two, "bc2d").otherwise("bc1d"), "gr", F.col("st").cast("string"), F.col("have_fastq").cast("int").cast("string"), F.col("have_events").cast("int").cast("string"), F.when(link == "", ".").otherwise(link)).alias("text"))
    return rw.unionByName(ed).unionByName(bc)


def dump_raw(reads: DataFrame, as_int: bool = False, with_time: bool = False) -> DataFrame:
    """One row per sample of ``reads`` (file_id, rn, signal, start_time and the channel's numbers)."""
    each = reads.select("file_id", "rn", "start_time", "digitisation", "offset", "range", F.posexplode("signal").alias("__i", "__s"))
    value = F.col("__s").alias("curr_i") if as_int else expr.to_current(F.col("__s"), F.col("digitisation"), F.col("offset"), F.col("range")).alias("curr_f")
    return each.select("file_id", "rn", *([(F.col("start_time") + F.col("__i")).alias("start")] * with_time), value)


def dump_events(events: DataFrame, rate: Column | None = None) -> DataFrame:
    """start, length, mean, stdv; seconds become samples if there is a rate."""
    time = (lambda c: expr.time_to_int(F.col(c), rate).alias(c)) if rate is not None else F.col
    more = [c for c in ("model_state", "move", "p_model_state") if c in events.columns]
    return events.select(time("start"), time("length"), "mean", "stdv", *more)


def write_tsv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("sep", "\t").option("header", True).csv(path)
