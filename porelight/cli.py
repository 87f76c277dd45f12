"""Command line: ls, dump, pack and train over read files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porelight.functions import expr
from porelight.functions.codewords import coders, train
from porelight.operators import aggregates, packing, report
from porelight.operators.access import Reads
from porelight.operators.derive import over
from porelight.sources import reads


def listing(r: Reads, delimiter: str = "\t", separator: str = "/") -> DataFrame:
    """file_id, text lines of a full listing."""
    files, rate = r["read_file"], r["read_file"].select("file_id", F.col("channel.sampling_rate").alias("rate"))
    raw = r["raw_read"].join(rate, "file_id")
    groups = r.bc_groups().join(r["bc_strand"].groupBy("file_id", "gr").agg(F.bool_or(F.col("st") == 2).alias("have_2d")), ["file_id", "gr"], "left")
    fastq = r["bc_fastq"].select("file_id", "gr", "st", F.length(expr.fastq_bases(F.col("fq"))).alias("n"))
    strands = r["bc_strand"].join(r["bc_group"].select("file_id", "gr", "summary"), ["file_id", "gr"]).join(r["bc_events_params"], ["file_id", "gr", "st"], "left").join(fastq, ["file_id", "gr", "st"], "left")
    ed = r["ed_read"].select("file_id", F.concat("gr", F.lit("/"), "rn").alias("rn"), "packed")
    parts = [report.tracking_lines(files), report.channel_lines(files), report.raw_lines(raw, F.col("rate")), report.group_lines(groups), report.strand_lines(strands), report.packed_lines(ed, "ed")]
    return report.listing(parts, delimiter, separator)


def dump(r: Reads, mode: str, rn: str | None, st: int, gr: str | None, as_int: bool, with_time: bool, time_int: bool) -> DataFrame:
    """The rows of one dump mode."""
    rate = r["read_file"].select("file_id", F.col("channel.sampling_rate").alias("rate"))
    if mode == "id":
        return r["read_file"].select("file_id", F.explode(F.map_concat("tracking", "context")).alias("key", "value"))
    if mode == "rw":
        return report.dump_raw(r.raw_int_samples(rn).join(r["read_file"].select("file_id", "channel.*"), "file_id").withColumn("start_time", F.col("params.start_time")), as_int, with_time).drop("file_id", "rn")
    if mode == "ed":
        return report.dump_events(r.ed_events(gr, rn).orderBy("file_id", "event_idx"))
    if mode == "fq":
        return r.fastq(st, gr).select("fq")
    if mode == "ev":
        return report.dump_events(r.events(st, gr).join(rate, "file_id").orderBy("file_id", "event_idx"), F.col("rate") if time_int else None)
    if mode == "al":
        return r.alignment(gr).orderBy("file_id", "idx").select(F.col("template_index").alias("template"), F.col("complement_index").alias("complement"), "kmer")
    strands = r.bc_groups().join(r["bc_strand"], ["file_id", "gr"])
    return report.short_listing(r["raw_read"], r["ed_read"], strands).select("text")


def training_values(r: Reads, kind: str) -> tuple[DataFrame, int, int]:
    """(x, low, high) of what a code is trained on."""
    if kind == "rw":
        each = r["raw_read"].where("NOT packed").select("file_id", "rn", F.posexplode("signal").alias("i", "s"))
        return each.select((F.col("s") - F.lag("s").over(over(["file_id", "rn"], ["i"]))).alias("x")).where("x IS NOT NULL"), -100, 100
    if kind == "ed-len":
        return r["ed_event"].select(F.col("length").alias("x")), 1, 100
    quality = F.explode(F.filter(F.split(expr.split_fastq(F.col("fq"))["quality"], ""), lambda c: c != ""))
    return r["bc_fastq"].select(quality.alias("c")).select(expr.masked_quality(F.col("c")).cast("bigint").alias("x")), 0, 31


def pack_inputs(r: Reads) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables that ``packing.run`` takes, of what is not packed."""
    raw = r["raw_read"].where("NOT packed").select("file_id", "rn", "signal", F.col("params.start_time").alias("start_time")).join(_channel(r), "file_id")
    ed = r["ed_event"].join(r["ed_read"].select("file_id", "gr", "rn", F.col("params.start_time").alias("start_time")), ["file_id", "gr", "rn"])
    return raw, ed, r["bc_fastq"]


def packed_inputs(r: Reads) -> dict[str, DataFrame]:
    """And of what is."""
    return {"raw": r.packed_raw().join(_channel(r), "file_id"), "detected": r.packed_detected(), "fastq": r.packed_fastq()}


def _channel(r: Reads) -> DataFrame:
    return r["read_file"].select("file_id", "channel.offset", "channel.digitisation", "channel.range", F.col("channel.sampling_rate").alias("rate"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="porelight")
    commands = parser.add_subparsers(dest="command", required=True)
    add = {name: commands.add_parser(name) for name in ("ls", "dump", "pack", "train")}
    for p in add.values():
        p.add_argument("inputs", nargs="+")
        p.add_argument("-R", "--recurse", action="store_true")
        p.add_argument("--list", action="store_true", help="inputs are lists of paths")
        p.add_argument("--raw-code", help="file with the code of raw differences")
        p.add_argument("--code-prefix", default="porelight")
    add["ls"].add_argument("--delim", default="\t/", help="delimiter of the value, then of the path")
    modes = add["dump"].add_mutually_exclusive_group()
    for mode in ("ls", "id", "rw", "ed", "fq", "ev", "al"):
        modes.add_argument(f"--{mode}", dest="mode", action="store_const", const=mode, default="ls")
    add["dump"].add_argument("--rn")
    add["dump"].add_argument("--gr")
    add["dump"].add_argument("--st", type=int, default=0, choices=range(3))
    for flag in ("--curr-int", "--rw-time", "--time-int"):
        add["dump"].add_argument(flag, action="store_true")
    add["pack"].add_argument("--output", required=True, help="folder for the tables")
    add["pack"].add_argument("--preset", default="pack", choices=sorted(packing.PRESETS))
    for kind in packing.KINDS:
        add["pack"].add_argument(f"--{kind}", choices=("drop", "pack", "unpack", "copy"))
    add["pack"].add_argument("--qv-bits", type=int, default=5, choices=range(6))
    add["pack"].add_argument("--no-check", action="store_true")
    add["pack"].add_argument("--force", action="store_true")
    add["train"].add_argument("kind", choices=("rw", "ed-len", "fq-qv"))
    args = parser.parse_args(argv)

    spark = spark or SparkSession.builder.appName("porelight").getOrCreate()
    raw_code = None
    if args.raw_code:
        from porelight.functions.codewords import load

        with open(args.raw_code) as lines:
            raw_code = load(lines)
    r = Reads.open(spark, reads.list_paths(spark, args.inputs, args.recurse, args.list), args.recurse, coders(args.code_prefix, raw_code))
    show = lambda df: [print(*row, sep="\t") for row in df.toLocalIterator()]
    if args.command == "ls":
        show(listing(r, args.delim[0], args.delim[1:] or "/").select("text"))
    elif args.command == "dump":
        rows = dump(r, args.mode, args.rn, args.st, args.gr, args.curr_int, args.rw_time, args.time_int)
        if args.mode not in ("ls", "fq"):
            print(*rows.columns, sep="\t")
        show(rows)
    elif args.command == "train":
        values, low, high = training_values(r, args.kind)
        counts = {x.v: x.n - 1 for x in aggregates.histogram(values, "x", low, high).collect()}  # a row a symbol
        for symbol, code in train(counts, low, high):
            print(symbol, code)
    else:
        policies = {k: ("drop", "pack", "unpack", "copy").index(v) for k in packing.KINDS if (v := getattr(args, k))}
        done = packing.run(*pack_inputs(r), packing.Options(args.preset, policies, not args.no_check, args.force, args.qv_bits, codes=r.codes), packed_inputs(r))
        for name in ("raw", "detected", "fastq", "raw_packed", "detected_packed", "fastq_packed"):
            if name in done:
                done[name].write.mode("overwrite" if args.force else "errorifexists").parquet(f"{args.output}/{name}")
        show(aggregates.ratios(done["counts"]))
        errors = done["errors"].count()
        print("processed_files", r["read_file"].count(), sep="\t")
        if errors:
            print("errored_files", errors, sep="\t")
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
