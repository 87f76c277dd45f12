"""Packing of reads: streams instead of tables, checked by unpacking, with counts; one plan for all files.

Policies per kind of table: drop, pack, unpack, copy. Rows that are packed
already pass through uncounted; errors are rows with a message, so that one bad
read does not end the job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porelight.functions import codec, expr
from porelight.functions.codewords import Code, coders
from porelight.operators import aggregates, derive

DROP, PACK, UNPACK, COPY = range(4)
KINDS = ("rw", "ed", "fq", "ev", "al")
PRESETS = {"pack": dict.fromkeys(KINDS, PACK), "unpack": dict.fromkeys(KINDS, UNPACK), "archive": dict.fromkeys(KINDS, DROP) | {"rw": PACK}, "fastq": dict.fromkeys(KINDS, DROP) | {"fq": PACK}}
#: Differences that unpacking may make.
TOLERANCE = {"ed": {"mean": 0.1, "stdv": 0.1}, "ev": {"start": 1e-3, "length": 1e-3, "mean": 0.1, "stdv": 0.1}}


@dataclass
class Options:
    """Policies and parameters of a run; explicit policies override the preset."""

    preset: str = "pack"
    policies: dict[str, int] = field(default_factory=dict)
    check: bool = True
    force: bool = False
    qv_bits: int = expr.QUALITY_BITS
    p_model_state_bits: int = 2
    codes: dict[str, Code] = field(default_factory=coders)

    def policy(self, kind: str) -> int:
        return self.policies.get(kind, PRESETS[self.preset][kind])


# streams of one read per row ---------------------------------------------------
def pack_raw(reads: DataFrame, code: Code | None = None) -> DataFrame:
    """signal becomes the stream raw."""
    packed = codec.pack_huffman(reads.sparkSession, F.col("signal").cast("array<bigint>"), code or coders()["rw"])
    return reads.withColumn("raw", packed).drop("signal")


def unpack_raw(reads: DataFrame, code: Code | None = None) -> DataFrame:
    values = codec.unpack_huffman(reads.sparkSession, F.col("raw"), code or coders()["rw"])
    return reads.withColumn("signal", values.cast("array<smallint>")).drop("raw")


def pack_detected(events: DataFrame, keys: list[str], t0: Column, codes: dict[str, Code] | None = None) -> DataFrame:
    """keys, n, skip and len streams; mean and stdv are dropped, for the signal has them."""
    codes, spark = codes or coders(), events.sparkSession
    placed = derive.start_to_skip(events, keys, ["event_idx"], t0)
    rows = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("event_idx", "skip", "len"))).alias("e"))
    take = lambda c: F.transform("e", lambda x: x[c].cast("bigint"))
    return rows.select(*keys, F.size("e").cast("bigint").alias("n"), codec.pack_huffman(spark, take("skip"), codes["ed_skip"]).alias("skip"), codec.pack_huffman(spark, take("len"), codes["ed_len"]).alias("len"))


def unpack_detected(packed: DataFrame, reads: DataFrame, keys: list[str], codes: dict[str, Code] | None = None) -> DataFrame:
    """Detected events; ``packed`` has keys, skip, len, start_time and ``reads`` keys, signal in picoampere, rs_start."""
    codes, spark = codes or coders(), packed.sparkSession
    plain = packed.withColumns({"skip": codec.unpack_huffman(spark, F.col("skip"), codes["ed_skip"]), "len": codec.unpack_huffman(spark, F.col("len"), codes["ed_len"])})
    return derive.unpack_events(plain, reads, keys)


def implicit_detected(packed: DataFrame, reads: DataFrame, keys: list[str], codes: dict[str, Code] | None = None) -> DataFrame:
    """The detected events behind basecall events that were packed without an event-detection group."""
    some = F.when(F.coalesce(F.octet_length("skip.bytes"), F.lit(0)) == 0, F.raise_error(F.lit("no events to unpack"))).otherwise(F.lit(True))
    return unpack_detected(packed.where(some), reads, keys, codes)


def pack_fastq(rows: DataFrame, qv_bits: int = expr.QUALITY_BITS, codes: dict[str, Code] | None = None) -> DataFrame:
    """fq becomes read_name, bp and qv streams and n bases. The comment goes, and qualities keep ``qv_bits`` of five bits."""
    codes, spark = codes or coders(), rows.sparkSession
    parts = rows.withColumn("__f", expr.split_fastq(F.col("fq")))
    mask = (1 << expr.QUALITY_BITS) - (1 << (expr.QUALITY_BITS - qv_bits))
    bp = codec.pack_characters(spark, F.col("__f.bases"), codes["fq_bp"])
    qv = codec.pack_characters(spark, F.col("__f.quality"), codes["fq_qv"], 33, expr.MAX_QUALITY, mask)
    return parts.select(*(c for c in rows.columns if c != "fq"), F.col("__f.name").alias("read_name"), F.length("__f.bases").cast("bigint").alias("n"), bp.alias("bp"), qv.alias("qv"))


def unpack_fastq(rows: DataFrame, codes: dict[str, Code] | None = None) -> DataFrame:
    codes, spark = codes or coders(), rows.sparkSession
    bp, qv = codec.unpack_characters(spark, F.col("bp"), codes["fq_bp"]), codec.unpack_characters(spark, F.col("qv"), codes["fq_qv"], 33)
    fq = F.concat(F.lit("@"), "read_name", F.lit("\n"), bp, F.lit("\n+\n"), qv, F.lit("\n"))
    return rows.select(*(c for c in rows.columns if c not in ("read_name", "n", "bp", "qv")), fq.alias("fq"))


def pack_basecall(events: DataFrame, keys: list[str], rate: Column, detected: DataFrame | None = None, bits: int = 2, codes: dict[str, Code] | None = None) -> DataFrame:
    """keys, n, start_time, state_size, error and streams of basecall events.

    ``events`` has keys, event_idx, start, length (seconds), move, model_state,
    p_model_state, sq. With detected events (keys, event_idx, start) their
    indexes are stored, else skip and len. mean, stdv, start, length and
    model_state go.
    """
    codes, spark = codes or coders(), events.sparkSession
    timed = events.withColumns({"__t": expr.time_to_int(F.col("start"), rate), "__n": expr.time_to_int(F.col("length"), rate), "__p": expr.quantise(F.col("p_model_state"), bits)})
    moves = derive.repair_moves(events.select(*keys, "event_idx", "move", "model_state", "sq"), keys).withColumnRenamed("move", "__m")
    if detected is not None:
        placed = derive.asof_forward(timed, detected, keys, "event_idx", "__t", "event_idx", "start").withColumn("error_ed", F.when(F.col("j").isNull(), "no detected event is left"))
        fields = ["rel_skip"]
    else:
        first = F.first("__t").over(derive.over(keys, ["event_idx"]))
        placed = derive.start_to_skip(timed.withColumn("__t0", first), keys, ["event_idx"], F.col("__t0"), "__t", "__n").withColumn("error_ed", F.lit(None).cast("string"))
        fields = ["skip", "len"]
    rows = placed.join(moves.hint("merge"), [*keys, "event_idx"]).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("event_idx", *(F.coalesce(f, F.lit(0)).alias(f) for f in fields), F.coalesce("__m", F.lit(0)).alias("__m"), "__p"))).alias("e"),
        F.min_by("__t", "event_idx").alias("start_time"), F.length(F.min_by("model_state", "event_idx")).alias("state_size"), F.coalesce(F.min("error"), F.min("error_ed")).alias("error"))
    take = lambda c: F.transform("e", lambda x: x[c].cast("bigint"))
    streams = {f: codec.pack_huffman(spark, take(f), codes[{"rel_skip": "ev_rel_skip", "skip": "ed_skip", "len": "ed_len"}[f]]) for f in fields}
    return rows.select(*keys, F.size("e").cast("bigint").alias("n"), "start_time", "state_size", "error", *(v.alias(f) for f, v in streams.items()), codec.pack_huffman(spark, take("__m"), codes["ev_move"]).alias("move"), codec.pack_bits(spark, take("__p"), bits).alias("p_model_state"))


def unpack_basecall(packed: DataFrame, bases: DataFrame, detected: DataFrame, keys: list[str], rate: Column, median_sd_temp: Column, k: int, codes: dict[str, Code] | None = None) -> DataFrame:
    """The events of ``pack_basecall`` with a rel_skip stream, from the sequence and the detected events. All streams of a read have one size, or it is an error."""
    codes, spark = codes or coders(), packed.sparkSession
    plain = packed.select(*keys, "p_model_state.params", codec.unpack_huffman(spark, F.col("rel_skip"), codes["ev_rel_skip"]).alias("r"), codec.unpack_huffman(spark, F.col("move"), codes["ev_move"]).alias("m"), codec.unpack_bits(spark, F.col("p_model_state")).alias("p"))
    same = F.when((F.size("r") != F.size("m")) | (F.size("r") != F.size("p")), F.raise_error(F.lit("streams of basecall events have different sizes"))).otherwise(F.lit(True))
    each = plain.where(same).select(*keys, F.element_at("params", F.lit("num_bits")).cast("int").alias("__bits"), F.posexplode(F.arrays_zip("r", "m", "p")).alias("event_idx", "z"))
    events = each.select(*keys, "event_idx", F.col("z.r").alias("rel_skip"), F.col("z.m").alias("move"), (F.col("z.p") / F.shiftleft(F.lit(1), 0) / F.pow(F.lit(2.0), F.col("__bits"))).alias("p"))
    return derive.unpack_basecall_events(events, bases, detected, keys, 0, rate, median_sd_temp, k)


def pack_alignment(entries: DataFrame, keys: list[str], codes: dict[str, Code] | None = None) -> DataFrame:
    """keys, n, template_start, complement_start, kmer_size, error and streams; ``entries`` has keys, idx, template_index, complement_index, kmer, sq."""
    codes, spark = codes or coders(), entries.sparkSession
    # merged: sizes of exploded rows and of functions' results are unknown to the planner, which would send them to the driver
    steps = derive.alignment_steps(entries, keys).join(derive.alignment_moves(entries, keys).hint("merge"), [*keys, "idx"])
    rows = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("idx", "template_step", "complement_step", F.coalesce("move", F.lit(0)).alias("move")))).alias("e"), F.coalesce(F.min("error"), F.min(F.when(~F.col("consistent"), "an alignment index jumps"))).alias("error"), F.length(F.min_by("kmer", "idx")).alias("kmer_size"))
    take = lambda c: F.transform("e", lambda x: x[c].cast("bigint"))
    return rows.join(derive.alignment_starts(entries, keys).hint("merge"), keys).select(*keys, F.size("e").cast("bigint").alias("n"), "template_start", "complement_start", "kmer_size", "error", codec.pack_bits(spark, take("template_step"), 1, 1).alias("template_step"), codec.pack_bits(spark, take("complement_step"), 1, 1).alias("complement_step"), codec.pack_huffman(spark, take("move"), codes["al_move"]).alias("move"))


def unpack_alignment(packed: DataFrame, bases: DataFrame, keys: list[str], codes: dict[str, Code] | None = None) -> DataFrame:
    """keys, idx, template_index, complement_index, kmer."""
    codes, spark = codes or coders(), packed.sparkSession
    plain = packed.select(*keys, "template_start", "complement_start", "kmer_size", codec.unpack_bits(spark, F.col("template_step")).alias("t"), codec.unpack_bits(spark, F.col("complement_step")).alias("c"), codec.unpack_huffman(spark, F.col("move"), codes["al_move"]).alias("m"))
    same = F.when((F.size("t") != F.size("m")) | (F.size("c") != F.size("m")), F.raise_error(F.lit("streams of an alignment have different sizes"))).otherwise(F.lit(True))
    each = plain.where(same).select(*keys, "template_start", "complement_start", "kmer_size", F.posexplode(F.arrays_zip("t", "c", "m")).alias("idx", "z"))
    steps = each.select(*keys, "template_start", "complement_start", "kmer_size", "idx", F.col("z.t").alias("template_step"), F.col("z.c").alias("complement_step"), F.col("z.m").alias("move"))
    placed = derive.alignment_indices(steps, keys, F.col("template_start"), F.col("complement_start")).withColumn("__pos", F.sum("move").over(derive.so_far(keys, ["idx"])))
    return placed.join(bases.hint("merge"), keys).select(*keys, "idx", "template_index", "complement_index", expr.kmer_at(F.col("sq"), F.col("__pos"), F.col("kmer_size")).alias("kmer"))


# checks and policies -------------------------------------------------------------
def mismatches(rows: DataFrame, again: DataFrame, keys: list[str], order: list[str], within: dict[str, float], equal: tuple[str, ...] = (), skip_last: bool = False) -> DataFrame:
    """keys, n, mismatches: rows that differ by more than ``within``, or at all in ``equal``; rows of one side alone count too."""
    columns = [*within, *equal]
    a = rows.select(*keys, *order, *(F.col(c).alias(f"__a_{c}") for c in columns), F.lit(True).alias("__a"))
    b = again.select(*keys, *order, *(F.col(c).alias(f"__b_{c}") for c in columns), F.lit(True).alias("__b"))
    bad = F.col("__a").isNull() | F.col("__b").isNull()
    for c, most in within.items():
        bad = bad | F.coalesce(F.abs(F.col(f"__a_{c}") - F.col(f"__b_{c}")) > most, F.lit(False))
    for c in equal:
        bad = bad | ~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))
    if skip_last:
        a = a.withColumn("__last", F.row_number().over(derive.over(keys, order)) == F.count("*").over(derive.Window.partitionBy(*keys)))
        bad = bad & ~F.coalesce("__last", F.lit(False))
    return a.join(b, [*keys, *order], "full").groupBy(*keys).agg(F.count("*").alias("n"), F.sum(bad.cast("bigint")).alias("mismatches"))


def by_policy(policy: int, unpacked: DataFrame, packed: DataFrame | None, keys: list[str], encode, decode) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(unpacked rows to write, packed rows to write, packed rows to count).

    Packing prefers the packed form of a read that has both, copying the unpacked
    one. ``packed`` may be left out where there are no packed rows.
    """
    if policy == DROP:
        return None, None, None
    if policy == PACK:
        made = encode(unpacked if packed is None else unpacked.join(packed.select(*keys).distinct(), keys, "left_anti"))
        return None, made if packed is None else packed.unionByName(made, allowMissingColumns=True), made
    if packed is None:
        return unpacked, None, None
    rest = packed.join(unpacked.select(*keys).distinct(), keys, "left_anti")
    if policy == UNPACK:
        return unpacked.unionByName(decode(rest), allowMissingColumns=True), None, None
    return unpacked, rest, None


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose structs differ, or that one side lacks: equality is that of all members, NaN equal to itself."""
    rest = [c for c in a.columns if c not in keys]
    left, right = (df.select(*keys, F.struct(*rest).alias(name)) for df, name in ((a, "__a"), (b, "__b")))
    return left.join(right, keys, "full").where("NOT __a <=> __b").select(*keys)


def by_metrichor(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Only rows of groups whose events can be packed; the others are dropped."""
    return rows.join(groups.where("name = 'metrichor'").select("file_id", "gr"), ["file_id", "gr"], "left_semi")


def run(raw: DataFrame, detected: DataFrame, fastq: DataFrame, options: Options = Options(), packed: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Packs, unpacks or copies the three tables that need no basecall group: the written tables, ``errors`` and ``counts``.

    ``raw``: file_id, rn, signal, offset, digitisation, range, start_time, and
    perhaps rate; ``detected``: file_id, gr, rn, event_idx, start, length, mean,
    stdv, start_time; ``fastq``: file_id, gr, st, fq. ``packed`` holds rows that are
    packed already, by the same names: with the stream raw for signal; file_id, gr,
    rn, start_time, skip, len; read_name, bp, qv for fq. They pass through packing
    and copying as they are, uncounted, and are decoded by unpacking. Each kind's
    rows are in ``raw``, ``detected`` and ``fastq``, all of one form; only copying
    leaves two, the packed ones in ``raw_packed``, ``detected_packed`` and
    ``fastq_packed``. Events packed while the signal is dropped could never be
    unpacked, which is an error here rather than a failed check.
    """
    if options.policy("ed") == PACK and options.policy("rw") == DROP:
        raise ValueError("detected events can't be packed while raw samples are dropped")
    spark, codes, out, errors, counts = raw.sparkSession, options.codes, {}, [], []
    rk, ek, fk = ["file_id", "rn"], ["file_id", "gr", "rn"], ["file_id", "gr", "st"]
    have = packed or {}

    def settle(kind, name, unpacked, keys, encode, decode):
        forms = by_policy(options.policy(kind), unpacked, have.get(name), keys, encode, decode)
        own = name if forms[0] is None else f"{name}_packed"
        out.update({n: df for n, df in ((name, forms[0]), (own, forms[1])) if df is not None})
        return forms[2]

    made = settle("rw", "raw", raw, rk, lambda rows: pack_raw(rows, codes["rw"]), lambda rows: unpack_raw(rows, codes["rw"]))
    if made is not None:
        size = F.element_at("raw.params", F.lit("size")).cast("bigint")
        seconds = [(size / F.col("rate")).alias("rs_total_duration")] if "rate" in raw.columns else []
        counts.append(made.select(size.alias("rs_count"), codec.stream_bits(F.col("raw")).alias("rs_bits"), *seconds))
        if options.check:
            again = unpack_raw(made, codes["rw"]).select(*rk, F.col("signal").alias("again"))
            errors.append(raw.join(again, rk).where("NOT signal <=> again").select("file_id", F.lit("raw samples differ").alias("error")))

    def currents():
        """The samples in picoampere of every read, of both storage forms."""
        every = raw if "raw" not in have else raw.unionByName(unpack_raw(have["raw"].join(raw.select(*rk), rk, "left_anti"), codes["rw"]), allowMissingColumns=True)
        current = F.transform("signal", lambda s: expr.to_current(s, F.col("digitisation"), F.col("offset"), F.col("range")))
        return every.select(*rk, current.alias("signal"), F.col("start_time").alias("rs_start"))

    def pack_ed(rows):
        t0 = rows.groupBy(*ek).agg(F.min("start_time").alias("start_time"))
        return pack_detected(rows, ek, F.col("start_time"), codes).join(t0, ek)

    def unpack_ed(rows):
        return unpack_detected(rows.select(*ek, "skip", "len", "start_time"), rows.select(*ek).join(currents(), rk), ek, codes)

    made = settle("ed", "detected", detected, ek, pack_ed, unpack_ed)
    if made is not None:
        counts.append(made.select(F.col("n").alias("ed_count"), codec.stream_bits(F.col("skip")).alias("ed_skip_bits"), codec.stream_bits(F.col("len")).alias("ed_len_bits")))
        if options.check:
            kept = detected.join(made.select(*ek), ek, "left_semi")
            bad = mismatches(kept, unpack_ed(made), ek, ["event_idx"], TOLERANCE["ed"], ("start", "length"), skip_last=True)
            errors.append(bad.where("mismatches > 0").select("file_id", F.lit("detected events differ").alias("error")))

    made = settle("fq", "fastq", fastq, fk, lambda rows: pack_fastq(rows, options.qv_bits, codes), lambda rows: unpack_fastq(rows, codes))
    if made is not None:
        # one group stands for the bases of a file: its first with a strand 0
        first = fastq.where("st = 0").groupBy("file_id").agg(F.min("gr").alias("gr"), F.lit(True).alias("stands"))
        stands = F.coalesce(F.col("stands"), F.lit(False)) & (F.col("st") == 0)
        counts.append(made.join(first, ["file_id", "gr"], "left").select(F.col("n").alias("fq_count"), codec.stream_bits(F.col("bp")).alias("fq_bp_bits"), codec.stream_bits(F.col("qv")).alias("fq_qv_bits"), F.when(stands, F.col("n")).otherwise(0).alias("bp_seq_count")))
        if options.check:
            a = fastq.select(*fk, expr.split_fastq(F.col("fq")).alias("a"))
            b = unpack_fastq(made, codes).select(*fk, expr.split_fastq(F.col("fq")).alias("b"))
            masked = F.transform(F.filter(F.split("a.quality", ""), lambda x: x != ""), lambda c: F.chr(expr.masked_quality(c, options.qv_bits) + 33))
            differs = (F.col("a.name") != F.col("b.name")) | (F.col("a.bases") != F.col("b.bases")) | (F.array_join(masked, "") != F.col("b.quality"))
            errors.append(a.join(b, fk).where(differs).select("file_id", F.lit("fastq differs").alias("error")))
    failed = _union(spark.createDataFrame([], "file_id string, error string"), [e.select(F.col("file_id").cast("string").alias("file_id"), "error") for e in errors])
    every = _union(spark.createDataFrame([], "rs_count bigint"), counts)
    return out | {"errors": failed.distinct(), "counts": aggregates.total_counts(every)}


def run_basecalls(events: DataFrame, alignments: DataFrame, groups: DataFrame, detected: DataFrame, options: Options = Options(), k: int = 5) -> dict[str, DataFrame]:
    """The same for basecall events and alignments of groups by metrichor; those of others are dropped, with a row in ``warnings``.

    ``events``: file_id, gr, st, event_idx, start, length, mean, stdv, move,
    model_state, p_model_state, sq, rate, median_sd_temp; ``alignments``:
    file_id, gr, idx, template_index, complement_index, kmer, sq; ``groups``:
    file_id, gr, name; ``detected``: the detected events of each group's link, as
    file_id, gr, st, event_idx, start, length, mean, stdv. Reads that can't be
    packed or don't come back are rows of ``errors``.
    """
    spark, ev, al = events.sparkSession, ["file_id", "gr", "st"], ["file_id", "gr"]
    out, errors, counts, warnings = {}, [], [], []
    others = groups.where("name IS NULL OR name != 'metrichor'").select("file_id", "gr")
    if options.policy("ev") == PACK:
        own = by_metrichor(events, groups)
        warnings.append(events.join(others, al, "left_semi").select("file_id", "gr", F.lit("events dropped").alias("warning")))
        rates = own.groupBy(*ev).agg(F.first("rate").alias("rate"), F.first("median_sd_temp").alias("median_sd_temp"))
        packed = pack_basecall(own, ev, F.col("rate"), detected, options.p_model_state_bits, options.codes).join(rates, ev)
        good = packed.where("error IS NULL")
        out["events"] = good
        errors.append(packed.where("error IS NOT NULL").select("file_id", "error"))
        counts.append(good.select(F.col("n").alias("ev_count"), codec.stream_bits(F.col("rel_skip")).alias("ev_rel_skip_bits"), codec.stream_bits(F.col("move")).alias("ev_move_bits"), codec.stream_bits(F.col("p_model_state")).alias("ev_p_model_state_bits")))
        if options.check:
            again = unpack_basecall(good, own.select(*ev, "sq").distinct(), detected.join(rates, ev), ev, F.lit(1.0), F.lit(float("nan")), k, options.codes).join(rates, ev)
            again = again.withColumns({"start": F.col("start") / F.col("rate"), "length": F.col("length") / F.col("rate"), "stdv": F.when(F.isnan("stdv"), F.lit(None)).otherwise(F.col("stdv"))})
            kept = own.join(good.select(*ev), ev, "left_semi")
            bad = mismatches(kept, again, ev, ["event_idx"], TOLERANCE["ev"], ("model_state",))
            errors.append(bad.where("mismatches > 0").select("file_id", F.lit("basecall events differ").alias("error")))
    elif options.policy("ev") != DROP:
        out["events"] = events
    if options.policy("al") == PACK:
        own = by_metrichor(alignments, groups)
        warnings.append(alignments.join(others, al, "left_semi").select("file_id", "gr", F.lit("alignment dropped").alias("warning")))
        packed = pack_alignment(own, al, options.codes)
        good = packed.where("error IS NULL")
        out["alignments"] = good
        errors.append(packed.where("error IS NOT NULL").select("file_id", "error"))
        counts.append(good.select(F.col("n").alias("al_count"), codec.stream_bits(F.col("template_step")).alias("al_template_step_bits"), codec.stream_bits(F.col("complement_step")).alias("al_complement_step_bits"), codec.stream_bits(F.col("move")).alias("al_move_bits")))
        if options.check:
            again = unpack_alignment(good, own.select(*al, "sq").distinct(), al, options.codes)
            bad = mismatches(own.join(good.select(*al), al, "left_semi"), again, al, ["idx"], {}, ("template_index", "complement_index", "kmer"))
            errors.append(bad.where("mismatches > 0").select("file_id", F.lit("alignment differs").alias("error")))
    elif options.policy("al") != DROP:
        out["alignments"] = alignments
    union = lambda parts, empty: _union(spark.createDataFrame([], empty), parts)
    return out | {"errors": union(errors, "file_id string, error string").distinct(), "warnings": union(warnings, "file_id string, gr string, warning string").distinct(), "counts": aggregates.total_counts(union(counts, "ev_count bigint"))}


def _union(first: DataFrame, parts: list[DataFrame]) -> DataFrame:
    for p in parts:
        first = first.unionByName(p, allowMissingColumns=True)
    return first
