"""Columns that can be recomputed from other tables: what packing drops and unpacking rebuilds.

Every window is over one read (``keys``) in the order of an index, so rows of
different reads never meet and a task holds one read at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from porelight.functions import expr
from porelight.functions.codewords import Code
from porelight.runtime import ship_package


def over(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


#: Rows of a task, about, of tables that are dealt out by ``dealt``.
DEALT_ROWS = 500_000


def dealt(rows: DataFrame, keys: list[str], each: int = DEALT_ROWS) -> DataFrame:
    """Rows dealt out by read to tasks of about ``each`` rows, however many there are in all; windows over the keys stay in these tasks."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
    return rows.repartition(tasks, *keys)


def before(keys, order):
    return over(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def so_far(keys, order):
    return over(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def start_to_skip(events: DataFrame, keys: list[str], order: list[str], t0: Column, start: str = "start", length: str = "length") -> DataFrame:
    """Adds skip, the samples between an event and the end of the one before (of the first: ``t0``), and len."""
    end = F.lag(F.col(start) + F.col(length)).over(over(keys, order))
    return events.withColumns({"skip": F.col(start) - F.coalesce(end, t0), "len": F.col(length)})


def skip_to_start(events: DataFrame, keys: list[str], order: list[str], t0: Column, skip: str = "skip", length: str = "len") -> DataFrame:
    """The inverse: adds start."""
    ahead = F.coalesce(F.sum(length).over(before(keys, order)), F.lit(0))
    return events.withColumn("start", t0 + F.sum(skip).over(so_far(keys, order)) + ahead)


def _mean_stdv(n: Column, s: Column, s2: Column, least: Column, most: Column) -> tuple[Column, Column]:
    x = (s2 - s * s / n) / n
    return s / n, F.when((n > 1) & (least != most) & (x > 1e-3), F.sqrt(x)).otherwise(0.0)


def event_stats(events: DataFrame, samples: DataFrame, keys: list[str], start: str = "start", length: str = "length", sample_idx: str = "sample_idx", sample: str = "sample") -> DataFrame:
    """Mean and population stdv of each event's samples, from one row per sample.

    Each event is exploded to the indexes it covers, so that the join is on
    equal keys instead of a range.
    """
    index = [c for c in events.columns]
    covered = events.withColumn(sample_idx, F.explode(F.sequence(F.col(start), F.col(start) + F.col(length) - 1)))
    joined = covered.join(samples.select(*keys, sample_idx, F.col(sample).cast("double").alias("__x")), [*keys, sample_idx])
    sums = joined.groupBy(*index).agg(F.count("*").alias("n"), F.sum("__x").alias("__s"), F.sum(F.col("__x") * F.col("__x")).alias("__s2"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    mean, stdv = _mean_stdv(*(F.col(c) for c in ("n", "__s", "__s2", "__lo", "__hi")))
    return sums.select(*index, "n", mean.alias("mean"), stdv.alias("stdv"))


def event_stats_array(signal: Column, start: Column, length: Column) -> Column:
    """(mean, stdv) of ``signal[start : start + length]``, summed in order; null if that is empty or outside."""
    part = F.when((start >= 0) & (length > 0) & (start + length <= F.size(signal)), F.slice(signal, (start + 1).cast("int"), length.cast("int")))
    x = F.transform(part, lambda v: v.cast("double"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("s2"))
    sums = F.aggregate(x, zero, lambda a, v: F.struct((a["s"] + v).alias("s"), (a["s2"] + v * v).alias("s2")))
    mean, stdv = _mean_stdv(F.size(x).cast("double"), sums["s"], sums["s2"], F.array_min(x), F.array_max(x))
    return F.when(part.isNotNull(), F.struct(mean.alias("mean"), stdv.alias("stdv")))


def clamp_events(events: DataFrame, keys: list[str], order: list[str], signal_size: Column, first_sample: Column) -> DataFrame:
    """Adds lo and hi, sample places of the event; the first event's start and the last one's end are clamped to the signal."""
    place, size = F.row_number().over(over(keys, order)), F.count("*").over(Window.partitionBy(*keys))
    lo = F.col("start") - first_sample
    hi = lo + F.col("length")
    return events.withColumns({"lo": F.when((place == 1) & (lo < 0), 0).otherwise(lo), "hi": F.when((place == size) & (hi > signal_size), signal_size).otherwise(hi)})


def event_starts(spark, start: Column, skip: Column, length: Column) -> Column:
    """Starts of the events of a read from the arrays of its skips and lengths: running sums, one Arrow function per batch of reads."""
    ship_package(spark)

    @F.pandas_udf("array<bigint>")
    def starts(t: pd.Series, skips: pd.Series, lengths: pd.Series) -> pd.Series:
        def of(t0, s, n):
            s, n = np.asarray(s, np.int64), np.asarray(n, np.int64)
            return t0 + np.cumsum(s + n) - n

        return pd.Series([None if s is None or n is None else of(t0, s, n) for t0, s, n in zip(t, skips, lengths)])

    return starts(start, skip, length)


def unpack_events(packed: DataFrame, reads: DataFrame, keys: list[str]) -> DataFrame:
    """Detected events from (skip, len) arrays and the signal: keys, event_idx, start, length, mean, stdv.

    ``packed`` has keys, skip, len, start_time; ``reads`` has keys, signal
    (floats), rs_start. Arrays of unequal size and events outside of the signal
    are errors. One row per read throughout: nothing is exploded but the result.
    """
    joined = packed.join(reads, keys, "left")
    sized = F.when(F.size("skip") != F.size("len"), F.raise_error(F.lit("skip and len have different sizes"))).when(F.col("signal").isNull(), F.raise_error(F.lit("events need the raw samples of their read"))).otherwise(F.lit(True))
    starts = event_starts(packed.sparkSession, F.col("start_time").cast("bigint"), F.col("skip"), F.col("len"))
    timed = joined.where(sized).select(*keys, "signal", "rs_start", "len", starts.alias("starts"))
    rows = timed.select(*keys, "signal", "rs_start", F.zip_with("starts", "len", lambda s, n: F.struct(s.alias("start"), n.alias("length"))).alias("ev"))
    n, size = F.size("ev"), F.size("signal")

    def stats(e, i):
        lo = e["start"] - F.col("rs_start")
        hi = lo + e["length"]
        lo, hi = F.when((i == 0) & (lo < 0), 0).otherwise(lo), F.when((i == n - 1) & (hi > size), size).otherwise(hi)
        found = event_stats_array(F.col("signal"), lo, hi - lo)
        return F.struct(i.alias("event_idx"), e["start"].alias("start"), e["length"].alias("length"), F.coalesce(found, F.raise_error(F.lit("event outside of the signal")).cast("struct<mean:double,stdv:double>")).alias("m"))

    each = rows.select(*keys, F.explode(F.transform("ev", stats)).alias("e"))
    return each.select(*keys, "e.event_idx", "e.start", "e.length", "e.m.mean", "e.m.stdv")


def asof_forward(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, left_time: str, right_order: str, right_time: str) -> DataFrame:
    """For each left row in order, the first right row not used yet at its time or later: adds j and rel_skip.

    With right rows sorted by time, the candidate is the least index at the time
    or later, found by one sort of both tables together; using each row once
    pushes it up to ``i + max(candidate - i)`` over the rows so far. j is null
    where no row is left. The last right row is found in the same sort: each table
    is read once, and a task sorts its rows twice.
    """
    nulls = lambda df, cs: [F.lit(None).cast(df.schema[c].dataType).alias(f"__l_{c}") for c in cs]
    rest = [c for c in left.columns if c not in keys]
    a = left.select(*keys, *(F.col(c).alias(f"__l_{c}") for c in rest), F.col(left_time).cast("bigint").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast("bigint").alias("__j"))
    b = right.select(*keys, *nulls(left, rest), F.col(right_time).cast("bigint").alias("__t"), F.lit(1).alias("__side"), F.col(right_order).cast("bigint").alias("__j"))
    # backwards in time, so that the running minimum grows by one row at a time
    ahead = Window.partitionBy(*keys).orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("__c", F.min("__j").over(ahead)).withColumn("__last", F.max("__j").over(Window.partitionBy(*keys))).where("__side = 0")
    order = over(keys, [f"__l_{left_order}"])
    i = F.row_number().over(order) - 1
    placed = found.withColumn("__i", i).withColumn("__gone", F.max(F.col("__c").isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("j", F.when(F.col("__gone") == 0, F.col("__i") + F.max(F.col("__c") - F.col("__i")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    known = reduce(and_, (F.col(k).isNotNull() for k in keys))  # a key that is null is no other's
    capped = placed.withColumn("j", F.when(known & (F.col("j") <= F.col("__last")), F.col("j")))
    rel = F.col("j") - F.coalesce(F.lag("j").over(order), F.lit(-1)) - 1
    return capped.withColumn("rel_skip", rel).select(*keys, *(F.col(f"__l_{c}").alias(c) for c in rest), "j", "rel_skip")


def rel_skip_to_index(events: DataFrame, keys: list[str], order: list[str], rel_skip: str = "rel_skip") -> DataFrame:
    """Adds j, the index of the detected event that a basecall event was made from."""
    return events.withColumn("j", F.row_number().over(over(keys, order)) - 1 + F.sum(rel_skip).over(so_far(keys, order)))


def unpack_basecall_events(events: DataFrame, bases: DataFrame, detected: DataFrame, keys: list[str], bits: int, rate: Column, median_sd_temp: Column, k: int) -> DataFrame:
    """start, length, mean, stdv, model_state and p_model_state of packed basecall events.

    ``events`` has keys, event_idx, rel_skip, move, p (quantised); ``bases`` keys
    and sq; ``detected`` keys, event_idx, start, length, mean, stdv.
    """
    placed = rel_skip_to_index(events, keys, ["event_idx"])
    moved = placed.withColumn("pos", F.sum(F.when(F.col("event_idx") > 0, F.col("move")).otherwise(0)).over(so_far(keys, ["event_idx"])))
    ed = detected.select(*keys, F.col("event_idx").cast("bigint").alias("j"), F.col("start").alias("__s"), F.col("length").alias("__l"), "mean", F.col("stdv").alias("__sd"))
    full = moved.join(ed, [*keys, "j"]).join(bases, keys)
    return full.select(*keys, "event_idx", expr.time_to_float(F.col("__s"), rate).alias("start"), expr.time_to_float(F.col("__l"), rate).alias("length"), "mean", F.when(F.col("__sd") == 0, median_sd_temp).otherwise(F.col("__sd")).alias("stdv"), "move", expr.dequantise(F.col("p"), bits).alias("p_model_state"), expr.kmer_at(F.col("sq"), F.col("pos"), k).alias("model_state"))


def repair_moves(events: DataFrame, keys: list[str], sq: str = "sq", state: str = "model_state") -> DataFrame:
    """keys, event_idx, move, error: moves checked against the sequence and put right.

    A read whose moves all fit is settled by a running sum. Only the others go
    through a loop, for there each place depends on the one repaired before. A
    read that can't be repaired has null moves and an error.
    """
    w = over(keys, ["event_idx"])
    k = F.length(state)
    pos = F.sum("move").over(so_far(keys, ["event_idx"]))
    checked = events.withColumn("__pos", pos).withColumn("__fits", (expr.kmer_at(F.col(sq), F.col("__pos"), k) == F.col(state)) & F.col("move").between(0, 255) & (k == F.first(k).over(w)))
    ends = F.last("__pos").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + k == F.length(sq)
    good = checked.withColumn("__good", F.coalesce(F.min(F.col("__fits") & ends).over(Window.partitionBy(*keys)), F.lit(False)))
    fast = good.where("__good").select(*keys, "event_idx", F.col("move").cast("bigint").alias("move"), F.lit(None).cast("string").alias("error"))
    ship_package(events.sparkSession)
    schema = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in keys) + f", event_idx {events.schema['event_idx'].dataType.simpleString()}, move bigint, error string"

    def slow(read: pd.DataFrame) -> pd.DataFrame:
        read = read.sort_values("event_idx")
        moves, error = walk_moves(read[sq].iloc[0], read[state].tolist(), read["move"].tolist())
        return read[[*keys, "event_idx"]].assign(move=pd.array(moves if error is None else [None] * len(read), "Int64"), error=error)

    return fast.unionByName(good.where("NOT __good").select(*events.columns).groupBy(*keys).applyInPandas(slow, schema))


def walk_moves(sq: str, states: list[str], moves: list[int]) -> tuple[list[int], str | None]:
    """The moves that lead through the sequence, or why there are none."""
    pos, out, k = 0, [], len(states[0]) if states else 0
    for i, (state, move) in enumerate(zip(states, moves)):
        if len(state) != k:
            return out, f"event {i}: state {state} has not {k} bases"
        if not 0 <= move <= 255:
            return out, f"event {i}: invalid move {move}"
        if sq[pos + move : pos + move + k] != state:
            here = sq[pos : pos + k]
            at = sq.find(state, pos)
            if at < 0 or at > pos + k and len(set(here)) != 1:
                return out, f"event {i}: no move leads to {state}"
            move = at - pos
            if move > 255:
                return out, f"event {i}: move {move} does not fit a byte"
        out.append(move)
        pos += move
    return (out, None) if pos + k == len(sq) else (out, f"{len(sq) - pos - k} bases are left over")


def alignment_steps(entries: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """Adds template_step, complement_step (0 or 1) and consistent: indices step by +1 and -1 between gaps."""
    w = so_far(keys, [order])
    t, c = F.col("template_index"), F.col("complement_index")
    first = lambda x: F.first(F.when(x >= 0, x), ignorenulls=True).over(over(keys, [order]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    steps = entries.withColumns({"template_step": (t >= 0).cast("int"), "complement_step": (c >= 0).cast("int")})
    ok = ((t < 0) | (t == first(t) + F.sum("template_step").over(w) - 1)) & ((c < 0) | (c == first(c) - F.sum("complement_step").over(w) + 1))
    return steps.withColumn("consistent", ok)


def alignment_starts(entries: DataFrame, keys: list[str], order: str = "idx") -> DataFrame:
    """keys, template_start, complement_start; a strand without an entry is an error."""
    least = lambda c: F.min_by(c, F.when(F.col(c) >= 0, F.col(order)))
    found = entries.groupBy(*keys).agg(least("template_index").alias("template_start"), least("complement_index").alias("complement_start"), F.max("template_index").alias("__t"), F.max("complement_index").alias("__c"))
    return found.where(F.when((F.col("__t") < 0) | (F.col("__c") < 0), F.raise_error(F.lit("an alignment needs an entry of each strand"))).otherwise(F.lit(True))).drop("__t", "__c")


def alignment_moves(entries: DataFrame, keys: list[str], sq: str = "sq") -> DataFrame:
    """keys, idx, move, error: each k-mer is looked for at or after the place of the one before. Rows come in order, one read after the other."""
    ship_package(entries.sparkSession)
    columns = [*keys, "idx"]
    schema = ", ".join(f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in columns) + ", move bigint, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, text, pos, held, moves, error = None, None, 0, [], [], None  # of the read at hand: its rows by batch, what is found so far

        def done():
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                found = moves if error is None else [None] * rows.num_rows
                yield pa.RecordBatch.from_arrays([*(rows.column(c).chunk(0) for c in columns), pa.array(found, pa.int64()), pa.array([error] * rows.num_rows, pa.string())], [*columns, "move", "error"])

        for batch in batches:
            own = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            texts, kmers, begin, out_moves, out_errors = batch.column(sq), batch.column("kmer").to_pylist(), 0, [], []
            first = next((i for i, key in enumerate(own) if key != read), len(own))  # rows before it go on with the read of the last batch
            for i, (key, kmer) in enumerate(zip(own, kmers)):
                if key != read:
                    if i == first:
                        held.append(batch.select(columns).slice(0, i)) if i else None
                        yield from done()
                    else:
                        out_moves += moves if error is None else [None] * len(moves)
                        out_errors += [error] * len(moves)
                    read, text, pos, held, moves, error, begin = key, texts[i].as_py(), 0, [], [], None, i
                if error is None:
                    at = text.find(kmer, pos)
                    if at < 0 or at - pos > 127:
                        error = f"{kmer} is not found" if at < 0 else f"move {at - pos} does not fit"
                    else:
                        moves.append(at - pos)
                        pos = at
                        continue
                moves.append(None)
            if begin > first:
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, begin - first) for c in columns), pa.array(out_moves, pa.int64()), pa.array(out_errors, pa.string())], [*columns, "move", "error"])
            if len(own):
                held.append(batch.select(columns).slice(begin))
        yield from done()

    rows = entries.select(*columns, sq, "kmer").repartition(*keys).sortWithinPartitions(*columns)
    return rows.mapInArrow(run, schema)


def alignment_indices(steps: DataFrame, keys: list[str], template_start: Column, complement_start: Column, order: str = "idx") -> DataFrame:
    """Adds template_index and complement_index: the start and the steps before, -1 at a gap."""
    ran = lambda c: F.coalesce(F.sum(c).over(before(keys, [order])), F.lit(0))
    index = lambda c, start, sign: F.when(F.col(c) == 1, start + sign * ran(c)).otherwise(expr.GAP)
    return steps.withColumns({"template_index": index("template_step", template_start, 1), "complement_index": index("complement_step", complement_start, -1)})


def kmer_walk(events: DataFrame, keys: list[str], order: list[str], k: int, sq: str = "sq", move: str = "move") -> DataFrame:
    """Adds pos, the sum of the moves so far, and kmer, the bases there."""
    return events.withColumn("pos", F.sum(move).over(so_far(keys, order))).withColumn("kmer", expr.kmer_at(F.col(sq), F.col("pos"), k))


def packed_size(values: DataFrame, keys: list[str], order: list[str], value: str, code: Code) -> DataFrame:
    """keys, n, bytes: the size of the stream of each read's values without encoding them.

    The first value and each without a code begin a segment of a whole value and
    its codes, which end in an escape and are padded to bytes.
    """
    spark = values.sparkSession
    words = spark.createDataFrame([(s, n) for s, (_, n) in code.words.items()], "symbol bigint, len int")  # a few hundred rows
    w = over(keys, order)
    x = F.col(value) - F.lag(value).over(w) if code.diff else F.when(F.row_number().over(w) > 1, F.col(value))
    coded = values.select(*keys, *order, x.cast("bigint").alias("symbol")).join(F.broadcast(words), "symbol", "left")
    segment = coded.withColumn("segment", F.sum(F.col("len").isNull().cast("int")).over(so_far(keys, order)))
    sizes = segment.groupBy(*keys, "segment").agg(F.count("*").alias("n"), (code.width + F.ceil((F.coalesce(F.sum("len"), F.lit(0)) + code.escape[1]) / 8)).alias("bytes"))
    return sizes.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def bit_packed_bytes(n: Column, num_bits: int) -> Column:
    return F.ceil(n * num_bits / 8)
