"""Derivations: the cases of the format, and literal loops on random reads."""

import random

import pytest
from pyspark.sql import functions as F

from porelight.operators import aggregates, catalog, derive, packing

K = ["k"]


def test_skip_and_start(spark):
    ev = spark.createDataFrame([(1, 0, 100, 5), (1, 1, 105, 7), (1, 2, 115, 4)], "k int, event_idx int, start bigint, length bigint")
    packed = derive.start_to_skip(ev, K, ["event_idx"], F.lit(100)).orderBy("event_idx")
    assert [(r.skip, r.len) for r in packed.collect()] == [(0, 5), (0, 7), (3, 4)]
    again = derive.skip_to_start(packed.drop("start"), K, ["event_idx"], F.lit(100)).orderBy("event_idx")
    assert [r.start for r in again.collect()] == [100, 105, 115]


def test_stats(spark):
    signal = spark.createDataFrame([([1.0, 3.0, 7.0, 7.0, 7.0, 5.0],)], "s array<float>")
    at = lambda a, n: signal.select(derive.event_stats_array(F.col("s"), F.lit(a), F.lit(n)).alias("m")).first().m
    assert tuple(at(0, 2)) == (2.0, 1.0) and at(2, 3).stdv == 0 and at(5, 1).stdv == 0
    assert at(4, 3) is None and at(0, 0) is None and at(-1, 2) is None


def test_unpack_clamps_first_and_last(spark):
    reads = spark.createDataFrame([(1, [1.0, 3.0, 5.0, 9.0], 10)], "k int, signal array<float>, rs_start bigint")
    packed = spark.createDataFrame([(1, [0, 0], [3, 5], 9)], "k int, skip array<bigint>, len array<bigint>, start_time bigint")
    rows = derive.unpack_events(packed, reads, K).orderBy("event_idx").collect()
    assert [(r.start, r.length, r.mean) for r in rows] == [(9, 3, 2.0), (12, 5, 7.0)]
    for bad in ([(1, [0, 9, 0], [1, 1, 1], 10)], [(1, [0], [1, 1], 10)], [(2, [0], [1], 10)]):
        with pytest.raises(Exception):
            derive.unpack_events(spark.createDataFrame(bad, packed.schema), reads, K).collect()


def asof(ed, ev):
    j, out = -1, []
    for t in ev:
        last, j = j, j + 1
        while j < len(ed) and ed[j] < t:
            j += 1
        if j >= len(ed):
            out += [None] * (len(ev) - len(out))
            break
        out.append(j - last - 1)
    return out


def test_asof(spark):
    r = random.Random(3)
    cases = {0: ([10, 20, 30, 40], [10, 25, 26])} | {k: (sorted(r.sample(range(200), 20)), sorted(r.choices(range(180), k=r.randint(1, 12)))) for k in range(1, 40)}
    ed = spark.createDataFrame([(k, i, s) for k, (e, _) in cases.items() for i, s in enumerate(e)], "k int, event_idx int, start bigint")
    ev = spark.createDataFrame([(k, i, t) for k, (_, e) in cases.items() for i, t in enumerate(e)], "k int, i int, t bigint")
    got = {(x.k, x.i): x.rel_skip for x in derive.asof_forward(ev, ed, K, "i", "t", "event_idx", "start").collect()}
    for k, (e, times) in cases.items():
        assert [got[k, i] for i in range(len(times))] == asof(e, times), k


def test_asof_sorts_twice_and_joins_nothing(spark):
    ed = spark.createDataFrame([(1, 0, 10), (1, 1, 20), (None, 0, 10)], "k int, event_idx int, start bigint")
    ev = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (1, 2, 7), (2, 0, 5), (None, 0, 5)], "k int, i int, t bigint")
    found = derive.asof_forward(ev, ed, K, "i", "t", "event_idx", "start")
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and found._jdf.queryExecution().executedPlan().toString().count("Sort [") == 2
    got = {(x.k, x.i): (x.j, x.rel_skip) for x in found.collect()}
    assert got == {(1, 0): (0, 0), (1, 1): (1, 0), (1, 2): (None, None), (2, 0): (None, None), (None, 0): (None, None)}  # a key that is null is no other's


def test_moves(spark):
    rows = [(1, 0, 0, "ACG", "ACGTAC"), (1, 1, 1, "CGT", "ACGTAC"), (1, 2, 0, "CGT", "ACGTAC"), (1, 3, 2, "TAC", "ACGTAC")]
    rows += [(2, 0, 0, "ACG", "ACGTAC"), (2, 1, 2, "CGT", "ACGTAC"), (2, 2, 2, "TAC", "ACGTAC")]  # a move to repair
    rows += [(3, 0, 0, "ACG", "ACGTAC")]  # leftover bases
    ev = spark.createDataFrame(rows, "k int, event_idx int, move bigint, model_state string, sq string")
    got = {(r.k, r.event_idx): (r.move, r.error) for r in derive.repair_moves(ev, K).collect()}
    assert [got[1, i] for i in range(4)] == [(0, None), (1, None), (0, None), (2, None)]
    assert [got[2, i][0] for i in range(3)] == [0, 1, 2]
    assert got[3, 0][0] is None and "left over" in got[3, 0][1]
    assert "invalid move" in derive.walk_moves("ACGT", ["ACG"], [256])[1]
    assert "has not" in derive.walk_moves("ACGT", ["ACG", "CG"], [0, 1])[1]
    assert derive.walk_moves("AAACCC", ["AAA", "CCC"], [0, 9]) == ([0, 3], None)


def test_alignment(spark):
    entries = spark.createDataFrame([(1, 0, 4, 9, "ACG"), (1, 1, -1, 8, "ACG"), (1, 2, 5, -1, "CGT")], "k int, idx int, template_index bigint, complement_index bigint, kmer string").withColumn("sq", F.lit("ACGTAC"))
    packed = packing.pack_alignment(entries, K)
    assert packed.first().error is None
    again = packing.unpack_alignment(packed, entries.select("k", "sq").distinct(), K).orderBy("idx")
    assert [tuple(r)[1:] for r in again.collect()] == [(0, 4, 9, "ACG"), (1, -1, 8, "ACG"), (2, 5, -1, "CGT")]
    jump = entries.withColumn("template_index", F.when(F.col("idx") == 2, 7).otherwise(F.col("template_index")))
    assert "jumps" in packing.pack_alignment(jump, K).first().error
    with pytest.raises(Exception):
        packing.pack_alignment(entries.withColumn("template_index", F.lit(-1).cast("bigint")), K).collect()


def test_packed_size(spark):
    from porelight.functions import codec
    from porelight.functions.codewords import coders

    r, code = random.Random(1), coders()["rw"]
    reads = {k: [r.randint(-400, 400) if r.random() < 0.2 else r.randint(-30, 30) for _ in range(r.randint(1, 60))] for k in range(30)}
    df = spark.createDataFrame([(k, i, v) for k, vs in reads.items() for i, v in enumerate(vs)], "k int, i int, v bigint")
    got = {x.k: (x.n, x.bytes) for x in derive.packed_size(df, K, ["i"], "v", code).collect()}
    assert got == {k: (len(v), len(codec.huffman_encode(v, code)[0])) for k, v in reads.items()}


def test_basecall_round_trip(spark):
    sq, k, rate = "ACGTACGGT", 3, 4000.0
    ed = spark.createDataFrame([(1, i, 10 + 5 * i, 5, 50.0 + i, 1.0 if i else 0.0) for i in range(8)], "k int, event_idx int, start bigint, length bigint, mean double, stdv double")
    picks, moves, pos, rows = [0, 1, 3, 4, 5, 7], [0, 1, 1, 2, 1, 1], 0, []
    for i, (j, m) in enumerate(zip(picks, moves)):
        pos += m
        rows.append((1, i, (10 + 5 * j + 0.5) / rate, 5.5 / rate, m, sq[pos : pos + k], 0.5, sq))
    ev = spark.createDataFrame(rows, "k int, event_idx int, start double, length double, move bigint, model_state string, p_model_state double, sq string")
    packed = packing.pack_basecall(ev, K, F.lit(rate), ed)
    assert packed.first().error is None
    again = packing.unpack_basecall(packed, ev.select("k", "sq").distinct(), ed, K, F.lit(rate), F.lit(0.7), k).orderBy("event_idx").collect()
    assert [(r.model_state, r.move, r.p_model_state) for r in again] == [(r[5], r[4], 0.5) for r in rows]
    assert all(abs(a.start - r[2]) < 1e-3 for a, r in zip(again, rows)) and again[0].stdv == 0.7
    free = packing.pack_basecall(ev, K, F.lit(rate)).first()
    assert free.start_time == 10 and free.error is None and free.len["params"]["size"] == "6"


def test_job(spark):
    r = random.Random(5)
    signal = [r.randint(400, 700) for _ in range(60)]
    raw = spark.createDataFrame([("f", "r1", signal, 10.0, 8192.0, 1400.0, 100)], "file_id string, rn string, signal array<smallint>, offset double, digitisation double, range double, start_time bigint")
    current = [(s + 10.0) * 1400.0 / 8192.0 for s in signal]
    stat = lambda v: (sum(v) / len(v), (sum(x * x for x in v) / len(v) - (sum(v) / len(v)) ** 2) ** 0.5)
    ed = spark.createDataFrame([("f", "000", "r1", i, 100 + 10 * i, 10, *stat(current[10 * i : 10 * i + 10]), 100) for i in range(6)], "file_id string, gr string, rn string, event_idx int, start bigint, length bigint, mean double, stdv double, start_time bigint")
    fq = spark.createDataFrame([("f", "000", 0, "@n x\nACGTN\n+n\nI5!#$\n")], "file_id string, gr string, st int, fq string")
    out = packing.run(raw, ed, fq)
    assert out["errors"].count() == 0
    counts = out["counts"].first()
    assert (counts.rs_count, counts.ed_count, counts.fq_count, counts.bp_seq_count) == (60, 6, 5, 5) and counts.rs_bits > 0
    report = {x.key: x.value for x in aggregates.ratios(out["counts"]).collect()}
    assert report["rs_bits_per_value"] == counts.rs_bits / 60 and "ev_count" not in report
    wrong = ed.withColumn("mean", F.col("mean") + F.when(F.col("event_idx") == 2, 5).otherwise(0))
    assert [x.error for x in packing.run(raw, wrong, fq)["errors"].collect()] == ["detected events differ"]
    with pytest.raises(ValueError):
        packing.run(raw, ed, fq, packing.Options(policies={"rw": packing.DROP}))
    assert set(packing.run(raw, ed, fq, packing.Options("archive"))) == {"raw", "errors", "counts"}


def test_policies(spark):
    a, b = spark.createDataFrame([(1, "u"), (2, "u")], "k int, x string"), spark.createDataFrame([(2, "p"), (3, "p")], "k int, x string")
    mark = lambda m: lambda df: df.withColumn("x", F.concat("x", F.lit(m)))
    get = lambda df: None if df is None else sorted(map(tuple, df.collect()))
    run = lambda p: [get(x) for x in packing.by_policy(p, a, b, K, mark("e"), mark("d"))]
    assert run(packing.DROP) == [None, None, None]
    assert run(packing.PACK) == [None, [(1, "ue"), (2, "p"), (3, "p")], [(1, "ue")]]
    assert run(packing.UNPACK) == [[(1, "u"), (2, "u"), (3, "pd")], None, None]
    assert run(packing.COPY) == [[(1, "u"), (2, "u")], [(3, "p")], None]


def test_catalog(spark):
    link = spark.createDataFrame(
        [("f", "/", "Raw", 0, "group"), ("f", "/Raw", "Reads", 0, "group"), ("f", "/Raw/Reads", "r1", 0, "group"), ("f", "/Raw/Reads", "r2", 1, "group"), ("f", "/Raw/Reads", "r3", 2, "group"), ("f", "/Raw/Reads/r1", "Signal", 0, "dataset"), ("f", "/Raw/Reads/r2", "Signal_Pack", 0, "group"),
         ("f", "/Analyses", "EventDetection_000", 0, "group"), ("f", "/Analyses", "Basecall_000", 1, "group"), ("f", "/Analyses/Basecall_000", "BaseCalled_2D", 0, "group")],
        "file_id string, group_path string, name string, ord int, kind string")
    assert [(r.rn, r.packed) for r in catalog.raw_reads(link).orderBy("rn_ord").collect()] == [("r1", False), ("r2", True)]
    assert [r.gr for r in catalog.groups(link, "EventDetection_").collect()] == ["000"]
    attr = spark.createDataFrame([("f", "/a", "z", "int", "1"), ("f", "/a", "b", "string", "2"), ("f", "/a/c", "d", "float", "3")], "file_id string, obj_path string, name string, type_class string, value string")
    assert {r.obj_path: r.params for r in catalog.attribute_map(attr).collect()} == {"/a": {"b": "2", "z": "1"}, "/a/c": {"d": "3"}}
    assert catalog.attribute_tree(attr, "/a").first().params == {"b": "2", "c/d": "3", "z": "1"}
    assert sorted(r.obj_path for r in catalog.copy_attributes(attr, attr.limit(0), "/a", "/x", True).collect()) == ["/x", "/x", "/x/c"]
    with pytest.raises(Exception):
        catalog.copy_attributes(attr, attr, "/a", "/a").collect()
    probe = spark.createDataFrame([("f", p) for p in ("/", "/Raw", "/Raw/Reads/r1/Signal", "/a/z", "/nope")], "file_id string, path string")
    assert sorted(r.path for r in catalog.object_exists(probe, link).collect()) == ["/", "/Raw", "/Raw/Reads/r1/Signal"]
    assert sorted(r.path for r in catalog.exists(probe, link, attr).collect()) == ["/Raw/Reads/r1/Signal", "/a/z"]
    seg = spark.createDataFrame([("f", "000", "Analyses/Seg_0"), ("f", "001", "none")], "file_id string, gr string, target string")
    more = spark.createDataFrame([("f", "/Analyses/Seg_0/Summary/split_hairpin", "median_sd_temp", "float", "1.5")], attr.schema)
    assert {r.gr: r.median_sd_temp for r in catalog.median_sd_temp(seg, more).collect()} == {"000": 1.5, "001": 0.0}


def test_alignment_moves_across_batches(spark):
    """Reads longer and shorter than a batch of rows, with a k-mer that is not found in some; none is sent to the driver for its join."""
    n = 12_000
    rows = spark.range(3 * n).select((F.col("id") % 3).alias("rn"), F.floor(F.col("id") / 3).cast("int").alias("idx")).select("rn", "idx", F.when((F.col("rn") == 1) & (F.col("idx") == n - 1), "NN").otherwise("AA").alias("kmer"), F.expr("repeat('A', 40)").alias("sq"))
    found = derive.alignment_moves(rows, ["rn"]).groupBy("rn").agg(F.count("*").alias("n"), F.sum("move").alias("moves"), F.min("error").alias("error"), F.countDistinct("idx").alias("i")).orderBy("rn").collect()
    assert [tuple(r) for r in found] == [(0, n, 0, None, n), (1, n, None, "NN is not found", n), (2, n, 0, None, n)]
    entries = rows.where("rn != 1").withColumns({"template_index": F.col("idx").cast("bigint"), "complement_index": (n - F.col("idx")).cast("bigint")})
    assert "BroadcastHashJoin" not in packing.pack_alignment(entries, ["rn"])._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_rows(spark):
    own = [derive.dealt(spark.range(n).withColumn("k", F.col("id") % 7), K, 10).rdd.getNumPartitions() for n in (1_000, 2_000)]
    assert own == [100, 200]
