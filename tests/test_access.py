"""The accessors and the command line on built files, and packing of basecalls."""

import pytest
from pyspark.sql import functions as F

from porelight import cli
from porelight.functions import codec
from porelight.functions.codewords import coders
from porelight.operators import packing
from porelight.operators.access import Reads
from porelight.sources import reads


@pytest.fixture(scope="module")
def opened(spark, tmp_path_factory):
    """Read r1 unpacked, r2 packed; events of r1 packed; group 000 with strand 0, group 001 2D with a link to 000."""
    folder = tmp_path_factory.mktemp("files")
    codes, signal = coders(), [500, 501, 499, 700, 700, 702]
    pack = lambda v, c: codec.huffman_encode(v, codes[c])
    stream = lambda path, name, p: {"obj_path": path, "stream": name, "bytes": p[0], "params": p[1]}
    params = {"read_id": "x", "read_number": 1, "start_mux": 1, "start_time": 100, "duration": 6}
    ed = "/Analyses/EventDetection_000/Reads/r1/Events_Pack"
    fq = "/Analyses/Basecall_000/BaseCalled_template/Fastq_Pack"
    attr = lambda p, n, v, t="string": {"obj_path": p, "name": n, "type_class": t, "value": v}
    data = reads.build_file(
        read_file={"file_version": "0.6", "channel": {"channel_number": "7", "digitisation": 8192.0, "offset": 10.0, "range": 1400.0, "sampling_rate": 4000.0}, "tracking": {"device_id": "d"}, "context": {"k": "v"}},
        raw=[{"rn": "r1", "signal": signal, "params": params}, {"rn": "r2", "signal": None, "params": params}],
        streams=[stream("/Raw/Reads/r2/Signal_Pack", "Signal", pack(signal, "rw")), stream(ed, "Skip", pack([0, 0], "ed_skip")), stream(ed, "Len", pack([3, 3], "ed_len")), stream(fq, "BP", pack([65, 67], "fq_bp")), stream(fq, "QV", pack([10, 31], "fq_qv"))],
        attrs=[attr(f"{ed}/params", "start_time", "100", "int"), attr(fq, "read_name", "n1"), attr("/Analyses/Basecall_000", "name", "ONT Sequencing Workflow"), attr("/Analyses/Basecall_000", "event_detection", "Analyses/EventDetection_000"), attr("/Analyses/Basecall_001", "basecall_1d", "Analyses/Basecall_000"), attr("/Analyses/Basecall_001/BaseCalled_2D", "x", "y"), attr("/Analyses/Basecall_001/Summary/a", "b", "c")],
        bc_event=[{"gr": "000", "st": 0, "event_idx": k, "mean": 1.0, "stdv": 1.0, "start": 0.025, "length": 0.01, "p_model_state": 0.5, "move": 0, "model_state": "ACGTA"} for k in range(2)],
        model=[{"gr": "000", "st": 0, "state_idx": 0, "level_mean": 1.0, "level_stdv": 1.0, "sd_mean": 1.0, "sd_stdv": 1.0, "kmer": "ACGTA"}],
    )
    (folder / "a.h5").write_bytes(data)
    return Reads.open(spark, [str(folder)]), str(folder)


def test_accessors(opened):
    r, _ = opened
    assert r.file_version().first().file_version == "0.6" and r.sampling_rate().first().sampling_rate == 4000.0 and r.channel().first().have_channel
    assert r.attributes_of("tracking").first().params == {"device_id": "d"} and r.attributes_of("sequences").count() == 0
    assert [(x.rn, x.packed) for x in r.raw_read_names().collect()] == [("r1", False), ("r2", True)]
    assert r.have_raw("r2").count() == 1 and r.have_raw("r9").count() == 0
    assert r.raw_int_samples().first().signal == r.raw_int_samples("r2").first().signal == [500, 501, 499, 700, 700, 702]
    assert r.raw_samples().first().signal[0] == pytest.approx(510 * 1400 / 8192) and r.raw_params("r2").first().params.duration == 6
    assert [x.gr for x in r.ed_groups().collect()] == ["000"] and r.ed_read_names().first().packed
    events = r.ed_events().orderBy("event_idx").collect()
    assert [(e.start, e.length) for e in events] == [(100, 3), (103, 3)] and events[0].mean == pytest.approx(510 * 1400 / 8192, rel=1e-6)
    assert r.ed_events_params().first().params.abasic_found == 2
    groups = {g.gr: g for g in r.bc_groups().collect()}
    assert (groups["000"].name, groups["000"].ed_gr, groups["001"].bc_1d_gr, groups["001"].ed_gr) == ("metrichor", "000", "000", "")
    assert [g.gr for g in r.bc_strand_groups(2).collect()] == ["001"] and r.description("000").first().have_events
    assert r.fastq(0).first().fq == "@n1\nAC\n+\n+@\n" and r.bases(0).first().sq == "AC"
    assert r.bc_column("summary", "001").first().summary == {"a/b": "c"}
    assert r.events(0, "001").count() == 2 and r.events(0).count() == 2 and r.model(0).count() == 1 and r.alignment().count() == 0
    assert r.have("fastq", 0).count() == 1 and r.have("alignment").count() == 0 and set(r.packs("Events_Pack").first().streams) == {"Skip", "Len"}


def test_command_line(spark, opened, capsys, tmp_path):
    _, folder = opened
    say = lambda *argv: (cli.main([*argv], spark), capsys.readouterr().out.splitlines())[1]
    out = say("ls", folder)
    assert {"cid/channel_number\t7", "rs/r1/packed\t0", "bc/000/id\tmetrichor:?+?", "ed/000/r1/packed\t1"} <= set(out)
    assert say("dump", folder, "--rw", "--curr-int", "--rw-time")[:2] == ["start\tcurr_i", "100\t500"]
    assert say("dump", folder, "--fq")[0].startswith("@n1") and "rw\tr2" in say("dump", folder)
    assert say("dump", folder, "--ev", "--time-int")[1].startswith("100\t40\t")
    assert len(say("train", folder, "fq-qv")) in (0, 33)
    code = cli.main(["pack", folder, "--output", str(tmp_path / "p"), "--ed", "drop"], spark)
    out = capsys.readouterr().out
    assert code == 0 and "rs_count\t6.0" in out and "processed_files\t1" in out
    packed = spark.read.parquet(str(tmp_path / "p" / "raw"))
    assert sorted(x.rn for x in packed.collect()) == ["r1", "r2"] and spark.read.parquet(str(tmp_path / "p" / "fastq")).count() == 1
    assert len({bytes(x.raw.bytes) for x in packed.collect()}) == 1  # the read that was packed before passes through
    assert cli.main(["pack", folder, "--output", str(tmp_path / "u"), "--preset", "unpack"], spark) == 0
    assert {tuple(x.signal) for x in spark.read.parquet(str(tmp_path / "u" / "raw")).collect()} == {(500, 501, 499, 700, 700, 702)} and spark.read.parquet(str(tmp_path / "u" / "raw")).count() == 2
    assert [x.fq for x in spark.read.parquet(str(tmp_path / "u" / "fastq")).collect()] == ["@n1\nAC\n+\n+@\n"]
    assert spark.read.parquet(str(tmp_path / "u" / "detected")).count() == 2
    assert cli.main(["pack", folder, "--output", str(tmp_path / "c"), "--rw", "copy", "--ed", "copy", "--fq", "copy"], spark) == 0
    assert [spark.read.parquet(str(tmp_path / "c" / n)).count() for n in ("raw", "raw_packed", "detected_packed", "fastq_packed")] == [1, 1, 1, 1]


def test_basecalls(spark):
    sq, k, rate = "ACGTACGGTAC", 5, 4000.0
    moves, picks, pos, rows = [0, 1, 2, 1, 2], [0, 1, 3, 4, 6], 0, []
    ed = spark.createDataFrame([(f, "000", 0, i, 10 + 5 * i, 5, 50.0 + i, 1.0) for f in ("a", "b") for i in range(8)], "file_id string, gr string, st int, event_idx int, start bigint, length bigint, mean double, stdv double")
    for i, (j, m) in enumerate(zip(picks, moves)):
        pos += m
        rows.append((i, (10 + 5 * j + 0.5) / rate, 5.5 / rate, 50.0 + j, 1.0, m, sq[pos : pos + k], 0.5, sq, rate, 0.7))
    ddl = "file_id string, gr string, st int, event_idx int, start double, length double, mean double, stdv double, move bigint, model_state string, p_model_state double, sq string, rate double, median_sd_temp double"
    ev = spark.createDataFrame([(f, "000", 0, *r) for f in ("a", "b") for r in rows], ddl)
    al = spark.createDataFrame([("a", "000", 0, 4, 9, "ACGTA", sq), ("a", "000", 1, 5, -1, "CGTAC", sq), ("b", "000", 0, 4, 9, "ACGTA", sq)], "file_id string, gr string, idx int, template_index bigint, complement_index bigint, kmer string, sq string")
    groups = spark.createDataFrame([("a", "000", "metrichor"), ("b", "000", "?")], "file_id string, gr string, name string")
    out = packing.run_basecalls(ev, al, groups, ed, k=k)
    assert out["errors"].count() == 0 and {(w.file_id, w.warning) for w in out["warnings"].collect()} == {("b", "events dropped"), ("b", "alignment dropped")}
    counts = out["counts"].first()
    assert (counts.ev_count, counts.al_count) == (5, 2) and counts.ev_move_bits > 0
    wrong = ev.withColumn("mean", F.col("mean") + F.when(F.col("event_idx") == 1, 3).otherwise(0))
    assert [e.error for e in packing.run_basecalls(wrong, al, groups, ed, k=k)["errors"].collect()] == ["basecall events differ"]
    late = ev.withColumn("start", F.col("start") + 1)
    assert [e.error for e in packing.run_basecalls(late, al, groups, ed, k=k)["errors"].collect()] == ["no detected event is left"]
