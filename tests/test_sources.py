"""Read files: the type matrix, the mini group, damaged files, and the way there and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from porelight.operators import report
from porelight.sources import reads
from porelight.sources.hdf5_format import Fixed, Hdf5Error, Reader, Writer, as_text, is_valid
from porelight.streaming.ingest import ingest


def test_type_matrix():
    w = Writer()
    inner = np.dtype([("i", "<i4"), ("s", "S6")])
    outer = np.dtype([("a", "<i2"), ("f", "<f4"), ("s", "S6"), ("n", inner)])
    values = {
        "int": 42, "int1": np.int8(-3), "uint8": np.uint64(1 << 63), "float": 3.14, "float4": np.float32(2.5), "ints": np.array([42, 43, 44], np.int32), "text": "CCCGG", "texts": ["a", "", "ccc"], "cut": Fixed("CCCGG", 3), "fixed": np.array([b"ACGTA"]),
        "nested": np.array([(1, 3.5, b"ACGTA", (42, b"GTTAC"))] * 3, outer),
    }
    for k, v in values.items():
        w.dataset(f"/d/{k}", v)
        if k != "nested":
            w.attribute("/a", k, v)
    r = Reader(w.bytes())
    attrs = {k: v[2] for k, v in r.attributes(r.find("/a")).items()}
    for k in values:
        got = r.read(r.find(f"/d/{k}"))
        if k in attrs:
            assert got == attrs[k]
        want = {"cut": "CC", "fixed": ["ACGTA"], "nested": [{"a": 1, "f": 3.5, "s": "ACGTA", "n": {"i": 42, "s": "GTTAC"}}] * 3, "ints": [42, 43, 44]}.get(k, values[k])
        assert got == want, k
    assert as_text(3.14159265) == "3.14159" and as_text(["a", "b"]) == "ab" and as_text([1, 2]) == "1,2"


def test_writer_guards():
    w = Writer()
    w.dataset("/a/b", 1)
    with pytest.raises(Hdf5Error):
        w.dataset("/a/b", 2)
    with pytest.raises(Hdf5Error):
        w.dataset("/a/e", [])
    w.attribute("/a", "x", 1)
    with pytest.raises(Hdf5Error):
        w.attribute("/a", "x", 2)
    with pytest.raises(Hdf5Error):
        w.dataset("/a/b/c", 1)


def test_damaged():
    w = Writer()
    w.dataset("/x", np.arange(100))
    data = w.bytes()
    assert is_valid(data) and not is_valid(data[:-1]) and not is_valid(b"") and not is_valid(b"text" * 100)
    assert Reader(data).find("/y") is None and Reader(bytes(512) + data).read(Reader(bytes(512) + data).find("/x"))[5] == 5


def mini():
    """The mini basecall group and a raw read."""
    event = {"gr": "000", "st": 0, "mean": 55.0, "stdv": 1.0, "start": 0.05, "length": 0.01, "p_model_state": 0.5, "move": 0, "model_state": "ACGTA"}
    state = {"gr": "000", "st": 0, "level_mean": 56.0, "level_stdv": 1.0, "sd_mean": 42.0, "sd_stdv": 1.0, "kmer": "ACGTA"}
    return dict(
        read_file={"file_version": "0.6", "channel": {"channel_number": "12", "digitisation": 8192.0, "offset": 10.0, "range": 1400.0, "sampling_rate": 4000.0}, "tracking": {"device_id": "d", "exp_start_time": "86400"}},
        raw=[{"rn": "Read_1", "signal": [500, 501, 499], "params": {"read_id": "r", "read_number": 1, "start_mux": 1, "start_time": 100, "duration": 3}}],
        ed_event=[{"gr": "000", "rn": "Read_1", "event_idx": k, "start": 100 + k, "length": 1, "mean": 1.5, "stdv": 0.0} for k in range(3)],
        fastq=[{"gr": "000", "st": 0, "fq": reads.single_base_fastq("test_name", "ACGT")}], bc_event=[event | {"event_idx": k} for k in range(3)], model=[state | {"state_idx": k} for k in range(3)],
        streams=[{"obj_path": "/Raw/Reads/Read_2/Signal_Pack", "stream": "Signal", "bytes": b"\x01\x02\xff", "params": {"size": "3"}}], attrs=[{"obj_path": "/Analyses/Basecall_000", "name": "name", "type_class": "string", "value": "ONT Sequencing Workflow"}, {"obj_path": "/Analyses/Basecall_000", "name": "n", "type_class": "int", "value": "5"}],
    )


def test_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = reads.build_file(**mini())
    (tmp_path / "in" / "a.h5").write_bytes(data)
    (tmp_path / "in" / "b.h5").write_bytes(data[: len(data) // 2])
    (tmp_path / "in" / "c.txt").write_bytes(b"no file at all")
    found = reads.files(spark, [str(tmp_path / "in")])
    assert sorted((r.path.rsplit('/', 1)[1], r.valid) for r in reads.load(found, "valid").collect()) == [("a.h5", True), ("b.h5", False), ("c.txt", False)]
    get = lambda t: reads.load(found, t).collect()
    (f,) = get("read_file")
    assert f.file_version == "0.6" and f.channel.sampling_rate == 4000.0 and f.tracking == {"device_id": "d", "exp_start_time": "86400"}
    assert [(r.rn, r.packed, r.signal) for r in get("raw_read")] == [("Read_1", False, [500, 501, 499]), ("Read_2", True, None)]
    assert [(e.start, e.mean) for e in get("ed_event")] == [(100, 1.5), (101, 1.5), (102, 1.5)]
    (fq,) = get("bc_fastq")
    assert fq.fq == "@test_name\nACGT\n+\n!!!!\n"
    assert {e.model_state for e in get("bc_event")} == {"ACGTA"} and len(get("bc_model_state")) == 3
    (g,) = get("bc_group")
    assert (g.name, g.version) == ("metrichor", "?+?") and g.params["n"] == "5"
    (s,) = get("bc_strand")
    assert (s.have_fastq, s.have_events, s.have_model, s.have_alignment, s.packed_events) == (True, True, True, False, False)
    (p,) = get("pack_stream")
    assert (p.obj_path, p.stream, bytes(p.bytes), p.params) == ("/Raw/Reads/Read_2/Signal_Pack", "Signal", b"\x01\x02\xff", {"size": "3"})
    assert {(r.group_path, r.name, r.kind) for r in get("link")} >= {("/", "Raw", "group"), ("/Raw/Reads/Read_1", "Signal", "dataset")}
    lines = report.listing([report.tracking_lines(reads.load(found, "read_file")), report.channel_lines(reads.load(found, "read_file")), report.raw_lines(reads.load(found, "raw_read"), F.lit(4000.0))])
    texts = [r.text for r in lines.collect()]
    assert "tid/exp_start_date\t1970-01-02" in texts and "cid/sampling_rate\t4000" in texts and "rs/Read_1/packed\t0" in texts and "rs/Read_2/packed\t1" in texts


def test_one_pass(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = reads.build_file(**mini())
    for name, content in (("a.h5", data), ("b.h5", data), ("c.h5", data[: len(data) // 2]), ("d.h5", b"")):
        (tmp_path / "in" / name).write_bytes(content)
    found = reads.files(spark, [str(tmp_path / "in")])
    tables = reads.load_all(found, str(tmp_path / "out"))
    assert set(tables) == set(reads.EXTRACT) and not (tmp_path / "out" / "_decoded").exists()
    for name, table in tables.items():
        alone = reads.load(found, name)
        assert table.dtypes == alone.dtypes
        assert sorted(map(str, table.collect())) == sorted(map(str, alone.collect()))
    assert tables["ed_event"].count() == 6 and tables["bc_alignment"].count() == 0
    some = reads.load_all(found.where("path LIKE '%nothing'"), str(tmp_path / "none"), ["attr", "valid"])
    assert set(some) == {"attr", "valid"} and not any(t.count() for t in some.values())


def test_there_and_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.h5").write_bytes(reads.build_file(**mini()))
    found = reads.files(spark, [str(tmp_path / "in")])
    built = reads.assemble(reads.load(found, "read_file"), raw=reads.load(found, "raw_read").where("NOT packed"), ed_event=reads.load(found, "ed_event"), fastq=reads.load(found, "bc_fastq"))
    assert [r.error for r in reads.write_files(built, str(tmp_path / "out")).collect()] == [None]
    assert [r.error for r in reads.write_files(built, str(tmp_path / "out")).collect()] == ["exists"]
    again = reads.files(spark, [str(tmp_path / "out")])
    for t in ("ed_event", "bc_fastq"):
        drop = lambda df: sorted(map(str, df.drop("file_id").collect()))
        assert drop(reads.load(found, t)) == drop(reads.load(again, t))


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = reads.build_file(**mini())
    for k in range(3):
        (tmp_path / "in" / f"{k}.h5").write_bytes(data)
        ingest(spark, str(tmp_path / "in"), "ed_event", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9


def test_many_groups_take_time_and_room_in_proportion():
    """Each group is found once, not looked for among all; texts share heap collections."""
    import time

    n, began = 2000, time.perf_counter()
    attrs = [{"obj_path": f"/Analyses/Basecall_{k:06d}{more}", "name": "name", "type_class": "string", "value": f"v{k}{more}"} for k in range(n) for more in ("", "/Configuration/a", "/Summary")]
    data = reads.build_file({}, attrs=[*attrs, {"obj_path": "/long", "name": "x", "type_class": "string", "value": "y" * 5000}])
    r = Reader(data)
    rows = list(reads._bc_group("f", "p", r))
    assert [(g["gr"], dict(g["params"]), dict(g["config"]), dict(g["summary"])) for g in rows[:: n - 1]] == [(f"{k:06d}", {"name": f"v{k}"}, {"a/name": f"v{k}/Configuration/a"}, {"name": f"v{k}/Summary"}) for k in (0, n - 1)]
    assert len(rows) == n and r.attributes(r.find("/long"))["x"][2] == "y" * 5000
    assert time.perf_counter() - began < 20 and len(data) < 5000 * n


def test_parts_of_large_files(spark):
    """A dataset longer than a slice is cut between parts and comes back whole; groups and reads of several parts are listed once, in order."""
    n = 2 * reads.SLICE + 9
    ids = spark.range(1).select(F.lit("f").alias("file_id"), F.lit("0.6").alias("file_version"))
    rows = spark.range(n).select(F.lit("f").alias("file_id"), F.lit("000").alias("gr"), F.col("id").alias("idx"), (F.col("id") * 3).alias("template_index"), (-F.col("id")).alias("complement_index"), F.lit("ACGTA").alias("kmer"))
    fq = spark.range(1).select(F.lit("f").alias("file_id"), F.lit("000").alias("gr"), F.lit(2).cast("tinyint").alias("st"), F.lit("@n\nACGTA\n+\n!!!!!\n").alias("fq"))
    events = spark.range(30_000).select(F.lit("f").alias("file_id"), F.lit("000").alias("gr"), F.floor(F.col("id") / 3).cast("string").alias("rn"), (F.col("id") % 3).alias("event_idx"), F.col("id").alias("start"), F.lit(1).cast("bigint").alias("length"), F.lit(1.0).alias("mean"), F.lit(0.5).alias("stdv"))
    wanted = ("read_file", "attr", "bc_group", "bc_strand", "bc_fastq", "bc_alignment", "ed_group", "ed_read", "ed_event")
    found = reads.written_and_read(ids, wanted, alignment=rows, fastq=fq, ed_event=events)
    a = found["bc_alignment"].agg(F.count("*"), F.min("idx"), F.max("idx"), F.countDistinct("idx"), F.sum((F.col("template_index") != F.col("idx") * 3).cast("int"))).first()
    assert tuple(a) == (n, 0, n - 1, n, 0)
    assert [(r.file_id, r.file_version) for r in found["read_file"].collect()] == [("f", "0.6")]
    assert [(r.gr, r.gr_ord) for r in found["bc_group"].collect()] == [("000", 0)] and found["ed_group"].count() == 1
    assert [(r.st, r.have_fastq, r.have_alignment) for r in found["bc_strand"].collect()] == [(2, True, True)] and found["bc_fastq"].count() == 1
    listed = [r.rn for r in found["ed_read"].orderBy("rn_ord").collect()]
    assert listed == sorted(listed) and len(listed) == 10_000 and found["ed_event"].count() == 30_000
    assert {r.name for r in found["attr"].collect()} == {"file_version"}

    import pyarrow as pa

    def sizes(batches):
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(c) for _, c in reads._contents(batches, ["read_file", "ed_event"], True)], pa.int64())})

    parts = [r.n for r in reads._in_order(ids, {"ed_event": events}, True).coalesce(1).mapInArrow(sizes, "n bigint").collect()]
    assert len(parts) == 2 and max(parts) < 2 * reads.PART_BYTES
    with pytest.raises(Exception, match="without gaps"):
        reads.written_and_read(ids, ("bc_alignment",), alignment=rows.where("idx != 70000"))
