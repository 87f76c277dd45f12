"""Queries that write read files from the driver's tables, read them back and use the accessors, each with its SQL.

A file per nation, or per customer for basecall groups. What is read from the
bytes of the files is kept as tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from porelight.functions import codec, expr
from porelight.functions.codewords import ED_LEN, Code, coders
from porelight.operators import aggregates, catalog, packing
from porelight.operators.access import Reads
from porelight.plans.queries import query
from porelight.plans.views import SQL, table, v_ed, v_group, v_raw, v_seq
from porelight.sources import reads

FILES = 25  # as many as nations
START = 100  # of every raw read
_FILE = "CAST({} % 25 AS VARCHAR) AS file_id"


def _file(key: str):
    return (F.col(key) % FILES).cast("string").alias("file_id")


def _files(spark, sf) -> DataFrame:
    """A row per nation of what a file says of itself."""
    n = table(spark, sf, "nation")
    channel = F.struct(F.col("n_nationkey").cast("string").alias("channel_number"), F.lit(8192.0).alias("digitisation"), (F.col("n_nationkey") + 10.0).alias("offset"), F.lit(1400.0).alias("range"), F.lit(4000.0).alias("sampling_rate"))
    texts = lambda k, c: F.create_map(F.lit(k), F.col(c).cast("string"))
    return n.select(F.col("n_nationkey").cast("string").alias("file_id"), F.lit("0.6").alias("file_version"), channel.alias("channel"), texts("device_id", "n_name").alias("tracking"), texts("region", "n_regionkey").alias("context"), F.create_map().cast("map<string,string>").alias("sequences"))


def _open(files: DataFrame, names: tuple[str, ...], split: bool = True, **tables: DataFrame) -> Reads:
    """The files of these tables' rows, written and read back; in parts if they may be large."""
    return Reads(files.sparkSession, reads.written_and_read(files, names, split, **tables))


def _signals(spark, sf) -> DataFrame:
    """A raw read per user: file_id, rn, signal, params."""
    rows = v_raw(spark, sf).groupBy("rn").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "s"))), lambda x: x["s"].cast("smallint")).alias("signal"))
    params = F.struct(F.concat(F.lit("id"), F.col("rn").cast("string")).alias("read_id"), F.col("rn").alias("read_number"), F.lit(1).cast("bigint").alias("start_mux"), F.lit(START).cast("bigint").alias("start_time"), F.size("signal").cast("bigint").alias("duration"))
    return rows.select(_file("rn"), F.col("rn").cast("string").alias("rn"), "signal", params.alias("params"))


def _streams(packed: DataFrame, path, **streams) -> DataFrame:
    """Rows of pack_stream from columns of streams."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("stream"), F.col(f"{c}.bytes").alias("bytes"), F.col(f"{c}.params").alias("params")) for name, c in streams.items())))
    return packed.select("file_id", path.alias("obj_path"), each.alias("x")).select("file_id", "obj_path", "x.*")


def _attrs(rows: DataFrame, path, **values) -> DataFrame:
    """Rows of attr: name=(type class, column)."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type_class"), v.cast("string").alias("value")) for name, (kind, v) in values.items())))
    return rows.select("file_id", path.alias("obj_path"), each.alias("x")).select("file_id", "obj_path", "x.*")


def _packed_signals(spark, sf, some) -> dict[str, DataFrame]:
    """Raw reads, those for which ``some`` holds packed: the tables ``raw`` and ``streams``."""
    all_reads = _signals(spark, sf)
    packed = packing.pack_raw(all_reads.where(some).select("file_id", "rn", "signal"))
    raw = all_reads.withColumn("signal", F.when(~some, F.col("signal")))
    return {"raw": raw, "streams": _streams(packed, F.concat(F.lit("/Raw/Reads/"), "rn", F.lit("/Signal_Pack")), Signal="raw")}


def _exploded(rows: DataFrame) -> DataFrame:
    return rows.select("file_id", "rn", F.posexplode("signal").alias("idx", "s")).select("file_id", "rn", F.col("idx").cast("bigint").alias("idx"), "s")


_RAW_SQL = f"WITH {SQL['v_raw']} SELECT {_FILE.format('rn')}, CAST(rn AS VARCHAR) AS rn, CAST(idx AS BIGINT) AS idx, CAST(s AS SMALLINT) AS s FROM v_raw"


# the file itself -----------------------------------------------------------------
@query("SELECT CAST(n_nationkey AS VARCHAR) AS file_id, '0.6' AS file_version, true AS have_channel, CAST(n_nationkey AS VARCHAR) AS channel_number, 8192.0::DOUBLE AS digitisation, n_nationkey + 10.0::DOUBLE AS \"offset\", 1400.0::DOUBLE AS \"range\", 4000.0::DOUBLE AS sampling_rate FROM nation")
def file_channel(spark, sf):
    r = _open(_files(spark, sf), ("read_file",))
    return r.file_version().join(r.channel(), "file_id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file_id, unnest(['tracking', 'context']) AS kind, unnest(['device_id', 'region']) AS key, unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS value FROM nation")
def file_params(spark, sf):
    r = _open(_files(spark, sf), ("read_file",))
    of = lambda kind: r.attributes_of(kind).select("file_id", F.lit(kind).alias("kind"), F.explode("params"))
    return of("tracking").union(of("context")).union(of("sequences"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file_id, unnest(['/UniqueGlobalKey/tracking_id', '/UniqueGlobalKey/context_tags', '/UniqueGlobalKey/channel_id', '/']) AS obj_path, unnest(['device_id', 'region', 'channel_number', 'file_version']) AS name, unnest([n_name, CAST(n_regionkey AS VARCHAR), CAST(n_nationkey AS VARCHAR), '0.6']) AS value FROM nation")
def file_attributes(spark, sf):
    r = _open(_files(spark, sf), ("attr",))
    return r["attr"].where("type_class = 'string'").select("file_id", "obj_path", "name", "value")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS file_id, n_nationkey % 3 <> 1 AS valid FROM nation")
def file_valid(spark, sf):
    """Files cut off after a hundred bytes are told from the others; the load of a table leaves them out."""
    built = reads.assemble(_files(spark, sf)).withColumn("path", F.lit("memory"))
    damaged = F.col("file_id").cast("int") % 3 == 1
    found = built.select("file_id", "path", F.when(damaged, F.substring("content", 1, 100)).otherwise(F.col("content")).alias("content"))
    return reads.load(found, "valid").select("file_id", "valid")


@query(f"WITH {SQL['v_raw']}, r AS (SELECT DISTINCT rn FROM v_raw) SELECT {_FILE.format('rn')}, '/Raw/Reads' AS group_path, CAST(rn AS VARCHAR) AS name, 'group' AS kind FROM r UNION ALL SELECT {_FILE.format('rn')}, '/Raw/Reads/' || rn, 'Signal', 'dataset' FROM r")
def file_listing(spark, sf):
    r = _open(_files(spark, sf), ("link",), raw=_signals(spark, sf))
    return r["link"].where("group_path LIKE '/Raw/Reads%'").select("file_id", "group_path", "name", "kind")


# raw samples -----------------------------------------------------------------------
@query(_RAW_SQL)
def file_raw_samples(spark, sf):
    return _exploded(_open(_files(spark, sf), ("raw_read",), raw=_signals(spark, sf)).of_all().raw_int_samples())


@query(_RAW_SQL)
def file_raw_packed(spark, sf):
    """Every third read is packed on file."""
    r = _open(_files(spark, sf), ("raw_read", "pack_stream"), **_packed_signals(spark, sf, F.col("params.read_number") % 3 == 0))
    return _exploded(r.of_all().raw_int_samples())


@query(f"WITH {SQL['v_raw']}, r AS (SELECT rn, count(*) AS n FROM v_raw GROUP BY rn), f AS (SELECT rn % 25 AS f, min(CAST(rn AS VARCHAR)) AS rn FROM r GROUP BY rn % 25) SELECT CAST(f AS VARCHAR) AS file_id, f.rn, 'id' || f.rn AS read_id, r.rn AS read_number, CAST(100 AS BIGINT) AS start_time, n AS duration, r.rn % 3 = 0 AS packed FROM f JOIN r ON CAST(r.rn AS VARCHAR) = f.rn")
def file_raw_default(spark, sf):
    """The read that an empty argument means, the first in the listing, with its params and form."""
    r = _open(_files(spark, sf), ("raw_read",), **{"raw": (p := _packed_signals(spark, sf, F.col("params.read_number") % 3 == 0))["raw"], "streams": p["streams"]})
    params = r.raw_params().join(r.raw_read_names(), ["file_id", "rn"])
    return params.select("file_id", "rn", "params.read_id", "params.read_number", "params.start_time", "params.duration", "packed")


@query(f"WITH {SQL['v_raw']}, {SQL['v_channel']} SELECT {_FILE.format('rn')}, CAST(rn AS VARCHAR) AS rn, CAST(idx AS BIGINT) AS idx, CAST((s + \"offset\") * \"range\" / digitisation AS FLOAT) AS s FROM v_raw JOIN v_channel ON rn % 25 = n_nationkey")
def file_raw_current(spark, sf):
    return _exploded(_open(_files(spark, sf), ("read_file", "raw_read"), raw=_signals(spark, sf)).raw_samples_of_all())


@query(f"WITH {SQL['v_raw']}, p AS (SELECT unnest(['pack', 'unpack', 'copy']) AS policy) SELECT policy, {_FILE.format('rn')}, CAST(rn AS VARCHAR) AS rn, policy = 'pack' OR (policy = 'copy' AND rn % 3 = 0) AS packed, CAST(idx AS BIGINT) AS idx, CAST(s AS SMALLINT) AS s FROM v_raw, p")
def file_pack_policies(spark, sf):
    """What the pack job leaves of reads of which every third was packed before, by policy."""
    from porelight import cli

    r = _open(_files(spark, sf), ("read_file", "raw_read", "pack_stream"), **_packed_signals(spark, sf, F.col("params.read_number") % 3 == 0))
    out = []
    for name, policy in (("pack", packing.PACK), ("unpack", packing.UNPACK), ("copy", packing.COPY)):
        done = packing.run(*cli.pack_inputs(r), packing.Options("archive", {"rw": policy}, check=False), cli.packed_inputs(r))
        forms = {"raw": name == "pack", "raw_packed": True}
        for rows, packed in ((done[k], packed) for k, packed in forms.items() if k in done):
            plain = packing.unpack_raw(rows.select("file_id", "rn", "raw")) if packed else rows
            out.append(_exploded(plain).select(F.lit(name).alias("policy"), "file_id", "rn", F.lit(packed).alias("packed"), "idx", "s"))
    first, *rest = out
    for more in rest:
        first = first.unionByName(more)
    return first


# detected events ---------------------------------------------------------------------
_ED_SQL = f"WITH {SQL['v_ed']} SELECT {_FILE.format('rn')}, printf('%03d', rn % 2) AS gr, CAST(rn AS VARCHAR) AS rn, CAST(event_idx AS INTEGER) AS event_idx, CAST(START + sum(skip + len) OVER w - len AS BIGINT) AS start, len AS length, CAST(len AS DOUBLE) / 8 AS mean, CAST(skip AS DOUBLE) AS stdv FROM v_ed WINDOW w AS (PARTITION BY rn ORDER BY event_idx)".replace("START", str(START))


@query(_ED_SQL)
def file_ed_events(spark, sf):
    w = Window.partitionBy("rn").orderBy("event_idx").rowsBetween(Window.unboundedPreceding, 0)
    events = v_ed(spark, sf).select(_file("rn"), F.format_string("%03d", F.col("rn") % 2).alias("gr"), F.col("rn").cast("string").alias("rn"), F.col("event_idx").cast("int").alias("event_idx"), (F.lit(START) + F.sum(F.col("skip") + F.col("len")).over(w) - F.col("len")).alias("start"), F.col("len").alias("length"), (F.col("len") / 8.0).alias("mean"), F.col("skip").cast("double").alias("stdv"))
    r = _open(_files(spark, sf), ("ed_group", "ed_read", "ed_event"), ed_event=events)
    return r.of_all().ed_events()


@query(f"WITH {SQL['v_raw']}, {SQL['v_channel']}, c AS (SELECT rn, idx // 5 AS e, CAST(CAST((s + \"offset\") * \"range\" / digitisation AS FLOAT) AS DOUBLE) AS c FROM v_raw JOIN v_channel ON rn % 25 = n_nationkey) SELECT {_FILE.format('rn')}, '000' AS gr, CAST(rn AS VARCHAR) AS rn, CAST(e AS INTEGER) AS event_idx, CAST({START} + 5 * e AS BIGINT) AS start, count(*) AS length, round(avg(c), 3) AS mean FROM c GROUP BY rn, e")
def file_ed_packed(spark, sf):
    """Events of five samples, packed on file; their means come back from the raw samples."""
    raw, codes = _signals(spark, sf), coders()
    n = F.ceil(F.size("signal") / 5).cast("int")
    lens = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.least(F.lit(5), F.size("signal") - 5 * k).cast("bigint"))
    packed = raw.select("file_id", "rn", codec.pack_huffman(spark, F.transform(F.sequence(F.lit(1), n), lambda k: F.lit(0).cast("bigint")), codes["ed_skip"]).alias("skip"), codec.pack_huffman(spark, lens, codes["ed_len"]).alias("len"))
    path = F.concat(F.lit("/Analyses/EventDetection_000/Reads/"), "rn", F.lit("/Events_Pack"))
    ed_read = raw.select("file_id", F.lit("000").alias("gr"), "rn", F.lit(True).alias("packed"), F.struct(F.lit(START).cast("bigint").alias("start_time")).alias("params"))
    r = _open(_files(spark, sf), ("read_file", "raw_read", "ed_group", "ed_read", "ed_event", "pack_stream"), raw=raw, ed_read=ed_read, streams=_streams(packed, path, Skip="skip", Len="len"))
    return r.of_all().ed_events().select("file_id", "gr", "rn", "event_idx", "start", "length", F.round("mean", 3).alias("mean"))


# basecalls -----------------------------------------------------------------------------
_FQ = f"WITH {SQL['v_seq']} SELECT {_FILE.format('rn')}, printf('%03d', rn // 25) AS gr, CAST(rn % 3 AS TINYINT) AS st"


def _fastq(spark, sf) -> DataFrame:
    fq = F.concat(F.lit("@n"), F.col("rn").cast("string"), F.lit("\n"), "sq", F.lit("\n+\n"), F.expr("repeat(chr(33 + rn % 30), length(sq))"), F.lit("\n"))
    return v_seq(spark, sf).select(_file("rn"), F.format_string("%03d", F.expr("rn div 25")).alias("gr"), (F.col("rn") % 3).cast("tinyint").alias("st"), fq.alias("fq"))


def _of_strands(r: Reads, get) -> DataFrame:
    return get(r, 0).unionByName(get(r, 1)).unionByName(get(r, 2))


@query(f"{_FQ}, '@n' || rn || chr(10) || sq || chr(10) || '+' || chr(10) || repeat(chr(CAST(33 + rn % 30 AS INTEGER)), length(sq)) || chr(10) AS fq, sq FROM v_seq")
def file_fastq(spark, sf):
    """Fastq and bases of each strand; every other one is packed on file."""
    rows, codes = _fastq(spark, sf), coders()
    some = F.expr("cast(gr as int) % 2") == 1
    packed = packing.pack_fastq(rows.where(some), codes=codes)
    path = F.concat(F.lit("/Analyses/Basecall_"), "gr", F.lit("/BaseCalled_"), F.element_at(F.array(F.lit("template"), F.lit("complement"), F.lit("2D")), F.col("st").cast("int") + 1), F.lit("/Fastq_Pack"))
    r = _open(_files(spark, sf), ("bc_group", "bc_strand", "bc_fastq", "pack_stream", "attr"), fastq=rows.where(~some), streams=_streams(packed, path, BP="bp", QV="qv"), attrs=_attrs(packed, path, read_name=("string", F.col("read_name")))).of_all()
    keys = ["file_id", "gr", "st"]
    return _of_strands(r, lambda r, st: r.fastq(st)).join(_of_strands(r, lambda r, st: r.bases(st)), keys)


@query("SELECT CAST(l_orderkey % 25 AS VARCHAR) AS file_id, '000' AS gr, CAST(l_orderkey % 2 AS TINYINT) AS st, CAST(row_number() OVER (PARTITION BY l_orderkey % 25, l_orderkey % 2 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS INTEGER) AS event_idx, l_quantity AS mean, l_tax AS stdv, CAST(l_orderkey AS DOUBLE) AS start, l_discount AS length, 0.5::DOUBLE AS p_model_state, CAST(l_linenumber AS BIGINT) AS move, substr('ACGTACGTACGT', CAST(l_orderkey % 7 + 1 AS INTEGER), 5) AS model_state FROM lineitem")
def file_bc_events(spark, sf):
    w = Window.partitionBy(F.col("l_orderkey") % FILES, F.col("l_orderkey") % 2).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    state = F.substring(F.lit("ACGTACGTACGT"), (F.col("l_orderkey") % 7 + 1).cast("int"), F.lit(5))
    events = table(spark, sf, "lineitem").select(_file("l_orderkey"), F.lit("000").alias("gr"), (F.col("l_orderkey") % 2).cast("tinyint").alias("st"), (F.row_number().over(w) - 1).alias("event_idx"), F.col("l_quantity").alias("mean"), F.col("l_tax").alias("stdv"), F.col("l_orderkey").cast("double").alias("start"), F.col("l_discount").alias("length"), F.lit(0.5).alias("p_model_state"), F.col("l_linenumber").cast("bigint").alias("move"), state.alias("model_state"))
    r = _open(_files(spark, sf), ("read_file", "raw_read", "ed_group", "ed_read", "ed_event", "bc_group", "bc_strand", "bc_fastq", "bc_event", "attr", "pack_stream"), bc_event=events)
    return r.events(0).unionByName(r.events(1))


_PROGRAM = "CASE program WHEN 'ONT Sequencing Workflow' THEN 'metrichor' WHEN 'MinKNOW-Live-Basecalling' THEN 'minknow' WHEN 'ONT Albacore Sequencing Software' THEN 'albacore' ELSE '?' END"


@query(f"WITH {SQL['v_group']} SELECT CAST(file_id AS VARCHAR) AS file_id, gr, {_PROGRAM} AS name, CASE {_PROGRAM} WHEN '?' THEN '?' WHEN 'metrichor' THEN 'v' || key || '+?' ELSE '?' END AS version FROM v_group")
def file_bc_groups(spark, sf):
    """A file per customer with a basecall group per order: which program made each."""
    g = v_group(spark, sf).withColumn("file_id", F.col("file_id").cast("string"))
    files = g.select("file_id").distinct().withColumns({"file_version": F.lit("0.6"), "channel": F.lit(None).cast("struct<sampling_rate:double>")})
    r = _open(files, ("bc_group",), split=False, attrs=_attrs(g, F.concat(F.lit("/Analyses/Basecall_"), "gr"), **{"name": ("string", F.col("program")), "chimaera version": ("string", F.concat(F.lit("v"), "key"))}))
    return r["bc_group"].select("file_id", "gr", "name", "version")


@query("SELECT CAST(p_partkey % 25 AS VARCHAR) AS file_id, '000' AS gr, CAST(p_partkey % 2 AS TINYINT) AS st, CAST(row_number() OVER (PARTITION BY p_partkey % 25, p_partkey % 2 ORDER BY p_partkey) - 1 AS INTEGER) AS state_idx, CAST(p_size AS DOUBLE) AS level_mean, p_retailprice AS level_stdv, 1.0::DOUBLE AS sd_mean, 0.5::DOUBLE AS sd_stdv, substr('ACGTACGTACGT', CAST(p_partkey % 7 + 1 AS INTEGER), 5) AS kmer, 'model' || (p_partkey % 2) AS model_file, 1.5::DOUBLE AS scale FROM part")
def file_model(spark, sf):
    """Models with their file and parameters."""
    w = Window.partitionBy(F.col("p_partkey") % FILES, F.col("p_partkey") % 2).orderBy("p_partkey")
    st = (F.col("p_partkey") % 2).cast("tinyint")
    states = table(spark, sf, "part").select(_file("p_partkey"), F.lit("000").alias("gr"), st.alias("st"), (F.row_number().over(w) - 1).alias("state_idx"), F.col("p_size").cast("double").alias("level_mean"), F.col("p_retailprice").alias("level_stdv"), F.lit(1.0).alias("sd_mean"), F.lit(0.5).alias("sd_stdv"), F.substring(F.lit("ACGTACGTACGT"), (F.col("p_partkey") % 7 + 1).cast("int"), F.lit(5)).alias("kmer"))
    params = states.select("file_id", "gr", "st").distinct().select("*", F.concat(F.lit("model"), F.col("st").cast("string")).alias("model_file"), F.struct(F.lit(1.5).alias("scale"), F.lit(0.25).alias("shift")).alias("params"))
    r = _open(_files(spark, sf), ("bc_group", "bc_strand", "bc_model_state", "bc_model_params", "ed_group", "attr"), model=states, model_params=params)
    of = lambda r, st: r.model(st).join(r.model_params(st), ["file_id", "gr", "st"])
    return of(r, 0).unionByName(of(r, 1)).select("file_id", "gr", "st", "state_idx", "level_mean", "level_stdv", "sd_mean", "sd_stdv", "kmer", "model_file", "params.scale")


@query("SELECT CAST(o_orderkey % 25 AS VARCHAR) AS file_id, '000' AS gr, CAST(row_number() OVER (PARTITION BY o_orderkey % 25 ORDER BY o_orderkey) - 1 AS INTEGER) AS idx, o_orderkey AS template_index, o_custkey AS complement_index, substr('ACGTACGTACGT', CAST(o_orderkey % 7 + 1 AS INTEGER), 5) AS kmer FROM orders")
def file_alignment(spark, sf):
    w = Window.partitionBy(F.col("o_orderkey") % FILES).orderBy("o_orderkey")
    rows = table(spark, sf, "orders").select(_file("o_orderkey"), F.lit("000").alias("gr"), (F.row_number().over(w) - 1).alias("idx"), F.col("o_orderkey").alias("template_index"), F.col("o_custkey").alias("complement_index"), F.substring(F.lit("ACGTACGTACGT"), (F.col("o_orderkey") % 7 + 1).cast("int"), F.lit(5)).alias("kmer"))
    r = _open(_files(spark, sf), ("bc_group", "bc_strand", "bc_fastq", "bc_alignment", "attr", "pack_stream"), alignment=rows)
    return r.alignment()


_MD5_BASES = "translate(md5(CAST(c_custkey AS VARCHAR)) || md5('x' || c_custkey), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"WITH e AS (SELECT c_custkey AS rn, {_MD5_BASES} AS sq, unnest(range(0, 60)) AS i FROM customer) SELECT {_FILE.format('rn')}, printf('%06d', rn) AS gr, CAST(i AS INTEGER) AS idx, CASE WHEN i % 3 = 2 THEN -1 ELSE 7 + i - (i + 1) // 3 END AS template_index, CASE WHEN i % 4 = 3 THEN -1 ELSE 100000 - i + i // 4 END AS complement_index, substr(sq, CAST(i + 1 AS INTEGER), 5) AS kmer FROM e")
def file_alignment_packed(spark, sf):
    """Alignments of two strands with gaps, packed on file and rebuilt from the 64 bases of a 2D strand per customer."""
    key = F.col("c_custkey").cast("string")
    sq = F.translate(F.concat(F.md5(key), F.md5(F.concat(F.lit("x"), key))), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = table(spark, sf, "customer").select(_file("c_custkey"), F.format_string("%06d", "c_custkey").alias("gr"), sq.alias("sq"))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.length("sq") - 5)).alias("idx"))
    i = F.col("idx").cast("bigint")
    entries = each.select("file_id", "gr", "idx", F.when(i % 3 == 2, -1).otherwise(7 + i - F.floor((i + 1) / 3)).cast("bigint").alias("template_index"), F.when(i % 4 == 3, -1).otherwise(100_000 - i + F.floor(i / 4)).cast("bigint").alias("complement_index"), F.substring(F.col("sq"), F.col("idx") + 1, F.lit(5)).alias("kmer"), "sq")
    packed = packing.pack_alignment(entries, ["file_id", "gr"])
    path = F.concat(F.lit("/Analyses/Basecall_"), "gr", F.lit("/BaseCalled_2D/Alignment_Pack"))
    fastq = rows.select("file_id", "gr", F.lit(2).cast("tinyint").alias("st"), F.concat(F.lit("@n\n"), "sq", F.lit("\n+\n"), F.expr("repeat('!', length(sq))"), F.lit("\n")).alias("fq"))
    attrs = _attrs(packed, path, template_index_start=("int", F.col("template_start")), complement_index_start=("int", F.col("complement_start")), kmer_size=("int", F.col("kmer_size")))
    r = _open(_files(spark, sf), ("bc_group", "bc_strand", "bc_fastq", "bc_alignment", "attr", "pack_stream"), fastq=fastq, streams=_streams(packed, path, Template_Step="template_step", Complement_Step="complement_step", Move="move"), attrs=attrs)
    return r.of_all().alignment()


#: Not registered, for its plan takes minutes on the tables of sf0.01; a test compares it on smaller ones.
BC_PACKED_SQL = f"WITH e AS (SELECT c_custkey AS rn, {_MD5_BASES} AS sq, unnest(range(0, 6)) AS i FROM customer) SELECT {_FILE.format('rn')}, printf('%06d', rn) AS gr, CAST(0 AS TINYINT) AS st, CAST(i AS INTEGER) AS event_idx, 50.0::DOUBLE + 2 * i AS mean, 1.0::DOUBLE AS stdv, round((100 + 20 * i + 0.5::DOUBLE) / 4000, 9) AS start, round(10.5::DOUBLE / 4000, 9) AS length, 0.5::DOUBLE AS p_model_state, CAST(CASE WHEN i = 0 THEN 0 ELSE 2 END AS BIGINT) AS move, substr(sq, CAST(2 * i + 1 AS INTEGER), 5) AS model_state FROM e"


def file_bc_packed(spark, sf):
    """Basecall events packed on file, rebuilt from the bases of their strand and the detected events that they name."""
    key, rate = F.col("c_custkey").cast("string"), F.lit(4000.0)
    sq = F.substring(F.translate(F.md5(key), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 15)  # as far as the last event's state
    own = table(spark, sf, "customer").select(_file("c_custkey"), F.format_string("%06d", "c_custkey").alias("gr"), F.lit(0).cast("tinyint").alias("st"), sq.alias("sq"))
    keys, i = ["file_id", "gr", "st"], F.col("event_idx")
    ed = own.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(11))).alias("event_idx")).select(*keys, "event_idx", (F.lit(START) + 10 * i).cast("bigint").alias("start"), F.lit(10).cast("bigint").alias("length"), (F.lit(50.0) + i).alias("mean"), F.lit(1.0).alias("stdv"))
    ev = own.select(*keys, "sq", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("event_idx")).select(*keys, "event_idx", "sq", ((F.lit(START) + 20 * i + 0.5) / rate).alias("start"), (F.lit(10.5) / rate).alias("length"), F.when(i == 0, 0).otherwise(2).cast("bigint").alias("move"), F.substring(F.col("sq"), 2 * i + 1, F.lit(5)).alias("model_state"), F.lit(0.5).alias("p_model_state"))
    packed = packing.pack_basecall(ev, keys, rate, ed)
    path = F.concat(F.lit("/Analyses/Basecall_"), "gr", F.lit("/BaseCalled_template/Events_Pack"))
    attrs = _attrs(packed, path, ed_gr=("string", F.col("gr")), state_size=("int", F.col("state_size")), start_time=("int", F.col("start_time")), median_sd_temp=("float", F.lit(0.25)))
    fastq = own.select(*keys, F.concat(F.lit("@n\n"), "sq", F.lit("\n+\n"), F.expr("repeat('!', length(sq))"), F.lit("\n")).alias("fq"))
    detected = ed.drop("st").withColumn("rn", F.lit("r"))
    r = _open(_files(spark, sf), ("read_file", "raw_read", "ed_group", "ed_read", "ed_event", "bc_group", "bc_strand", "bc_fastq", "bc_event", "attr", "pack_stream"), ed_event=detected, fastq=fastq, streams=_streams(packed, path, Rel_Skip="rel_skip", Move="move", P_Model_State="p_model_state"), attrs=attrs).of_all()
    return r.events(0).withColumns({"start": F.round("start", 9), "length": F.round("length", 9)})


# what strands and groups have ---------------------------------------------------------
@query(f"{_FQ}, rn // 25 % 2 = 1 AS packed_fastq FROM v_seq")
def file_have_fastq(spark, sf):
    """Strands with fastq in either form, and which form it is."""
    rows = _fastq(spark, sf)
    some = F.expr("cast(gr as int) % 2") == 1
    packed = packing.pack_fastq(rows.where(some))
    path = F.concat(F.lit("/Analyses/Basecall_"), "gr", F.lit("/BaseCalled_"), F.element_at(F.array(F.lit("template"), F.lit("complement"), F.lit("2D")), F.col("st").cast("int") + 1), F.lit("/Fastq_Pack"))
    r = _open(_files(spark, sf), ("bc_strand",), fastq=rows.where(~some), streams=_streams(packed, path, BP="bp", QV="qv"))
    return r.have("fastq", packed=True).unionByName(r.have("fastq", packed=False)).select("file_id", "gr", "st", "packed_fastq")


_STRANDS = f"WITH {SQL['v_seq']} SELECT CAST(rn % 25 AS VARCHAR) AS file_id, printf('%03d', rn // 25) AS gr"


@query(f"{_STRANDS} FROM v_seq WHERE rn % 3 = 2")
def file_strand_groups(spark, sf):
    """Groups with a 2D strand."""
    r = _open(_files(spark, sf), ("bc_group", "bc_strand"), fastq=_fastq(spark, sf))
    return r.bc_strand_groups(2).select("file_id", "gr")


@query("SELECT CAST(c_custkey % 25 AS VARCHAR) AS file_id, printf('%06d', c_custkey) AS gr, unnest(['config', 'params', 'summary']) AS kind, unnest(['a/b', 'name', 'x']) AS key, unnest([c_mktsegment, c_name, CAST(c_nationkey AS VARCHAR)]) AS value FROM customer")
def file_bc_params(spark, sf):
    """Parameters, configuration and summary of basecall groups, the last two with what lies below."""
    c = table(spark, sf, "customer").select(_file("c_custkey"), F.format_string("%06d", "c_custkey").alias("gr"), "c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"))
    at = lambda more: F.concat(F.lit("/Analyses/Basecall_"), "gr", F.lit(more))
    attrs = _attrs(c, at(""), name=("string", F.col("c_name"))).unionByName(_attrs(c, at("/Configuration/a"), b=("string", F.col("c_mktsegment")))).unionByName(_attrs(c, at("/Summary"), x=("string", F.col("nation"))))
    r = _open(_files(spark, sf), ("bc_group",), attrs=attrs).of_all()
    of = lambda kind: r.bc_column(kind).select("file_id", "gr", F.lit(kind).alias("kind"), F.explode(kind))
    return of("params").unionByName(of("config")).unionByName(of("summary"))


@query("SELECT CAST(o_orderkey % 25 AS VARCHAR) AS file_id, printf('%06d', o_orderkey) AS gr, 'r' AS rn, o_custkey AS read_number, CAST(o_orderkey AS BIGINT) AS start_time, CAST(2 AS BIGINT) AS abasic_found, o_totalprice AS median_before FROM orders")
def file_ed_params(spark, sf):
    """Params of detected events, with the default of a missing member."""
    o = table(spark, sf, "orders").select(_file("o_orderkey"), F.format_string("%06d", "o_orderkey").alias("gr"), F.lit("r").alias("rn"), "o_custkey", "o_orderkey", "o_totalprice")
    params = F.struct(F.col("o_custkey").alias("read_number"), F.col("o_orderkey").alias("start_time"), F.col("o_totalprice").alias("median_before"))
    event = o.select("file_id", "gr", "rn", F.lit(0).alias("event_idx"), F.col("o_orderkey").alias("start"), F.lit(1).cast("bigint").alias("length"), F.lit(1.0).alias("mean"), F.lit(1.0).alias("stdv"))
    r = _open(_files(spark, sf), ("ed_group", "ed_read"), ed_event=event, ed_read=o.select("file_id", "gr", "rn", params.alias("params"))).of_all()
    return r.ed_events_params().select("file_id", "gr", "rn", "params.read_number", "params.start_time", "params.abasic_found", "params.median_before")


@query("SELECT c_custkey % 25 AS file, '/b/' || c_custkey AS obj_path, name, value FROM (SELECT c_custkey, unnest(['name', 'segment']) AS name, unnest([c_name, c_mktsegment]) AS value FROM customer)")
def attr_copy(spark, sf):
    """The attributes below one group copied below another."""
    c = table(spark, sf, "customer").select(F.col("c_custkey"), _file("c_custkey"), "c_name", "c_mktsegment")
    attr = _attrs(c, F.concat(F.lit("/a/"), F.col("c_custkey").cast("string")), name=("string", F.col("c_name")), segment=("string", F.col("c_mktsegment")))
    return catalog.copy_attributes(attr, attr.limit(0), "/a", "/b", recurse=True).select(F.col("file_id").cast("bigint").alias("file"), "obj_path", "name", "value")


# rates, times, equality ------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, l_partkey, printf('%.2f', CASE WHEN l_tax < 0.001 THEN 'nan'::DOUBLE ELSE l_quantity / l_tax END) AS rate, sqrt(l_extendedprice) AS stdv FROM lineitem")
def rates_and_deviations(spark, sf):
    stdv = expr.event_stdv(None, F.col("l_extendedprice"))
    rate = F.regexp_replace(expr.bases_per_second(F.col("l_quantity"), F.col("l_tax")), "NaN", "nan")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", rate.alias("rate"), stdv.alias("stdv"))


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM events")
def experiment_start(spark, sf):
    """Start times read from both of their text forms."""
    e = table(spark, sf, "events").select("event_id", F.unix_timestamp(F.date_trunc("second", "ts")).alias("seconds"))
    text = F.when(F.col("event_id") % 2 == 0, F.col("seconds").cast("string")).otherwise(F.date_format(F.timestamp_seconds("seconds"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", F.unix_timestamp(expr.start_time_of(text)).alias("seconds"))


@query(f"WITH {SQL['v_raw']} SELECT {_FILE.format('rn')}, CAST({START} + idx AS BIGINT) AS start, CAST(s AS SMALLINT) AS curr_i FROM v_raw")
def file_dump_raw(spark, sf):
    """The dump of raw samples with the time of each."""
    from porelight.operators import report

    r = _open(_files(spark, sf), ("read_file", "raw_read"), raw=_signals(spark, sf)).of_all()
    rows = r.raw_int_samples().join(r["read_file"].select("file_id", "channel.*"), "file_id").withColumn("start_time", F.col("params.start_time"))
    return report.dump_raw(rows, as_int=True, with_time=True).select("file_id", "start", "curr_i")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0")
def struct_equality(spark, sf):
    """Structs that are not those of the other table, or are missing there."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit(float("nan")).alias("x"))
    other = o.where("o_orderkey % 13 != 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0))
    return packing.differing(o, other, ["o_orderkey"])


_LEN_COUNTS = f"WITH {SQL['v_ed']}, h AS (SELECT v, (SELECT count(*) FROM v_ed WHERE CASE WHEN len BETWEEN 1 AND 100 THEN len ELSE 0 END = v) + 1 AS n FROM range(0, 101) t(v))"


@query(f"{_LEN_COUNTS} SELECT * FROM (SELECT 'least' AS \"end\", v, n FROM h ORDER BY n, v LIMIT 10) UNION ALL SELECT * FROM (SELECT 'most', v, n FROM h ORDER BY n DESC, v DESC LIMIT 10)")
def symbol_extremes(spark, sf):
    """The ten rarest and the ten most frequent event lengths, as the trainer of codes reports them."""
    return aggregates.rarest_and_commonest(aggregates.histogram(v_ed(spark, sf), "len", 1, 100))


_LEN_CODE = ", ".join(f"({s}, {len(c)})" for s, c in ED_LEN.items() if s.lstrip("-").isdigit())
_LEN_ESCAPE = next(len(c) for s, c in ED_LEN.items() if not s.lstrip("-").isdigit())


@query(f"{_LEN_COUNTS}, c(v, len) AS (VALUES {_LEN_CODE}) SELECT round(CAST(sum(coalesce(len, {_LEN_ESCAPE}) * n) AS DOUBLE) / sum(n), 9) AS bits FROM h LEFT JOIN c USING (v)")
def mean_code_length(spark, sf):
    """The mean number of bits that the code of event lengths takes."""
    code = spark.createDataFrame(Code("len", ED_LEN, 8).rows(), "map_name string, symbol bigint, is_escape boolean, code string, len int")
    return aggregates.mean_bits(aggregates.histogram(v_ed(spark, sf), "len", 1, 100), code.select("symbol", "len")).select(F.round("bits", 9).alias("bits"))
