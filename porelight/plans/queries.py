"""Queries that apply the library's operators to the driver's tables, each with its oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from porelight.functions import codec, expr
from porelight.functions.codewords import ED_LEN, ED_SKIP, FQ_QV, coders, train
from porelight.operators import aggregates, catalog, derive
from porelight.plans.views import READ, table, v_attr, v_channel, v_ed, v_group, v_raw, v_seq, with_views

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# scalar expressions ----------------------------------------------------------
@query(with_views("SELECT rn, idx, CAST((s + \"offset\") * \"range\" / digitisation AS FLOAT) AS current FROM v_raw JOIN v_channel ON rn % 25 = n_nationkey", "v_raw", "v_channel"))
def raw_to_current(spark, sf):
    raw = v_raw(spark, sf).join(F.broadcast(v_channel(spark, sf)), F.col("rn") % 25 == F.col("n_nationkey"))  # 25 nations
    return raw.select("rn", "idx", expr.to_current(F.col("s"), F.col("digitisation"), F.col("offset"), F.col("range")).alias("current"))


@query("SELECT event_id, CAST(trunc(value * 4000.0::DOUBLE) AS BIGINT) AS samples FROM events")
def time_to_int(spark, sf):
    return table(spark, sf, "events").select("event_id", expr.time_to_int(F.col("value"), F.lit(4000.0)).alias("samples"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((CAST(trunc(l_quantity) AS BIGINT) + 0.5::DOUBLE) / 4000.0::DOUBLE, 9) AS seconds FROM lineitem")
def time_to_float(spark, sf):
    samples = F.col("l_quantity").cast("bigint")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(expr.time_to_float(samples, F.lit(4000.0)), 9).alias("seconds"))


def _fastq(spark, sf):
    seq = v_seq(spark, sf)
    broken = F.col("rn") % 7 == 0  # a record without its third line end
    fq = expr.build_fastq(F.concat(F.lit("read_"), F.col("rn").cast("string")), F.col("sq"))
    return seq.select("rn", F.when(broken, F.substring_index(fq, "\n", 3)).otherwise(fq).alias("fq"))


_FASTQ = "fq AS (SELECT rn, rn % 7 = 0 AS broken, sq FROM v_seq)"


@query(with_views(f", {_FASTQ} SELECT rn, CASE WHEN broken THEN '' ELSE 'read_' || rn END AS name, CASE WHEN broken THEN '' ELSE sq END AS bases, '' AS comment, CASE WHEN broken THEN '' ELSE repeat('!', length(sq)) END AS quality FROM fq", "v_seq").replace(") , fq", "), fq"))
def fastq_split(spark, sf):
    return _fastq(spark, sf).select("rn", expr.split_fastq(F.col("fq")).alias("f")).select("rn", "f.name", "f.bases", "f.comment", "f.quality")


@query(with_views(f", {_FASTQ} SELECT rn, CASE WHEN broken THEN '' ELSE sq END AS bases FROM fq", "v_seq").replace(") , fq", "), fq"))
def fastq_seq(spark, sf):
    return _fastq(spark, sf).select("rn", expr.fastq_bases(F.col("fq")).alias("bases"))


@query("SELECT event_id, q, least(q, 31) & 28 AS masked FROM (SELECT event_id, CAST(trunc(value) AS INTEGER) % 94 AS q FROM events)")
def qv_mask(spark, sf):
    q = F.col("value").cast("int") % 94
    return table(spark, sf, "events").select("event_id", q.alias("q")).select("event_id", "q", expr.masked_quality(F.chr(F.col("q") + 33), 3).alias("masked"))


@query("SELECT event_id, CAST(least(floor(p * 4), 3) AS INTEGER) AS v, least(floor(p * 4), 3) / 4.0::DOUBLE AS p FROM (SELECT event_id, value / 490.0::DOUBLE AS p FROM events)")
def prob_quantise(spark, sf):
    v = table(spark, sf, "events").select("event_id", expr.quantise(F.col("value") / 490.0, 2).alias("v"))
    return v.select("event_id", "v", expr.dequantise(F.col("v"), 2).alias("p"))


@query("SELECT o_orderkey, printf('%d:%02d:%02d.%03d', CAST(trunc(t / 3600) AS BIGINT), CAST(trunc(t / 60) AS BIGINT) % 60, CAST(trunc(t) AS BIGINT) % 60, CAST(trunc(t * 1000) AS BIGINT) % 1000) AS t FROM (SELECT o_orderkey, o_orderkey * 7919 / 4000.0::DOUBLE AS t FROM orders)")
def as_time_report(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", expr.as_time(F.col("o_orderkey") * 7919, F.lit(4000.0)).alias("t"))


# attributes, groups and links ------------------------------------------------
@query(with_views("SELECT obj, string_agg(name || '=' || value, ';' ORDER BY name) AS params FROM v_attr GROUP BY obj", "v_attr"))
def attr_map(spark, sf):
    maps = catalog.attribute_map(v_attr(spark, sf), ["obj"])
    return maps.select("obj", F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("params"))


@query("SELECT c_custkey, coalesce(n, 2) AS abasic_found, coalesce(first, '') AS read_id, coalesce(total, 0.0::DOUBLE) AS start_time, total IS NULL AS no_median FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderpriority) AS first, max(o_totalprice) AS total FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def attr_defaults(spark, sf):
    found = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("first"), F.max("o_totalprice").alias("total"))
    rows = table(spark, sf, "customer").select("c_custkey").join(found, F.col("c_custkey") == F.col("o_custkey"), "left")
    params = expr.with_defaults(F.struct(F.col("total").alias("median_before"), F.col("n").alias("abasic_found"), F.col("first").alias("read_id")))
    return rows.select("c_custkey", params.alias("p"), "total").select("c_custkey", "p.abasic_found", "p.read_id", F.coalesce("total", F.lit(0.0)).alias("start_time"), F.isnan("p.median_before").alias("no_median"))


_CALLER = """SELECT file_id, gr, CASE program WHEN 'ONT Sequencing Workflow' THEN 'metrichor' WHEN 'MinKNOW-Live-Basecalling' THEN 'minknow' WHEN 'ONT Albacore Sequencing Software' THEN 'albacore' ELSE '?' END AS name,
CASE program WHEN 'ONT Sequencing Workflow' THEN packed_ed_gr || '+?' WHEN 'MinKNOW-Live-Basecalling' THEN gr WHEN 'ONT Albacore Sequencing Software' THEN gr ELSE '?' END AS version FROM v_group"""


@query(with_views(_CALLER, "v_group"))
def group_id(spark, sf):
    g = v_group(spark, sf).withColumn("params", F.create_map(F.lit("name"), "program", F.lit("version"), "gr", F.lit("chimaera version"), "packed_ed_gr"))
    return catalog.caller(g).select("file_id", "gr", "name", "version")


_ED = ", ed AS (SELECT DISTINCT c_custkey AS file_id, printf('%03d', k) AS gr FROM customer, range(2) r(k))"


@query(with_views(f"""{_ED} SELECT g.file_id, g.gr,
CASE WHEN g.have_1d THEN g.gr WHEN t.gr_ord < g.gr_ord THEN t.gr ELSE g.gr END AS bc_1d_gr,
CASE WHEN NOT g.have_0 THEN '' ELSE coalesce(a.gr, b.gr, '') END AS ed_gr
FROM v_group g LEFT JOIN v_group t ON t.file_id = g.file_id AND t.gr = regexp_extract(g.basecall_1d, 'Basecall_(.*)$', 1)
LEFT JOIN ed a ON a.file_id = g.file_id AND a.gr = regexp_extract(g.event_detection, 'EventDetection_(.*)$', 1)
LEFT JOIN ed b ON b.file_id = g.file_id AND b.gr = g.packed_ed_gr""", "v_group").replace(") , ed", "), ed"))
def link_resolution(spark, sf):
    ed = table(spark, sf, "customer").select(F.col("c_custkey").alias("file_id"), F.explode(F.array(F.lit("000"), F.lit("001"))).alias("gr"))
    return catalog.resolve_ed(catalog.resolve_1d(v_group(spark, sf)), ed).select("file_id", "gr", "bc_1d_gr", "ed_gr")


@query(with_views("SELECT file_id, min_by(key, gr_ord) AS key FROM v_group GROUP BY file_id", "v_group"))
def default_first(spark, sf):
    return catalog.first_listed(v_group(spark, sf), ["file_id"], "key", "gr_ord")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS file_id, printf('%03d', l_linenumber) AS gr, l_suppkey % 3 AS st,
bool_or(l_partkey % 8 IN (0, 4)) AS have_fastq, bool_or(l_partkey % 8 IN (1, 5)) AS have_events, bool_or(l_partkey % 8 = 2) AND l_suppkey % 3 < 2 AS have_model, bool_or(l_partkey % 8 IN (3, 7)) AND l_suppkey % 3 = 2 AS have_alignment,
NOT bool_or(l_partkey % 8 = 0) AS packed_fastq FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey % 3""")
def strand_flags(spark, sf):
    part = F.element_at(F.array(*map(F.lit, ("Fastq", "Events", "Model", "Alignment", "Fastq_Pack", "Events_Pack", "Model_Pack", "Alignment_Pack"))), (F.col("l_partkey") % 8 + 1).cast("int"))
    gr = F.format_string("%03d", F.col("l_linenumber"))
    link = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("file_id"), catalog.bc_path(gr, F.col("l_suppkey") % 3).alias("group_path"), part.alias("name"), F.col("l_linenumber").alias("ord"), F.lit("group").alias("kind"))
    link = link.where("name != 'Model_Pack'").unionByName(link.where("name = 'Model_Pack'").withColumn("name", F.lit("other")))
    found = catalog.strand_flags(link)
    return found.select("file_id", "gr", F.col("st").cast("bigint").alias("st"), "have_fastq", "have_events", "have_model", "have_alignment", "packed_fastq")


@query("SELECT file_id, path FROM (SELECT c_custkey AS file_id, unnest(['/', '/Analyses', '/Analyses/x' || c_nationkey, '/Raw']) AS path FROM customer) WHERE path IN ('/', '/Analyses') OR (path LIKE '/Analyses/x%' AND file_id % 2 = 0)")
def existence_semi(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("file_id"), "c_nationkey")
    probe = c.select("file_id", F.explode(F.array(F.lit("/"), F.lit("/Analyses"), F.concat(F.lit("/Analyses/x"), F.col("c_nationkey").cast("string")), F.lit("/Raw"))).alias("path"))
    link = c.select("file_id", F.lit("/").alias("group_path"), F.lit("Analyses").alias("name"), F.lit("group").alias("kind")).unionByName(
        c.where("file_id % 2 = 0").select("file_id", F.lit("/Analyses").alias("group_path"), F.concat(F.lit("x"), F.col("c_nationkey").cast("string")).alias("name"), F.lit("dataset").alias("kind")))
    return catalog.object_exists(probe, link)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def missing_anti(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.missing(table(spark, sf, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


# windows and derivations -----------------------------------------------------
_STARTED = ", st AS (SELECT *, 100 + sum(skip) OVER (PARTITION BY rn ORDER BY event_idx) + coalesce(sum(len) OVER (PARTITION BY rn ORDER BY event_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM v_ed)"


def _started(spark, sf, t0=100):
    return derive.skip_to_start(v_ed(spark, sf), READ, ["event_idx"], F.lit(t0))


@query(with_views("SELECT rn, event_idx, skip, len FROM v_ed", "v_ed"))
def pack_skip_len(spark, sf):
    events = _started(spark, sf).select("rn", "event_idx", "start", F.col("len").alias("length"))
    return derive.start_to_skip(events, READ, ["event_idx"], F.lit(100)).select("rn", "event_idx", "skip", "len")


@query(with_views(_STARTED + " SELECT rn, event_idx, CAST(start AS BIGINT) AS start, len FROM st", "v_ed").replace(") , st", "), st"))
def unpack_start(spark, sf):
    return _started(spark, sf).select("rn", "event_idx", "start", "len")


@query(with_views(_STARTED.replace("100 +", "0 +") + """, x AS (SELECT st.rn, st.event_idx, st.start, st.len, count(*) AS n, sum(CAST(s AS DOUBLE)) AS s, sum(CAST(s AS DOUBLE) * s) AS s2, min(s) AS lo, max(s) AS hi
FROM st JOIN v_raw r ON r.rn = st.rn AND r.idx >= st.start AND r.idx < st.start + st.len WHERE st.len > 0 GROUP BY ALL HAVING count(*) = st.len)
SELECT rn, event_idx, n, round(s / n, 6) AS mean, round(CASE WHEN n > 1 AND lo <> hi AND (s2 - s * s / n) / n > 1e-3 THEN sqrt((s2 - s * s / n) / n) ELSE 0 END, 6) AS stdv FROM x""", "v_ed", "v_raw").replace(") , st", "), st"))
def event_mean_stdv(spark, sf):
    raw = v_raw(spark, sf).select("rn", F.col("idx").cast("bigint").alias("sample_idx"), F.col("s").alias("sample"))
    sizes = raw.groupBy("rn").agg(F.count("*").alias("size"))
    inside = _started(spark, sf, 0).join(sizes, "rn").where("len > 0 AND start + len <= size").select("rn", "event_idx", "start", F.col("len").alias("length"))
    found = derive.event_stats(inside, raw, READ)
    return found.select("rn", "event_idx", "n", F.round("mean", 6).alias("mean"), F.round("stdv", 6).alias("stdv"))


@query("""WITH e AS (SELECT vec_id, embedding AS v, unnest(range(0, len(embedding) - 3, 4)) AS start FROM embeddings), p AS (SELECT vec_id, start, list_transform(v[start + 1 : start + 4], lambda x: CAST(x AS DOUBLE)) AS w FROM e),
m AS (SELECT vec_id, start, w, list_sum(w) AS s, list_sum(list_transform(w, lambda x: x * x)) AS s2 FROM p)
SELECT vec_id, start, round(s / 4, 6) AS mean, round(CASE WHEN list_min(w) <> list_max(w) AND (s2 - s * s / 4) / 4 > 1e-3 THEN sqrt((s2 - s * s / 4) / 4) ELSE 0 END, 6) AS stdv FROM m""")
def event_mean_stdv_array(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.explode(F.expr("filter(sequence(0, size(embedding), 4), s -> s <= size(embedding) - 4)")).alias("start"))
    m = e.select("vec_id", F.col("start").cast("bigint").alias("start"), derive.event_stats_array(F.col("embedding"), F.col("start"), F.lit(4)).alias("m"))
    return m.select("vec_id", "start", F.round("m.mean", 6).alias("mean"), F.round("m.stdv", 6).alias("stdv"))


_ASOF = _STARTED.replace("100 +", "0 +") + """, ev AS (SELECT rn, row_number() OVER (PARTITION BY rn ORDER BY event_idx) - 1 AS i, start AS t FROM st WHERE event_idx % 2 = 1),
c AS (SELECT ev.*, (SELECT min(st.event_idx) FROM st WHERE st.rn = ev.rn AND st.start >= ev.t) AS c FROM ev),
j AS (SELECT rn, i, i + max(c - i) OVER (PARTITION BY rn ORDER BY i) AS j FROM c) """


@query(with_views(_ASOF + "SELECT rn, i, CAST(j AS BIGINT) AS j, CAST(j - coalesce(lag(j) OVER (PARTITION BY rn ORDER BY i), -1) - 1 AS BIGINT) AS rel_skip FROM j", "v_ed").replace(") , st", "), st"))
def asof_forward(spark, sf):
    ed = derive.skip_to_start(derive.dealt(v_ed(spark, sf), READ), READ, ["event_idx"], F.lit(0))
    order = F.row_number().over(Window.partitionBy("rn").orderBy("event_idx")) - 1
    ev = ed.where("event_idx % 2 = 1").select("rn", order.cast("bigint").alias("i"), F.col("start").alias("t"))
    return derive.asof_forward(ev, ed, READ, "i", "t", "event_idx", "start").select("rn", "i", "j", "rel_skip")


@query(with_views(_STARTED + ", ix AS (SELECT rn, event_idx, event_idx + sum(skip) OVER (PARTITION BY rn ORDER BY event_idx) AS j FROM v_ed) SELECT ix.rn, ix.event_idx, CAST(ix.j AS BIGINT) AS j, CAST(st.start AS BIGINT) AS start, st.len FROM ix JOIN st ON st.rn = ix.rn AND st.event_idx = ix.j", "v_ed").replace(") , st", "), st"))
def unpack_ev_index(spark, sf):
    ed = _started(spark, sf).select("rn", F.col("event_idx").cast("bigint").alias("j"), "start", "len")
    placed = derive.rel_skip_to_index(v_ed(spark, sf).withColumnRenamed("skip", "rel_skip"), READ, ["event_idx"])
    return placed.select("rn", "event_idx", "j").join(ed, ["rn", "j"]).select("rn", "event_idx", "j", "start", "len")


@query(with_views("SELECT rn, event_idx, CAST(pos AS BIGINT) AS pos, sq[pos + 1 : pos + 5] AS kmer FROM (SELECT v_ed.rn, event_idx, sq, sum(skip) OVER (PARTITION BY v_ed.rn ORDER BY event_idx) AS pos FROM v_ed JOIN v_seq ON v_ed.rn = v_seq.rn)", "v_ed", "v_seq"))
def kmer_walk(spark, sf):
    events = v_ed(spark, sf).join(v_seq(spark, sf), "rn")
    return derive.kmer_walk(events, READ, ["event_idx"], 5, move="skip").select("rn", "event_idx", "pos", "kmer")


@query(with_views("SELECT rn, kmer, pos, CASE WHEN pos >= length(sq) OR strpos(sq[pos + 1 :], kmer) = 0 THEN -1 ELSE strpos(sq[pos + 1 :], kmer) - 1 + pos END AS found, kmer = repeat(kmer[1:1], length(kmer)) AS homopolymer FROM (SELECT rn, sq, sq[5:7] AS kmer, rn % 40 AS pos FROM v_seq WHERE length(sq) >= 7)", "v_seq"))
def kmer_find(spark, sf):
    s = v_seq(spark, sf).where("length(sq) >= 7").select("rn", "sq", expr.kmer_at(F.col("sq"), F.lit(4), 3).alias("kmer"), (F.col("rn") % 40).alias("pos"))
    return s.select("rn", "kmer", "pos", expr.find_kmer(F.col("sq"), F.col("kmer"), F.col("pos")).cast("bigint").alias("found"), expr.is_homopolymer(F.col("kmer")).alias("homopolymer"))


def _steps(spark, sf):
    return v_ed(spark, sf).select("rn", F.col("event_idx").alias("idx"), (F.col("skip") != 0).cast("int").alias("template_step"), (F.col("len") % 2 == 0).cast("int").alias("complement_step"))


_INDICES = """, a AS (SELECT rn, event_idx AS idx, CAST(skip <> 0 AS INTEGER) AS t, CAST(len % 2 = 0 AS INTEGER) AS c FROM v_ed),
i AS (SELECT rn, idx, CASE WHEN t = 1 THEN 4 + sum(t) OVER w - t ELSE -1 END AS template_index, CASE WHEN c = 1 THEN 90 - (sum(c) OVER w - c) ELSE -1 END AS complement_index FROM a WINDOW w AS (PARTITION BY rn ORDER BY idx)) """


@query(with_views(_INDICES + "SELECT rn, idx, CAST(template_index AS BIGINT) AS template_index, CAST(complement_index AS BIGINT) AS complement_index FROM i", "v_ed").replace(") , a", "), a"))
def alignment_indices(spark, sf):
    found = derive.alignment_indices(_steps(spark, sf), READ, F.lit(4), F.lit(90))
    return found.select("rn", "idx", F.col("template_index").cast("bigint").alias("template_index"), F.col("complement_index").cast("bigint").alias("complement_index"))


@query(with_views(_INDICES + ", b AS (SELECT rn, idx, CASE WHEN rn % 11 = 0 AND template_index >= 0 THEN template_index + idx ELSE template_index END AS template_index, complement_index FROM i) SELECT rn, idx, CAST(template_index >= 0 AS INTEGER) AS template_step, CAST(complement_index >= 0 AS INTEGER) AS complement_step, template_index < 0 OR template_index = f + sum(CAST(template_index >= 0 AS INTEGER)) OVER (PARTITION BY rn ORDER BY idx) - 1 AS consistent FROM (SELECT *, min_by(template_index, idx) FILTER (template_index >= 0) OVER (PARTITION BY rn) AS f FROM b)", "v_ed").replace(") , a", "), a"))
def alignment_pack_check(spark, sf):
    found = derive.alignment_indices(_steps(spark, sf), READ, F.lit(4), F.lit(90))
    bent = F.when((F.col("rn") % 11 == 0) & (F.col("template_index") >= 0), F.col("template_index") + F.col("idx")).otherwise(F.col("template_index"))
    return derive.alignment_steps(found.withColumn("template_index", bent), READ).select("rn", "idx", "template_step", "complement_step", "consistent")


# codecs and aggregates ---------------------------------------------------------
@query(with_views(", d AS (SELECT s - lag(s) OVER (PARTITION BY rn ORDER BY idx) AS x FROM v_raw) SELECT v, count(d.b) + 1 AS n FROM (SELECT CAST(range AS BIGINT) AS v FROM range(-101, 101)) LEFT JOIN (SELECT CASE WHEN x BETWEEN -100 AND 100 THEN x ELSE -101 END AS b FROM d WHERE x IS NOT NULL) d ON d.b = v GROUP BY v", "v_raw").replace(") , d", "), d"))
def delta_histogram(spark, sf):
    x = F.col("s") - F.lag("s").over(derive.over(READ, ["idx"]))
    return aggregates.histogram(v_raw(spark, sf).select(x.alias("x")).where("x IS NOT NULL"), "x", -100, 100)


def _size_sql(view: str, value: str, order: str, table_: dict, width: int) -> str:
    words = ", ".join(f"({s}, {len(c)})" for s, c in table_.items() if s != ".")
    return with_views(f""", w(symbol, len) AS (VALUES {words}), x AS (SELECT rn, {order} AS i, CASE WHEN row_number() OVER (PARTITION BY rn ORDER BY {order}) > 1 THEN {value} END AS symbol FROM {view}),
s AS (SELECT x.rn, w.len, sum(CAST(w.len IS NULL AS INTEGER)) OVER (PARTITION BY x.rn ORDER BY i) AS seg FROM x LEFT JOIN w ON w.symbol = x.symbol),
g AS (SELECT rn, seg, count(*) AS n, {width} + ceil((coalesce(sum(len), 0) + {len(table_['.'])}) / 8) AS bytes FROM s GROUP BY rn, seg)
SELECT rn, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM g GROUP BY rn""", view).replace(") , w(", "), w(")


@query(_size_sql("v_ed", "len", "event_idx", ED_LEN, 8))
def huffman_size(spark, sf):
    return derive.packed_size(v_ed(spark, sf), READ, ["event_idx"], "len", coders()["ed_len"])


def _array(rows, value, order):
    """One array per read, in order."""
    pairs = F.sort_array(F.collect_list(F.struct(order, value)))
    return rows.groupBy("rn").agg(F.transform(pairs, lambda p: p[value].cast("bigint")).alias("v"))


@query(with_views("SELECT rn, idx, s FROM v_raw", "v_raw"))
def huffman_roundtrip(spark, sf):
    code = coders()["rw"]
    packed = _array(v_raw(spark, sf), "s", "idx").select("rn", codec.pack_huffman(spark, F.col("v"), code).alias("p"))
    return packed.select("rn", F.posexplode(codec.unpack_huffman(spark, F.col("p"), code)).alias("idx", "s")).select("rn", F.col("idx").cast("bigint").alias("idx"), F.col("s").cast("int").alias("s"))


@query(with_views("SELECT rn, event_idx, skip FROM v_ed", "v_ed"))
def bitpack_roundtrip(spark, sf):
    packed = _array(v_ed(spark, sf), "skip", "event_idx").select("rn", codec.pack_bits(spark, F.col("v"), 2).alias("p"))
    return packed.select("rn", F.posexplode(codec.unpack_bits(spark, F.col("p"))).alias("event_idx", "skip")).select("rn", F.col("event_idx").cast("bigint").alias("event_idx"), "skip")


@query(with_views("SELECT rn, '@read_' || rn || chr(10) || sq || chr(10) || '+' || chr(10) || repeat(chr(CAST(33 + (least(rn % 60, 31) & 28) AS INTEGER)), length(sq)) || chr(10) AS fq FROM v_seq", "v_seq"))
def pack_unpack_fastq(spark, sf):
    from porelight.operators import packing

    fq = v_seq(spark, sf).select("rn", F.concat(F.lit("@read_"), F.col("rn").cast("string"), F.lit("\n"), "sq", F.lit("\n+some comment\n"), F.expr("repeat(chr(33 + rn % 60), length(sq))"), F.lit("\n")).alias("fq"))
    return packing.unpack_fastq(packing.pack_fastq(fq, 3)).select("rn", "fq")


@query(_size_sql("v_ed", "skip", "event_idx", ED_SKIP, 8).replace("SELECT rn, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM g GROUP BY rn", "SELECT CAST(count(DISTINCT rn) AS BIGINT) AS reads, CAST(sum(n) AS BIGINT) AS ed_count, CAST(sum(bytes) * 8 AS BIGINT) AS ed_skip_bits, round(sum(bytes) * 8 / sum(n), 6) AS bits_per_value FROM g"))
def pack_counters(spark, sf):
    code = coders()["ed_skip"]
    packed = _array(v_ed(spark, sf), "skip", "event_idx").select("rn", F.size("v").cast("bigint").alias("n"), codec.pack_huffman(spark, F.col("v"), code).alias("p"))
    counts = packed.agg(F.count("*").alias("reads"), F.sum("n").alias("ed_count"), F.sum(codec.stream_bits(F.col("p"))).alias("ed_skip_bits"))
    return counts.withColumn("bits_per_value", F.round(F.col("ed_skip_bits") / F.col("ed_count"), 6))


@query(with_views(_STARTED + " SELECT rn, CAST(max_by(start + len, event_idx) - min_by(start, event_idx) AS BIGINT) AS called FROM st GROUP BY rn", "v_ed").replace(") , st", "), st"))
def called_duration(spark, sf):
    return aggregates.called_duration(_started(spark, sf), READ, "event_idx", "start", "len")


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey")
def list_join(spark, sf):
    return aggregates.joined_list(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderkey").cast("string"), "o_orderkey", ",").withColumnRenamed("list", "keys")


@query("""SELECT file_id, 'cid/channel_number' AS path, CAST(file_id % 512 AS VARCHAR) AS value FROM (SELECT c_custkey AS file_id FROM customer)
UNION ALL SELECT c_custkey, 'cid/sampling_rate', '4000' FROM customer
UNION ALL SELECT o_custkey, 'rs/Read_' || o_orderkey || '/packed', CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END FROM orders""")
def ls_long_form(spark, sf):
    from porelight.operators import report

    files = table(spark, sf, "customer").select(F.col("c_custkey").alias("file_id"), F.struct((F.col("c_custkey") % 512).cast("string").alias("channel_number"), F.lit(4000.0).alias("sampling_rate")).alias("channel"))
    reads = table(spark, sf, "orders").select(F.col("o_custkey").alias("file_id"), F.concat(F.lit("Read_"), F.col("o_orderkey").cast("string")).alias("rn"), (F.col("o_orderstatus") == "F").alias("packed"))
    return report.channel_lines(files).unionByName(report.packed_lines(reads, "rs")).select("file_id", "path", "value")


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AS packed, o_totalprice FROM orders WHERE o_orderstatus = 'F' OR o_orderkey % 3 = 0")
def union_packed_unpacked(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    keep = ["o_orderkey", "o_totalprice"]
    return catalog.prefer_unpacked(o.where("o_orderkey % 3 = 0").select(keep), o.where("o_orderstatus = 'F'").select(keep), ["o_orderkey"]).select("o_orderkey", "packed", "o_totalprice")


@query("SELECT min(printf('%03d', range)) AS suffix FROM range(1000) WHERE printf('%03d', range) NOT IN (SELECT printf('%03d', p_partkey - 1) FROM part WHERE p_partkey % 97 <> 0)")
def next_free_suffix(spark, sf):
    used = table(spark, sf, "part").where("p_partkey % 97 != 0").select(F.format_string("%03d", F.col("p_partkey") - 1).alias("gr"))
    return catalog.next_free_suffix(used, "gr")


@query(with_views(_STARTED + " SELECT rn, count(*) AS n, CAST(sum(CAST(event_idx % 5 = 0 AND rn % 4 = 0 AS INTEGER)) AS BIGINT) AS mismatches FROM st GROUP BY rn", "v_ed").replace(") , st", "), st"))
def verify_tolerance(spark, sf):
    from porelight.operators import packing

    events = _started(spark, sf).select("rn", "event_idx", F.col("start").cast("double").alias("start"), F.col("len").cast("double").alias("mean"))
    off = F.when((F.col("event_idx") % 5 == 0) & (F.col("rn") % 4 == 0), 0.2).otherwise(0.0005)
    again = events.withColumns({"start": F.col("start") + 0.0005, "mean": F.col("mean") + off})
    return packing.mismatches(events, again, READ, ["event_idx"], {"start": 1e-3, "mean": 0.1})


@query()
def huffman_train(spark, sf):
    x = F.col("s") - F.lag("s").over(derive.over(READ, ["idx"]))
    counts = {r["v"]: r["n"] - 1 for r in aggregates.histogram(v_raw(spark, sf).select(x.alias("x")).where("x IS NOT NULL"), "x", -100, 100).collect()}  # 202 rows
    return spark.createDataFrame(train(counts, -100, 100), "symbol string, code string")


@query(f"SELECT q, n, CASE WHEN q <= 31 THEN l END AS len FROM (SELECT CAST(trunc(value) AS BIGINT) % 40 AS q, count(*) AS n FROM events GROUP BY 1) LEFT JOIN (VALUES {', '.join(f'({s}, {len(c)})' for s, c in FQ_QV.items() if s != '.')}) w(s, l) ON s = q")
def codeword_lookup(spark, sf):
    q = table(spark, sf, "events").groupBy((F.col("value").cast("bigint") % 40).alias("q")).agg(F.count("*").alias("n"))
    words = spark.createDataFrame([(s, n) for s, (_, n) in coders()["fq_qv"].words.items()], "q bigint, len int")
    return q.join(F.broadcast(words), "q", "left")  # 32 words
