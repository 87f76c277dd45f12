"""Typed access to everything a set of read files holds.

Each method is a projection of a table with the arguments as filters. An
argument left out means, per file, the first in the listing. Packed forms are
decoded where there is no unpacked one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porelight.functions import expr
from porelight.functions.codewords import Code, coders
from porelight.operators import catalog, packing
from porelight.runtime import empty
from porelight.schema import TABLES


class Reads:
    """The logical tables by name; tables that are not given are empty."""

    def __init__(self, spark, tables: dict[str, DataFrame], codes: dict[str, Code] | None = None):
        self.spark, self.codes = spark, codes or coders()
        self.tables = {name: tables[name] if name in tables else empty(spark, ddl) for name, ddl in TABLES.items()}

    @classmethod
    def open(cls, spark, paths: list[str], recursive: bool = False, codes: dict[str, Code] | None = None) -> "Reads":
        from porelight.sources import reads

        found = reads.files(spark, paths, recursive)
        return cls(spark, {name: reads.load(found, name) for name in reads.EXTRACT if name != "valid"}, codes)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    # defaults ------------------------------------------------------------------
    def _pick(self, rows: DataFrame, name: str, order: str, value: str | None) -> DataFrame:
        """file_id and the value asked for, or each file's first."""
        if value is not None:
            return rows.where(F.col(name) == value).select("file_id", name).distinct()
        return catalog.first_listed(rows, ["file_id"], name, order)

    def _only(self, rows: DataFrame, chosen: DataFrame) -> DataFrame:
        return rows.join(chosen, [c for c in chosen.columns if c in rows.columns], "left_semi")

    # files -----------------------------------------------------------------------
    def file_version(self) -> DataFrame:
        return self["read_file"].select("file_id", "file_version")

    def channel(self) -> DataFrame:
        return self["read_file"].select("file_id", expr.have_channel(F.col("channel")).alias("have_channel"), "channel.*")

    def sampling_rate(self) -> DataFrame:
        return self["read_file"].where(expr.have_channel(F.col("channel"))).select("file_id", "channel.sampling_rate")

    def attributes_of(self, kind: str) -> DataFrame:
        """Params of ``tracking``, ``context`` or ``sequences`` of the files that have them."""
        return self["read_file"].where(F.size(kind) > 0).select("file_id", F.col(kind).alias("params"))

    # raw samples -------------------------------------------------------------------
    def raw_read_names(self) -> DataFrame:
        return self["raw_read"].orderBy("file_id", "rn_ord").select("file_id", "rn", "packed")

    def have_raw(self, rn: str | None = None) -> DataFrame:
        return catalog.lookup(self["raw_read"], rn=rn).select("file_id").distinct()

    def raw_params(self, rn: str | None = None) -> DataFrame:
        return self._only(self["raw_read"], self._pick(self["raw_read"], "rn", "rn_ord", rn)).select("file_id", "rn", "params")

    def _streams(self, path: Column, stream: str, name: str) -> DataFrame:
        """keys of an object path with one of its streams."""
        return self["pack_stream"].where(F.col("stream") == stream).select("file_id", path.alias("__path"), F.struct("bytes", "params").alias(name))

    def raw_int_samples(self, rn: str | None = None) -> DataFrame:
        """file_id, rn, params, signal of both storage forms."""
        chosen = self._only(self["raw_read"], self._pick(self["raw_read"], "rn", "rn_ord", rn))
        plain = chosen.where("NOT packed").select("file_id", "rn", "params", "signal")
        streams = self._streams(F.regexp_extract("obj_path", "^/Raw/Reads/([^/]+)/Signal_Pack$", 1), "Signal", "raw").withColumnRenamed("__path", "rn")
        packed = packing.unpack_raw(chosen.where("packed").drop("signal").join(streams, ["file_id", "rn"]), self.codes["rw"])
        return plain.unionByName(packed.select(*plain.columns))

    def raw_samples(self, rn: str | None = None) -> DataFrame:
        """The samples in picoampere."""
        channel = self["read_file"].select("file_id", "channel")
        joined = self.raw_int_samples(rn).join(channel, "file_id")
        current = F.transform("signal", lambda s: expr.to_current(s, F.col("channel.digitisation"), F.col("channel.offset"), F.col("channel.range")))
        return joined.select("file_id", "rn", "params", current.alias("signal"))

    # detected events -------------------------------------------------------------------
    def ed_groups(self) -> DataFrame:
        return self["ed_group"].orderBy("file_id", "gr_ord").select("file_id", "gr", "params")

    def _ed_chosen(self, gr: str | None, rn: str | None) -> DataFrame:
        own = self._only(self["ed_read"], self._pick(self["ed_group"], "gr", "gr_ord", gr))
        return self._only(own, self._pick(own, "rn", "rn_ord", rn))

    def ed_read_names(self, gr: str | None = None) -> DataFrame:
        return self._only(self["ed_read"], self._pick(self["ed_group"], "gr", "gr_ord", gr)).orderBy("file_id", "rn_ord").select("file_id", "gr", "rn", "packed")

    def ed_events_params(self, gr: str | None = None, rn: str | None = None) -> DataFrame:
        return self._ed_chosen(gr, rn).select("file_id", "gr", "rn", "params")

    def ed_events(self, gr: str | None = None, rn: str | None = None) -> DataFrame:
        """Events of both storage forms; packed ones are rebuilt from the raw samples of the read of the same name."""
        chosen = self._ed_chosen(gr, rn)
        keys = ["file_id", "gr", "rn"]
        plain = self._only(self["ed_event"], chosen.where("NOT packed").select(*keys))
        packed = self._only(self.packed_detected(), chosen.select(*keys))
        signal = self.raw_samples_of_all().select("file_id", "rn", "signal", F.col("params.start_time").alias("rs_start"))
        reads = packed.select(*keys).join(signal, ["file_id", "rn"])
        return plain.select(*keys, "event_idx", "start", "length", "mean", "stdv").unionByName(packing.unpack_detected(packed, reads, keys, self.codes))

    def of_all(self) -> "Reads":
        """The same tables, but an argument left out means every one rather than the first."""
        every = Reads(self.spark, self.tables, self.codes)
        every._pick = lambda rows, name, order, value: rows.select("file_id", name).distinct()
        return every

    def raw_samples_of_all(self) -> DataFrame:
        """The samples in picoampere of every read of every file."""
        return self.of_all().raw_samples()

    def packed_raw(self) -> DataFrame:
        """Packed reads with their stream ``raw``."""
        streams = self._streams(F.regexp_extract("obj_path", "^/Raw/Reads/([^/]+)/Signal_Pack$", 1), "Signal", "raw").withColumnRenamed("__path", "rn")
        return self["raw_read"].where("packed").select("file_id", "rn", F.col("params.start_time").alias("start_time")).join(streams, ["file_id", "rn"])

    def packed_detected(self) -> DataFrame:
        """Packed detected events: file_id, gr, rn, start_time, skip, len."""
        path, keys = r"^/Analyses/EventDetection_([^/]+)/Reads/([^/]+)/Events_Pack$", ["file_id", "gr", "rn"]
        parts = self["pack_stream"].select("file_id", F.regexp_extract("obj_path", path, 1).alias("gr"), F.regexp_extract("obj_path", path, 2).alias("rn"), "stream", F.struct("bytes", "params").alias("s"))
        streams = parts.where("rn != ''").groupBy(*keys).agg(_stream("Skip").alias("skip"), _stream("Len").alias("len"))
        return self["ed_read"].where("packed").select(*keys, F.col("params.start_time").alias("start_time")).join(streams, keys)

    def _packed_strands(self, name: str) -> DataFrame:
        """file_id, gr, st, obj_path, stream, s of the packed objects of that name in basecall groups."""
        path = rf"^/Analyses/Basecall_([^/]+)/BaseCalled_(template|complement|2D)/{name}$"
        st = (F.array_position(F.array(*map(F.lit, catalog.STRANDS)), F.regexp_extract("obj_path", path, 2)) - 1).cast("tinyint")
        rows = self["pack_stream"].select("file_id", F.regexp_extract("obj_path", path, 1).alias("gr"), st.alias("st"), "obj_path", "stream", F.struct("bytes", "params").alias("s"))
        return rows.where("gr != ''")

    def _own_attributes(self) -> DataFrame:
        """file_id, obj_path and the attributes there as a map."""
        return self["attr"].groupBy("file_id", "obj_path").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("a"))

    def packed_fastq(self) -> DataFrame:
        """file_id, gr, st, read_name, bp, qv, n."""
        parts = self._packed_strands("Fastq_Pack").groupBy("file_id", "gr", "st", "obj_path").agg(_stream("BP").alias("bp"), _stream("QV").alias("qv"))
        name = self["attr"].where("name = 'read_name'").select("file_id", "obj_path", F.col("value").alias("read_name"))
        size = F.element_at("bp.params", F.lit("size")).cast("bigint").alias("n")
        return parts.join(name, ["file_id", "obj_path"]).select("file_id", "gr", "st", "read_name", "bp", "qv", size)

    # basecalls ---------------------------------------------------------------------------
    def bc_groups(self) -> DataFrame:
        """The groups with their caller and resolved links."""
        flags = self["bc_strand"].groupBy("file_id", "gr").agg(F.bool_or(F.col("st") < 2).alias("have_1d"), F.bool_or(F.col("st") == 0).alias("have_0"))
        g = self["bc_group"].drop("bc_1d_gr", "ed_gr").join(flags, ["file_id", "gr"], "left").fillna(False, ["have_1d", "have_0"])
        param = lambda k: F.try_element_at("params", F.lit(k))
        linked = g.withColumns({"basecall_1d": param("basecall_1d"), "event_detection": param("event_detection"), })
        strand0 = rf"^/Analyses/Basecall_([^/]+)/BaseCalled_{catalog.STRANDS[0]}/Events_Pack$"
        named = self["attr"].where("name = 'ed_gr'").select("file_id", F.regexp_extract("obj_path", strand0, 1).alias("gr"), F.col("value").alias("packed_ed_gr")).where("gr != ''")
        linked = linked.join(named, ["file_id", "gr"], "left")
        return catalog.resolve_ed(catalog.resolve_1d(linked), self["ed_group"]).drop("basecall_1d", "event_detection", "packed_ed_gr")

    def bc_strand_groups(self, st: int) -> DataFrame:
        return catalog.strand_groups(self["bc_group"].select("file_id", "gr", "gr_ord"), self["bc_strand"], st)

    def description(self, gr: str) -> DataFrame:
        """What a group is and has, per strand."""
        return self.bc_groups().where(F.col("gr") == gr).join(self["bc_strand"], ["file_id", "gr"], "left")

    def _bc_chosen(self, st: int | None, gr: str | None) -> DataFrame:
        rows = self["bc_group"].select("file_id", "gr", "gr_ord")
        return self._pick(self.bc_strand_groups(st) if st is not None and gr is None else rows, "gr", "gr_ord", gr)

    def bc_column(self, name: str, gr: str | None = None) -> DataFrame:
        """``params``, ``log``, ``config`` or ``summary`` of a group."""
        return self._only(self["bc_group"], self._bc_chosen(None, gr)).select("file_id", "gr", name)

    def fastq(self, st: int, gr: str | None = None) -> DataFrame:
        """file_id, gr, st, fq of both storage forms."""
        chosen, keys = self._bc_chosen(st, gr), ["file_id", "gr", "st"]
        plain = self._only(self["bc_fastq"].where(F.col("st") == st), chosen)
        packed = self._only(self.packed_fastq().where(F.col("st") == st), chosen)
        again = packing.unpack_fastq(packed, self.codes)
        return plain.unionByName(again.join(plain.select(*keys), keys, "left_anti").select(*plain.columns))

    def bases(self, st: int, gr: str | None = None) -> DataFrame:
        return self.fastq(st, gr).select("file_id", "gr", "st", expr.fastq_bases(F.col("fq")).alias("sq"))

    def _of_1d(self, table: str, st: int, gr: str | None) -> DataFrame:
        """Rows of a strand of the 1D group that a group links to."""
        link = self.bc_groups().select("file_id", "gr", "bc_1d_gr")
        source = self._only(link, self._bc_chosen(st, gr)).select("file_id", F.col("bc_1d_gr").alias("gr"))
        return self._only(self[table].where(F.col("st") == st), source)

    def model(self, st: int, gr: str | None = None) -> DataFrame:
        return self._of_1d("bc_model_state", st, gr)

    def model_params(self, st: int, gr: str | None = None) -> DataFrame:
        """The model's file and parameters."""
        return self._of_1d("bc_model_params", st, gr)

    def events(self, st: int, gr: str | None = None) -> DataFrame:
        """Basecall events of both storage forms; packed ones are rebuilt from the strand's bases and the detected events."""
        keys = ["file_id", "gr", "st"]
        plain = self._of_1d("bc_event", st, gr)
        strands = self._of_1d("bc_strand", st, gr).where("have_events AND packed_events").select(*keys)
        if not strands.head(1):  # a look at the flags saves the plan below, which reads most tables
            return plain
        parts = self._packed_strands("Events_Pack").join(strands, keys, "left_semi").groupBy(*keys, "obj_path")
        packed = parts.agg(*(_stream(n).alias(c) for n, c in (("Rel_Skip", "rel_skip"), ("Skip", "skip"), ("Len", "len"), ("Move", "move"), ("P_Model_State", "p_model_state")))).join(self._own_attributes(), ["file_id", "obj_path"])
        of = lambda k, kind: F.try_element_at("a", F.lit(k)).cast(kind).alias(k)
        packed = packed.select(*keys, "rel_skip", "skip", "len", "move", "p_model_state", of("ed_gr", "string"), of("state_size", "int"), of("start_time", "bigint"), of("median_sd_temp", "double"))
        rate = self["read_file"].select("file_id", F.col("channel.sampling_rate").alias("rate"))
        own = packed.select(*keys, F.coalesce("ed_gr", F.lit("")).alias("ed_gr"), "state_size", F.coalesce("median_sd_temp", F.lit(0.0)).alias("median_sd_temp")).join(rate, "file_id")
        first = catalog.first_listed(self["ed_read"], ["file_id", "gr"], "rn", "rn_ord")
        linked = self.of_all().ed_events().join(first, ["file_id", "gr", "rn"], "left_semi").withColumnRenamed("gr", "ed_gr").drop("rn")
        detected = own.where("ed_gr != ''").select(*keys, "ed_gr").join(linked, ["file_id", "ed_gr"]).drop("ed_gr")
        alone = packed.where("skip IS NOT NULL")  # without a link the events' own skips and lengths take the place of detected ones
        if alone.head(1):
            signal = self.raw_samples_of_all().join(catalog.first_listed(self["raw_read"], ["file_id"], "rn", "rn_ord"), ["file_id", "rn"], "left_semi").select("file_id", "signal", F.col("params.start_time").alias("rs_start"))
            implicit = packing.implicit_detected(alone.select(*keys, "skip", "len", "start_time"), alone.select(*keys).join(signal, "file_id"), keys, self.codes)
            detected = detected.unionByName(implicit.select(*detected.columns))
        bases = self.of_all().fastq(st).select(*keys, expr.fastq_bases(F.col("fq")).alias("sq")).join(own.drop("ed_gr"), keys)
        again = packing.unpack_basecall(packed, bases, detected, keys, F.col("rate"), F.col("median_sd_temp"), F.col("state_size"), self.codes)
        return plain.unionByName(again.select(*plain.columns))

    def events_params(self, st: int, gr: str | None = None) -> DataFrame:
        return self._of_1d("bc_events_params", st, gr)

    def alignment(self, gr: str | None = None) -> DataFrame:
        """Alignments of both storage forms; packed ones are rebuilt from the bases of the 2D strand."""
        chosen, keys = self._bc_chosen(2, gr), ["file_id", "gr"]
        plain = self._only(self["bc_alignment"], chosen)
        parts = self._only(self._packed_strands("Alignment_Pack").where("st = 2"), chosen).join(plain.select(*keys).distinct(), keys, "left_anti").groupBy(*keys, "obj_path")
        packed = parts.agg(*(_stream(n).alias(n.lower()) for n in ("Template_Step", "Complement_Step", "Move"))).join(self._own_attributes(), ["file_id", "obj_path"])
        of = lambda k: F.element_at("a", F.lit(k)).cast("bigint")
        packed = packed.select(*keys, "template_step", "complement_step", "move", of("template_index_start").alias("template_start"), of("complement_index_start").alias("complement_start"), of("kmer_size").cast("int").alias("kmer_size"))
        again = packing.unpack_alignment(packed, self.of_all().bases(2).select(*keys, "sq"), keys, self.codes)
        return plain.unionByName(again.withColumn("idx", F.col("idx").cast("int")).select(*plain.columns))

    def have(self, what: str, st: int | None = None, gr: str | None = None, packed: bool | None = None) -> DataFrame:
        """Files and groups with a strand that has ``fastq``, ``events``, ``model`` or ``alignment``, in either form unless ``packed`` says which.

        Events and models are those of the 1D group that a group links to.
        """
        own = self["bc_strand"]
        if what in ("events", "model"):
            link = self.bc_groups().select("file_id", F.col("gr").alias("of"), F.col("bc_1d_gr").alias("gr"))
            own = own.join(link, ["file_id", "gr"]).drop("gr").withColumnRenamed("of", "gr")
        rows = own.where(F.col(f"have_{what}"))
        if packed is not None and what != "model":
            rows = rows.where(F.col(f"packed_{what}") == packed)
        return catalog.lookup(rows, st=st, gr=gr).select("file_id", "gr", "st", *([f"packed_{what}"] if what != "model" else []))

    def packs(self, suffix: str) -> DataFrame:
        """Streams of the packed objects whose path ends so, one column each."""
        rows = self["pack_stream"].where(F.endswith("obj_path", F.lit(suffix)))
        return rows.groupBy("file_id", "obj_path").agg(F.map_from_entries(F.collect_list(F.struct("stream", F.struct("bytes", "params")))).alias("streams"))


def _stream(name: str) -> Column:
    """The stream of that name among an object's."""
    return F.max_by("s", F.when(F.col("stream") == name, 1))
