"""Catalog of reads and groups, links between them, defaults, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from porelight.functions import expr

STRANDS = ("template", "complement", "2D")
ROOTS = {"channel": "/UniqueGlobalKey/channel_id", "tracking": "/UniqueGlobalKey/tracking_id", "context": "/UniqueGlobalKey/context_tags", "sequences": "/Sequences/Meta"}
ED, BC = "/Analyses/EventDetection_", "/Analyses/Basecall_"


# paths ---------------------------------------------------------------------
def raw_path(rn: Column, packed: bool = False, part: str = "") -> Column:
    return F.concat(F.lit("/Raw/Reads/"), rn, F.lit({"params": "", "signal": "/Signal"}.get(part or "signal", "") + ("_Pack" if packed else "")))


def ed_path(gr: Column, rn: Column | None = None, packed: bool = False) -> Column:
    base = F.concat(F.lit(ED), gr)
    return base if rn is None else F.concat(base, F.lit("/Reads/"), rn, F.lit("/Events_Pack" if packed else "/Events"))


def bc_path(gr: Column, st: Column | None = None, name: str = "", packed: bool = False) -> Column:
    base = F.concat(F.lit(BC), gr)
    if st is not None:
        base = F.concat(base, F.lit("/BaseCalled_"), F.element_at(F.array(*map(F.lit, STRANDS)), st.cast("int") + 1))
    return F.concat(base, F.lit(f"/{name}{'_Pack' if packed else ''}")) if name else base


def split_path(path: Column) -> tuple[Column, Column]:
    """(directory, name) of an object."""
    return F.regexp_replace(F.regexp_replace(path, "/[^/]*$", ""), "^$", "/"), F.substring_index(path, "/", -1)


# existence -----------------------------------------------------------------
def object_exists(probe: DataFrame, link: DataFrame, kinds: tuple[str, ...] = ("group", "dataset")) -> DataFrame:
    """Rows of ``probe`` (file_id, path) that are there as one of ``kinds``; the root is a group."""
    there = link.where(F.col("kind").isin(*kinds)).select("file_id", F.concat(F.regexp_replace("group_path", "/$", ""), F.lit("/"), "name").alias("path"))
    found = probe.join(there, ["file_id", "path"], "left_semi")
    return found.unionByName(probe.where("path = '/'")) if "group" in kinds else found


def attribute_exists(probe: DataFrame, attr: DataFrame) -> DataFrame:
    directory, name = split_path(F.col("path"))
    keyed = probe.withColumns({"__d": directory, "__n": name})
    return keyed.join(attr.select("file_id", F.col("obj_path").alias("__d"), F.col("name").alias("__n")), ["file_id", "__d", "__n"], "left_semi").select(*probe.columns)


def exists(probe: DataFrame, link: DataFrame, attr: DataFrame) -> DataFrame:
    """An attribute or a dataset; a group does not count."""
    return attribute_exists(probe, attr).unionByName(object_exists(probe, link, ("dataset",))).distinct()


def missing(rows: DataFrame, needed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(needed.select(*keys), keys, "left_anti")


# attributes ----------------------------------------------------------------
def attribute_map(attr: DataFrame, keys: list[str] = ("file_id", "obj_path")) -> DataFrame:
    """keys, params: one map per object, its keys sorted."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "value")))
    return attr.groupBy(*keys).agg(F.map_from_entries(pairs).alias("params"))


def attribute_tree(attr: DataFrame, root: str) -> DataFrame:
    """file_id, params of all attributes at and below ``root``, named by their path from it."""
    inside = attr.where((F.col("obj_path") == root) | F.startswith(F.col("obj_path"), F.lit(f"{root}/")))
    name = F.concat(F.substring("obj_path", len(root) + 2, 1 << 30), F.when(F.col("obj_path") == root, "").otherwise("/"), "name")
    return attribute_map(inside.select("file_id", name.alias("name"), "value"), ["file_id"])


def map_rows(maps: DataFrame, obj_path: Column, params: str = "params") -> DataFrame:
    """The inverse of ``attribute_map``: attributes as text."""
    return maps.select("file_id", obj_path.alias("obj_path"), F.explode(params).alias("name", "value")).select("file_id", "obj_path", "name", F.lit("string").alias("type_class"), "value")


def copy_attributes(attr: DataFrame, there: DataFrame, source: str, target: str, recurse: bool = False) -> DataFrame:
    """Attributes of ``source`` under ``target``; one that is there already is an error, as is a class that can't be copied."""
    inside = F.col("obj_path") == source
    if recurse:
        inside = inside | F.startswith(F.col("obj_path"), F.lit(f"{source.rstrip('/')}/"))
    moved = attr.where(inside).withColumn("obj_path", F.concat(F.lit(target), F.substring("obj_path", len(source) + 1, 1 << 30)))
    known = there.select("file_id", "obj_path", "name", F.lit(True).alias("__there"))
    bad = F.when(F.col("__there"), F.raise_error(F.concat(F.lit("attribute exists: "), "obj_path", F.lit("/"), "name"))).when(~F.col("type_class").isin("int", "uint", "float", "string"), F.raise_error(F.lit("attribute class can't be copied"))).otherwise(F.lit(True))
    return moved.join(known, ["file_id", "obj_path", "name"], "left").where(bad).select(*attr.columns)


# discovery -----------------------------------------------------------------
def groups(link: DataFrame, prefix: str) -> DataFrame:
    """file_id, gr, gr_ord of the analysis groups whose name begins so."""
    own = link.where((F.col("group_path") == "/Analyses") & F.startswith(F.col("name"), F.lit(prefix)) & (F.col("kind") == "group"))
    return own.select("file_id", F.substring("name", len(prefix) + 1, 1 << 30).alias("gr"), F.col("ord").alias("gr_ord"))


def raw_reads(link: DataFrame) -> DataFrame:
    """file_id, rn, rn_ord, packed: reads that have a signal; packed only where there is no unpacked one."""
    names = link.where("group_path = '/Raw/Reads'").select("file_id", F.col("name").alias("rn"), F.col("ord").alias("rn_ord"))
    inner = link.where(F.startswith(F.col("group_path"), F.lit("/Raw/Reads/"))).select("file_id", F.substring_index("group_path", "/", -1).alias("rn"), F.col("name").alias("part"))
    forms = inner.groupBy("file_id", "rn").agg(F.bool_or(F.col("part") == "Signal").alias("__u"), F.bool_or(F.col("part") == "Signal_Pack").alias("__p"))
    return names.join(forms, ["file_id", "rn"]).where("__u OR __p").select("file_id", "rn", "rn_ord", (~F.col("__u")).alias("packed"))


def strand_flags(link: DataFrame) -> DataFrame:
    """file_id, gr, st and what each basecall strand has."""
    inside = link.where(F.startswith(F.col("group_path"), F.lit(BC)))
    strand = F.regexp_extract("group_path", r"/BaseCalled_(template|complement|2D)$", 1)
    rows = inside.withColumns({"gr": F.regexp_extract("group_path", r"^/Analyses/Basecall_([^/]*)/", 1), "__s": strand}).where("__s != ''")
    st = (F.array_position(F.array(*map(F.lit, STRANDS)), F.col("__s")) - 1).cast("tinyint")
    has = lambda n: F.bool_or(F.col("name") == n)
    found = rows.groupBy("file_id", "gr", st.alias("st")).agg(*(has(f"{n}{p}").alias(f"__{n}{p}") for n in ("Fastq", "Events", "Model", "Alignment") for p in ("", "_Pack")))
    flag = lambda n, ok=F.lit(True): (ok & (F.col(f"__{n}") | F.col(f"__{n}_Pack"))).alias(f"have_{n.lower()}")
    return found.select("file_id", "gr", "st", flag("Fastq"), flag("Events"), (F.col("__Model") & (F.col("st") < 2)).alias("have_model"), flag("Alignment", F.col("st") == 2), *((~F.col(f"__{n}")).alias(f"packed_{n.lower()}") for n in ("Fastq", "Events", "Alignment")))


# links and defaults ----------------------------------------------------------
def resolve_1d(bc: DataFrame, link_to: str = "basecall_1d") -> DataFrame:
    """Adds bc_1d_gr: itself if it has a strand 0 or 1, else the linked group if that was listed before, else itself."""
    target = F.regexp_extract(F.coalesce(link_to, F.lit("")), r"^(?:Analyses/)?Basecall_(.*)$", 1)
    known = bc.select("file_id", F.col("gr").alias("__target"), F.col("gr_ord").alias("__ord"))
    joined = bc.withColumn("__target", target).join(known, ["file_id", "__target"], "left")
    usable = F.col("__ord") < F.col("gr_ord")
    return joined.withColumn("bc_1d_gr", F.when(F.col("have_1d"), F.col("gr")).when(usable, F.col("__target")).otherwise(F.col("gr"))).drop("__target", "__ord")


def resolve_ed(bc: DataFrame, ed: DataFrame, link_to: str = "event_detection", packed: str = "packed_ed_gr") -> DataFrame:
    """Adds ed_gr: the linked event-detection group, else the one that packed events name, else ''; only for a group with strand 0."""
    target = F.regexp_extract(F.coalesce(link_to, F.lit("")), r"^Analyses/EventDetection_(.*)$", 1)
    known = ed.select("file_id", "gr")
    by = lambda name, flag: known.select("file_id", F.col("gr").alias(name), F.lit(True).alias(flag))
    joined = bc.withColumns({"__a": target, "__b": F.coalesce(packed, F.lit(""))}).join(by("__a", "__has_a"), ["file_id", "__a"], "left").join(by("__b", "__has_b"), ["file_id", "__b"], "left")
    found = F.when(~F.col("have_0"), "").when(F.col("__has_a"), F.col("__a")).when(F.col("__has_b"), F.col("__b")).otherwise("")
    return joined.withColumn("ed_gr", found).drop("__a", "__b", "__has_a", "__has_b")


def median_sd_temp(segmentation: DataFrame, attr: DataFrame) -> DataFrame:
    """(file_id, gr, median_sd_temp): the value under a group's segmentation, 0 if there is none. ``segmentation`` has file_id, gr, target."""
    value = attr.where("name = 'median_sd_temp'").select("file_id", F.regexp_replace(F.regexp_replace("obj_path", "^/", ""), "/Summary/split_hairpin$", "").alias("target"), F.expr("try_cast(value AS double)").alias("__v"))
    return segmentation.join(value, ["file_id", "target"], "left").select("file_id", "gr", F.coalesce("__v", F.lit(0.0)).alias("median_sd_temp"))


def first_listed(rows: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """The default of an empty argument: the first in the listing."""
    return rows.groupBy(*keys).agg(F.min_by(name, order).alias(name))


def prefer_unpacked(unpacked: DataFrame, packed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both storage forms, of the packed ones only where the other form is missing; with ``packed``."""
    return unpacked.withColumn("packed", F.lit(False)).unionByName(packed.join(unpacked.select(*keys), keys, "left_anti").withColumn("packed", F.lit(True)))


def lookup(rows: DataFrame, **where) -> DataFrame:
    """Rows with these values; a value of None does not matter."""
    for column, value in where.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def next_free_suffix(used: DataFrame, column: str, digits: int = 3) -> DataFrame:
    """The least number of ``digits`` digits that is not a value of the column."""
    free = used.sparkSession.range(10**digits).select(F.lpad(F.col("id").cast("string"), digits, "0").alias(column))
    return free.join(used.select(column), column, "left_anti").agg(F.min(column).alias("suffix"))


def strand_groups(bc: DataFrame, flags: DataFrame, st: int) -> DataFrame:
    """Basecall groups that have a strand, in listing order."""
    return bc.join(flags.where(F.col("st") == st).select("file_id", "gr"), ["file_id", "gr"], "left_semi").orderBy("file_id", "gr_ord")


def channel_struct(params: Column) -> Column:
    number = lambda k: F.coalesce(F.try_element_at(params, F.lit(k)).try_cast("double"), F.lit(0.0)).alias(k)
    return F.struct(F.coalesce(F.try_element_at(params, F.lit("channel_number")), F.lit("")).alias("channel_number"), number("digitisation"), number("offset"), number("range"), number("sampling_rate"))


def caller(bc: DataFrame) -> DataFrame:
    """Adds name and version from the group's params."""
    found = expr.caller_of(F.col("params"))
    return bc.withColumns({"name": found["name"], "version": found["version"]})
