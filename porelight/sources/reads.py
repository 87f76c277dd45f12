"""Hierarchical read files as logical tables, and back.

Files are read whole by Spark's ``binaryFile`` source, so any store that Spark
reads will do, and each task decodes its own files. ``load_all`` reads each file
once and stores all tables as Parquet, to work from there; ``load`` is one table
alone and decodes only what that table needs from each file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from porelight.functions import expr
from porelight.operators import catalog
from porelight.runtime import empty, shared_folder, ship_package
from porelight.schema import TABLES
from porelight.sources.hdf5_format import Fixed, Hdf5Error, Reader, Writer, as_text, is_valid

_STRAND = re.compile(r"^/Analyses/Basecall_([^/]+)/BaseCalled_(template|complement|2D)$")
_ED_READ = re.compile(r"^/Analyses/EventDetection_([^/]+)/Reads/([^/]+)$")
#: In parts of a file: the root, or a basecall group, began in another part; the place of a dataset's first row.
CONTINUES, FIRST_ROW = "continues", "first_row"
#: A part ends after so many rows or bytes, where a read or group ends. Datasets of more than SLICE rows are cut.
PART_ROWS, PART_BYTES, SLICE = 20_000, 16 << 20, 65_536
VALID = "file_id string, path string, valid boolean, error string"


def list_paths(spark: SparkSession, inputs: list[str], recursive: bool = False, lists: bool = False) -> list[str]:
    """Inputs as they are, or read as texts that list one path a line. Directories go deeper only if ``recursive``."""
    if lists:
        inputs = [r[0] for r in spark.read.text(inputs).where("trim(value) != ''").collect()]  # a list of inputs, given by hand
    return inputs


def files(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """file_id, path, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    return found.select(F.xxhash64("path").cast("string").alias("file_id"), "path", "content")


def _decoded(table: str, schema: pa.Schema, file_id: str, path: str, content: bytes, reader: Reader | None) -> pa.Table | None:
    """A file's rows of a table, or None if there are none."""
    if table in COLUMNS:
        try:
            return _of_columns(table, schema, file_id, reader) if reader else None
        except Exception:  # as in ``_extracted``
            return None
    rows = _extracted(table, file_id, path, content, reader)
    return pa.Table.from_pylist(rows, schema) if rows else None


def _extracted(table: str, file_id: str, path: str, content: bytes, reader: Reader | None) -> list[dict]:
    """A file's rows of a table; none where ``reader`` is None or the table's part of the file is damaged."""
    if table == "valid":
        return [_valid(file_id, path, content)]
    try:
        return list(EXTRACT[table](file_id, path, reader)) if reader else []
    except Exception:  # whatever damaged bytes lead to; ``valid`` tells which files and why
        return []


def _opened(content: bytes) -> Reader | None:
    try:
        return Reader(content) if is_valid(content) else None
    except Exception:
        return None


def _ddl(table: str) -> str:
    return VALID if table == "valid" else TABLES[table]


def load(found: DataFrame, table: str) -> DataFrame:
    """One of the logical tables, or ``valid``: which files can be read and why others can't. Others are left out elsewhere."""
    ship_package(found.sparkSession)
    schema = to_arrow_schema(T._parse_datatype_string(_ddl(table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, path, content in zip(*(batch.column(c).to_pylist() for c in ("file_id", "path", "content"))):
                if (rows := _decoded(table, schema, file_id, path, content, _opened(content))) is not None:
                    yield from rows.to_batches()

    return found.mapInArrow(run, _ddl(table))


def load_all(found: DataFrame, folder: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Logical tables by one pass over the files, as Parquet in ``folder``, which executors must share.

    The files are read once: a task writes what each file holds of each table as an
    Arrow stream, in a directory a table, and these streams, not the files,
    are then turned into the tables. A table that no file has rows of is empty.
    ``tables`` are all, and ``valid``, if not given; the folder must not hold any of them.
    """
    spark, tables = found.sparkSession, tables or list(EXTRACT)
    ship_package(spark)
    schemas = {t: to_arrow_schema(T._parse_datatype_string(_ddl(t))) for t in tables}

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, path, content in zip(*(batch.column(c).to_pylist() for c in ("file_id", "path", "content"))):
                reader = _opened(content)
                for t, schema in schemas.items():
                    if (rows := _decoded(t, schema, file_id, path, content, reader)) is not None:
                        sink = pa.BufferOutputStream()
                        with pa.ipc.new_stream(sink, schema) as out:
                            out.write_table(rows)
                        yield pa.RecordBatch.from_pydict({"t": [t], "stream": [sink.getvalue().to_pybytes()]})

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream in batch.column("stream").to_pylist():
                yield from pa.ipc.open_stream(stream)

    decoded = f"{folder}/_decoded"
    found.mapInArrow(streams, "t string, stream binary").write.partitionBy("t").parquet(decoded)
    kept, out = spark.read.schema("stream binary, t string").parquet(decoded), {}
    for t in tables:
        kept.where(F.col("t") == t).select("stream").mapInArrow(rows_of, _ddl(t)).write.parquet(f"{folder}/{t}")
        out[t] = spark.read.schema(_ddl(t)).parquet(f"{folder}/{t}")
    gone = spark._jvm.org.apache.hadoop.fs.Path(decoded)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return out


def _valid(file_id, path, content):
    error = None
    try:
        reader = Reader(content)
        if reader.end_of_file > len(content):
            raise Hdf5Error("the file ends too early")
        for _, at in reader.walk():
            reader.attributes(at)
    except (Hdf5Error, KeyError, ValueError, IndexError) as e:
        error = str(e) or type(e).__name__
    except Exception as e:  # struct.error and the like, from damaged bytes
        error = f"damaged: {e}"
    return {"file_id": file_id, "path": path, "valid": error is None, "error": error}


def _map(reader: Reader, path: str) -> dict[str, str]:
    at = reader.find(path)
    return {} if at is None else {k: as_text(v[2]) for k, v in reader.attributes(at).items()}


def _params(reader: Reader, path: str, ddl: str) -> dict:
    """Attributes at a path as the fields of a struct; missing ones are null."""
    at = reader.find(path)
    have = {} if at is None else {k: v[2] for k, v in reader.attributes(at).items()}
    names = [f.split(":")[0].strip() for f in ddl.removeprefix("struct<").removesuffix(">").split(",")]
    return {name: have.get(name) for name in names}


def _tree(reader: Reader, path: str) -> dict[str, str]:
    """Attributes at and below a path."""
    out = {}
    for p, at in reader.walk(path):
        out |= {f"{p[len(path) + 1 :]}{'/' if p != path else ''}{k}": as_text(v[2]) for k, v in reader.attributes(at).items()}
    return dict(sorted(out.items()))


def _read_file(file_id, path, r):
    if CONTINUES in r.attributes(r.root):
        return
    version = r.attributes(r.root).get("file_version")
    channel = {"channel_number": "", "digitisation": 0.0, "offset": 0.0, "range": 0.0, "sampling_rate": 0.0}
    at = r.find(catalog.ROOTS["channel"])
    if at is not None:
        got = {k: v[2] for k, v in r.attributes(at).items()}
        channel = {k: (str(got[k]) if k == "channel_number" else float(got[k])) if k in got else d for k, d in channel.items()}
    yield {"file_id": file_id, "path": path, "file_version": None if version is None else as_text(version[2]), "channel": channel} | {k: list(_map(r, catalog.ROOTS[k]).items()) for k in ("tracking", "context", "sequences")}


def _attr(file_id, path, r):
    for p, at in r.walk():
        for name, (kind, _, value) in r.attributes(at).items():
            if name not in (CONTINUES, FIRST_ROW):
                yield {"file_id": file_id, "obj_path": p, "name": name, "type_class": {"vlen": "string", "struct": "compound"}.get(kind.name, kind.name), "value": as_text(value)}


def _link(file_id, path, r):
    for p, at in r.walk():
        if not r.is_dataset(at):
            for k, (name, to) in enumerate(r.children(at).items()):
                yield {"file_id": file_id, "group_path": p, "name": name, "ord": k, "kind": "dataset" if r.is_dataset(to) else "group"}


def _raw_read(file_id, path, r):
    from porelight.schema import RAW_PARAMS

    at = r.find("/Raw/Reads")
    for k, (rn, to) in enumerate(r.children(at).items() if at is not None else ()):
        names, base = r.children(to), f"/Raw/Reads/{rn}"
        packed = "Signal" not in names
        if packed and "Signal_Pack" not in names:
            continue
        params = _params(r, f"{base}/Signal_Pack/params" if packed else base, RAW_PARAMS)
        yield {"file_id": file_id, "rn": rn, "rn_ord": k, "packed": packed, "params": params, "signal": None if packed else r.array(names["Signal"])[1]}


def _groups(r, prefix):
    at = r.find("/Analyses")
    for k, (name, to) in enumerate(r.children(at).items() if at is not None else ()):
        if name.startswith(prefix) and not r.is_dataset(to):
            yield k, name[len(prefix) :], to


def _ed_group(file_id, path, r):
    for k, gr, _ in _groups(r, "EventDetection_"):
        yield {"file_id": file_id, "gr": gr, "gr_ord": k, "params": list(_map(r, catalog.ED + gr).items())}


def _ed_reads(r):
    for _, gr, to in _groups(r, "EventDetection_"):
        reads = r.children(to).get("Reads")
        for k, (rn, at) in enumerate(r.children(reads).items() if reads is not None else ()):
            yield gr, rn, k, r.children(at)


def _ed_read(file_id, path, r):
    from porelight.schema import ED_PARAMS

    for gr, rn, k, names in _ed_reads(r):
        packed = "Events" not in names
        if not packed or "Events_Pack" in names:
            base = f"{catalog.ED}{gr}/Reads/{rn}"
            params = _params(r, f"{base}/Events_Pack/params" if packed else base, ED_PARAMS)
            params |= {"median_before": float("nan") if params["median_before"] is None else params["median_before"], "abasic_found": expr.ABASIC_NOT_SET if params["abasic_found"] is None else params["abasic_found"], "read_id": params["read_id"] or ""}
            yield {"file_id": file_id, "gr": gr, "rn": rn, "rn_ord": k, "packed": packed, "params": params}


def _bc_group(file_id, path, r):
    for k, gr, to in _groups(r, "Basecall_"):
        names, params = r.children(to), _map(r, catalog.BC + gr)
        if CONTINUES in params:
            continue
        program = params.get("name")
        name = {"ONT Sequencing Workflow": "metrichor", "MinKNOW-Live-Basecalling": "minknow", "ONT Albacore Sequencing Software": "albacore"}.get(program, expr.UNKNOWN)
        get = lambda a: params.get(a, expr.UNKNOWN)
        version = f"{get('chimaera version')}+{get('dragonet version')}" if name == "metrichor" else expr.UNKNOWN if name == expr.UNKNOWN else get("version")
        log = names.get("Log")
        tree = lambda n: list(_tree(r, f"{catalog.BC}{gr}/{n}").items()) if n in names else []
        yield {"file_id": file_id, "gr": gr, "gr_ord": k, "name": name, "version": version, "ed_gr": None, "bc_1d_gr": None, "params": list(params.items()), "config": tree("Configuration"), "summary": tree("Summary"), "log": r.read(log) if log is not None and r.is_dataset(log) else None}


def _strands(r):
    for _, gr, to in _groups(r, "Basecall_"):
        names = r.children(to)
        for st, strand in enumerate(catalog.STRANDS):
            if f"BaseCalled_{strand}" in names:
                yield gr, st, r.children(names[f"BaseCalled_{strand}"])


def _bc_strand(file_id, path, r):
    begun = {gr for _, gr, to in _groups(r, "Basecall_") if CONTINUES not in r.attributes(to)}
    for gr, st, names in _strands(r):
        if gr not in begun:
            continue
        has = lambda n: n in names or f"{n}_Pack" in names
        yield {"file_id": file_id, "gr": gr, "st": st, "have_fastq": has("Fastq"), "have_events": has("Events"), "have_model": "Model" in names and st < 2, "have_alignment": has("Alignment") and st == 2} | {f"packed_{n.lower()}": n not in names for n in ("Fastq", "Events", "Alignment")}


def _bc_fastq(file_id, path, r):
    for gr, st, names in _strands(r):
        if "Fastq" in names:
            yield {"file_id": file_id, "gr": gr, "st": st, "fq": r.read(names["Fastq"])}


def _of_strands(name: str, only: tuple[int, ...] = (0, 1, 2)):
    return lambda r: (({"gr": gr, "st": st}, names[name]) for gr, st, names in _strands(r) if st in only and name in names)


#: Tables of datasets' rows: the datasets with their keys, the column that counts their rows, and names on file that differ.
COLUMNS = {
    "ed_event": (lambda r: (({"gr": gr, "rn": rn}, names["Events"]) for gr, rn, _, names in _ed_reads(r) if "Events" in names), "event_idx", {}),
    "bc_event": (_of_strands("Events"), "event_idx", {}),
    "bc_model_state": (_of_strands("Model"), "state_idx", {}),
    "bc_alignment": (_of_strands("Alignment", (2,)), "idx", {"template_index": "template", "complement_index": "complement"}),
}


def _of_columns(table: str, schema: pa.Schema, file_id: str, r: Reader) -> pa.Table | None:
    """Rows of a file's datasets, put together by columns."""
    datasets, index, renamed = COLUMNS[table]
    found = [(keys, r.attributes(at).get(FIRST_ROW, (None, None, 0))[2], *r.array(at)) for keys, at in datasets(r)]
    found = [x for x in found if len(x[3])]
    if not found:
        return None
    if any(x[3].dtype != found[0][3].dtype for x in found):  # types that differ between datasets
        return pa.concat_tables([_rows_of([x], schema, file_id, index, renamed, r) for x in found])
    return _rows_of(found, schema, file_id, index, renamed, r)


def _rows_of(found: list[tuple], schema: pa.Schema, file_id: str, index: str, renamed: dict[str, str], r: Reader) -> pa.Table:
    sizes = np.array([len(x[3]) for x in found])
    data, of = np.concatenate([x[3] for x in found]), np.repeat(np.arange(len(found)), sizes)
    kinds = {name: kind for name, _, kind in found[0][2].members}
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(np.array([x[1] for x in found]), sizes)
    out = []
    for f in schema:
        name = renamed.get(f.name, f.name)
        if f.name == "file_id":
            column = pa.repeat(pa.scalar(file_id, f.type), len(data))
        elif f.name == index:
            column = pa.array(place.astype(np.int32), f.type)
        elif f.name in found[0][0]:
            column = pa.array([x[0][f.name] for x in found], f.type).take(pa.array(of))
        elif name == "stdv" and name not in kinds:
            if "variance" not in kinds:
                raise Hdf5Error("events have neither stdv nor variance")
            column = pa.array(data["variance"].astype(np.float64) ** 0.5, f.type)
        elif kinds[name].name in ("string", "vlen"):
            column = pa.array(r._values(data[name], kinds[name]), f.type)
        else:
            own = np.ascontiguousarray(data[name])
            column = pa.array(own.astype(own.dtype.newbyteorder("=")), f.type)
        out.append(column)
    return pa.Table.from_arrays(out, schema=schema)


def _bc_events_params(file_id, path, r):
    for gr, st, names in _strands(r):
        if st < 2 and ("Events" in names or "Events_Pack" in names):
            got = {k: v[2] for k, v in r.attributes(names["Events"] if "Events" in names else r.children(names["Events_Pack"]).get("params", names["Events_Pack"])).items()}
            yield {"file_id": file_id, "gr": gr, "st": st, "params": {"start_time": float(got.get("start_time", 0.0)), "duration": float(got.get("duration", 0.0))}}


def _bc_model_params(file_id, path, r):
    from porelight.schema import MODEL_PARAMS

    for gr, st, names in _strands(r):
        if "Model" in names and st < 2:
            base = f"{catalog.BC}{gr}/Summary/basecall_1d_{catalog.STRANDS[st]}"
            at = r.find(base)
            file = r.attributes(at).get("model_file") if at is not None else None
            yield {"file_id": file_id, "gr": gr, "st": st, "model_file": None if file is None else as_text(file[2]), "params": _params(r, f"{catalog.BC}{gr}/BaseCalled_{catalog.STRANDS[st]}/Model", MODEL_PARAMS)}


def _pack_stream(file_id, path, r):
    for p, at in r.walk():
        if p.endswith("_Pack") and not r.is_dataset(at):
            for name, to in r.children(at).items():
                if r.is_dataset(to):
                    yield {"file_id": file_id, "obj_path": p, "stream": name, "bytes": bytes(np.array(r.read(to), np.uint8)), "params": [(k, as_text(v[2])) for k, v in r.attributes(to).items()]}


EXTRACT = {
    "valid": _valid, "read_file": _read_file, "attr": _attr, "link": _link, "raw_read": _raw_read, "ed_group": _ed_group, "ed_read": _ed_read, "ed_event": None, "bc_group": _bc_group, "bc_strand": _bc_strand, "bc_fastq": _bc_fastq,
    "bc_event": None, "bc_model_state": None, "bc_alignment": None, "bc_events_params": _bc_events_params, "bc_model_params": _bc_model_params, "pack_stream": _pack_stream,
}


# writing ----------------------------------------------------------------------------
#: Members of datasets, and the names in the table of those that differ.
FIELDS = {
    "ed_event": [("start", "<i8"), ("length", "<i8"), ("mean", "<f8"), ("stdv", "<f8")],
    "bc_event": [("mean", "<f8"), ("stdv", "<f8"), ("start", "<f8"), ("length", "<f8"), ("p_model_state", "<f8"), ("move", "<i8"), ("model_state", "S8")],
    "model": [("kmer", "S8"), ("level_mean", "<f8"), ("level_stdv", "<f8"), ("sd_mean", "<f8"), ("sd_stdv", "<f8")],
    "alignment": [("template", "<i8"), ("complement", "<i8"), ("kmer", "S8")],
}
IN_TABLE = {"template": "template_index", "complement": "complement_index"}


def build_file(read_file: dict, raw: list[dict] = (), ed_event: list[dict] = (), fastq: list[dict] = (), bc_event: list[dict] = (), model: list[dict] = (), streams: list[dict] = (), attrs: list[dict] = (), ed_read: list[dict] = (), events_params: list[dict] = (), model_params: list[dict] = (), alignment: list[dict] = ()) -> bytes:
    """One file from the rows of its tables. ``attrs`` may be any attributes: those of groups, basecall params, params of packed objects."""
    w = Writer()
    _fill(w, **{k: v for k, v in locals().items() if k != "w"})
    return w.bytes()


def _fill(w: Writer, read_file: dict, raw=(), ed_event=(), fastq=(), bc_event=(), model=(), streams=(), attrs=(), ed_read=(), events_params=(), model_params=(), alignment=()) -> None:
    if read_file.get("file_version") is not None:
        w.attribute("/", "file_version", read_file["file_version"])
    for k, v in (read_file.get("channel") or {}).items():
        w.attribute(catalog.ROOTS["channel"], k, v)
    for kind in ("tracking", "context", "sequences"):
        for k, v in dict(read_file.get(kind) or {}).items():
            w.attribute(catalog.ROOTS[kind], k, v)
    for x in raw:
        base = f"/Raw/Reads/{x['rn']}"
        if x.get("signal") is not None:
            w.dataset(f"{base}/Signal", np.array(x["signal"], np.int16))
        for k, v in (x.get("params") or {}).items():
            if v is not None:
                w.attribute(base if x.get("signal") is not None else f"{base}/Signal_Pack/params", k, v)
    _tables(w, ed_event, lambda x: f"{catalog.ED}{x['gr']}/Reads/{x['rn']}/Events", FIELDS["ed_event"], "event_idx")
    strand = lambda x: f"{catalog.BC}{x['gr']}/BaseCalled_{catalog.STRANDS[x['st']]}"
    for x in fastq:
        w.dataset(f"{strand(x)}/Fastq", x["fq"])
    _tables(w, bc_event, lambda x: f"{strand(x)}/Events", FIELDS["bc_event"], "event_idx")
    _tables(w, model, lambda x: f"{strand(x)}/Model", FIELDS["model"], "state_idx")
    _tables(w, alignment, lambda x: f"{catalog.BC}{x['gr']}/BaseCalled_2D/Alignment", FIELDS["alignment"], "idx")
    for x in ed_read:
        base = f"{catalog.ED}{x['gr']}/Reads/{x['rn']}"
        _attributes(w, f"{base}/Events_Pack/params" if x.get("packed") else base, x.get("params"))
    for x in events_params:
        _attributes(w, f"{strand(x)}/Events", {k: v for k, v in (x.get("params") or {}).items() if v and v > 0})
    for x in model_params:
        _attributes(w, f"{strand(x)}/Model", x.get("params"))
        _attributes(w, f"{catalog.BC}{x['gr']}/Summary/basecall_1d_{catalog.STRANDS[x['st']]}", {"model_file": x.get("model_file")})
    for x in streams:
        path = f"{x['obj_path']}/{x['stream']}"
        w.dataset(path, np.frombuffer(x["bytes"], np.uint8))
        for k, v in dict(x["params"]).items():
            w.attribute(path, k, v)
    for x in attrs:
        value = {"int": int, "uint": int, "float": float}.get(x["type_class"], str)(x["value"])
        w.attribute(x["obj_path"], x["name"], value)


def _attributes(w: Writer, path: str, values: dict | None) -> None:
    for k, v in (values or {}).items():
        if v is not None:
            w.attribute(path, k, v)


def _tables(w: Writer, rows: list[dict], path, fields: list[tuple[str, str]], order: str) -> None:
    by: dict[str, list[dict]] = {}
    for x in rows:
        by.setdefault(path(x), []).append(x)
    for p, own in by.items():
        own.sort(key=lambda x: x[order])
        w.dataset(p, np.array([tuple(x[f].encode() if t == "S8" else x[f if f in x else IN_TABLE[f]] for f, t in fields) for x in own], np.dtype(fields)))


def single_base_fastq(name: str, bases: str, quality: int = 33) -> str:
    return f"@{name}\n{bases}\n+\n{chr(quality) * len(bases)}\n"


_UNIT = "^(/Raw/Reads/[^/]+|/Analyses/EventDetection_[^/]+/Reads/[^/]+|/Analyses/[^/]+)"


def _placed(name: str) -> tuple[Column, Column, Column]:
    """Of a table's rows: the path of the read or group that stays together, the strand, the place in a dataset."""
    zero = F.lit(0)
    unit = {
        "read_file": F.lit(""), "raw": F.concat(F.lit("/Raw/Reads/"), "rn"), **dict.fromkeys(("ed_event", "ed_read"), F.concat(F.lit(catalog.ED), "gr", F.lit("/Reads/"), "rn")), **dict.fromkeys(("streams", "attrs"), F.regexp_extract("obj_path", _UNIT, 1)),
    }.get(name)
    order = {"ed_event": "event_idx", "bc_event": "event_idx", "model": "state_idx", "alignment": "idx"}.get(name)
    strand = F.col("st") if name in ("fastq", "bc_event", "model", "events_params", "model_params") else F.lit(2) if name == "alignment" else zero
    return F.concat(F.lit(catalog.BC), "gr") if unit is None else unit, strand, zero if order is None else F.col(order)


def _in_order(read_file: DataFrame, tables: dict[str, DataFrame], split: bool) -> DataFrame:
    """Rows of all tables, one struct column a table, dealt by file, or by read or group of a file, and sorted as they are written."""
    tables = {"read_file": read_file} | ({k: df.join(read_file.select("file_id"), "file_id", "left_semi").select(*df.columns) for k, df in tables.items()} if split else tables)
    out = None
    for k, (name, df) in enumerate(tables.items()):
        unit, strand, order = _placed(name)
        cut = F.floor(order / SLICE).cast("int") if split and name in ("bc_event", "model", "alignment") else F.lit(0)
        others = (F.struct(*df.columns) if other == name else F.lit(None).cast(o.select(F.struct(*o.columns)).schema[0].dataType) for other, o in tables.items())
        rows = df.select("file_id", unit.alias("__unit"), cut.alias("__cut"), F.lit(k).alias("__t"), strand.cast("int").alias("__st"), order.cast("bigint").alias("__place"), *(c.alias(n) for c, n in zip(others, tables)))
        out = rows if out is None else out.union(rows)
    together = ["file_id", "__unit", "__cut"] if split else ["file_id"]
    return out.repartition(*together).sortWithinPartitions("file_id", "__unit", "__cut", "__t", "__st", "__place")


def _contents(batches: Iterator[pa.RecordBatch], names: list[str], split: bool) -> Iterator[tuple[str, bytes]]:
    """file_id and bytes of files from rows in the order of ``_in_order``: of whole files, or of parts of them of a bounded size."""
    held, rows, size, last, file = [], 0, 0, (None, None, None), None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, units, cuts = (batch.column(c).to_pylist() for c in ("file_id", "__unit", "__cut"))
        each, begin = batch.nbytes / batch.num_rows, 0
        for i, key in enumerate(zip(files, units, cuts)):
            if key == last:
                continue
            last, here = key, rows + i - begin
            if here and (key[0] != file or split and (here >= PART_ROWS or size + each * (i - begin) >= PART_BYTES or key[2])):
                held.append(batch.slice(begin, i - begin))
                if (content := _content(held, names, split)) is not None:
                    yield file, content
                held, rows, size, begin = [], 0, 0, i
            file = key[0]
        held.append(batch.slice(begin))
        rows, size = rows + batch.num_rows - begin, size + each * (batch.num_rows - begin)
    if rows and (content := _content(held, names, split)) is not None:
        yield file, content


def _content(held: list[pa.RecordBatch], names: list[str], split: bool) -> bytes | None:
    """The bytes of a file or a part, from rows of all its tables; None for a file that ``read_file`` does not have."""
    table, w, small = pa.Table.from_batches(held).combine_chunks(), Writer(), {}
    t = table.column("__t").to_numpy()
    if not split and 0 not in t:
        return None
    for k in np.unique(t).tolist():
        own = table.filter(pa.array(t == k)).combine_chunks()
        column = own.column(names[k]).chunk(0)
        if names[k] in FIELDS:
            _datasets(w, names[k], own, column)
        elif names[k] == "raw":
            small["raw"] = [x | {"signal": s} for x, s in zip(pa.Table.from_struct_array(column).drop_columns(["signal"]).to_pylist(), _pieces(column.field("signal")))]
        else:
            small[names[k]] = column.to_pylist()
    files = small.pop("read_file", [])
    if split and not files:
        w.attribute("/", CONTINUES, 1)
    _fill(w, files[0] if files else {}, **small)
    return w.bytes()


def _pieces(lists: pa.ListArray) -> list[np.ndarray | None]:
    values, offsets, there = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist(), lists.is_valid().to_pylist()
    return [values[lo:hi] if ok else None for lo, hi, ok in zip(offsets, offsets[1:], there)]


def _datasets(w: Writer, name: str, own: pa.Table, rows: pa.StructArray) -> None:
    """Datasets of one table's rows, which lie in order: a column at a time, then cut where the read or strand changes."""
    data = np.empty(len(rows), np.dtype(FIELDS[name]))
    columns = [f.name for f in rows.type]
    for f, kind in FIELDS[name]:
        column = rows.field(f if f in columns else IN_TABLE[f])
        if column.null_count and kind != "<f8":
            raise Hdf5Error(f"{name}: {f} is missing")
        data[f] = np.array(column.cast(pa.binary()).to_pylist(), kind) if kind == "S8" else column.to_numpy(zero_copy_only=False)
    units = own.column("__unit").chunk(0).dictionary_encode()
    strands, cuts, places = (own.column(c).to_numpy() for c in ("__st", "__cut", "__place"))
    key = units.indices.to_numpy().astype(np.int64) * 4 + strands
    starts = [0, *(1 + np.flatnonzero(np.diff(key))).tolist(), len(key)]
    last = {"ed_event": "Events", "bc_event": "Events", "model": "Model", "alignment": "Alignment"}[name]
    for lo, hi in zip(starts, starts[1:]):
        unit = units.dictionary[units.indices[lo].as_py()].as_py()
        path = f"{unit}/{last}" if name == "ed_event" else f"{unit}/BaseCalled_{catalog.STRANDS[strands[lo]]}/{last}"
        w.dataset(path, data[lo:hi])
        if cuts[lo]:
            first = int(cuts[lo]) * SLICE
            if places[lo] != first or places[hi - 1] != first + hi - lo - 1:
                raise Hdf5Error(f"{path}: rows of a dataset that is cut have to be counted from 0 without gaps")
            w.attribute(path, FIRST_ROW, first)
            if CONTINUES not in w.attrs.get(unit, {}):
                w.attribute(unit, CONTINUES, 1)


def assemble(read_file: DataFrame, **tables: DataFrame) -> DataFrame:
    """file_id, content: the files' bytes. Rows of a file meet in one task and come in order, so that a task holds one file at a time."""
    ship_package(read_file.sparkSession)
    names = ["read_file", *tables]

    def run(batches):
        for file_id, content in _contents(batches, names, False):
            yield pa.RecordBatch.from_arrays([pa.array([file_id], pa.string()), pa.array([content], pa.binary())], ["file_id", "content"])

    return _in_order(read_file, tables, False).mapInArrow(run, "file_id string, content binary")


def written_and_read(read_file: DataFrame, wanted: tuple[str, ...], split: bool = True, **tables: DataFrame) -> dict[str, DataFrame]:
    """The files of these tables' rows written, and the ``wanted`` tables read from their bytes, as Parquet in the shared folder.

    With ``split`` a file comes in parts, each a file of its own of a bounded size,
    so that neither a task's memory nor the number of tasks hangs on the size or the number of files; a read
    or group stays whole, but for datasets of more than ``SLICE`` rows. What parts
    have in common, the listing's order and groups of several parts, is put together after reading.
    """
    spark, names = read_file.sparkSession, ["read_file", *tables]
    ship_package(spark)
    schemas = {t: to_arrow_schema(T._parse_datatype_string(_ddl(t))) for t in wanted}
    kinds = {t: pa.struct(list(schema)) for t, schema in schemas.items()}

    def run(batches):
        pending, rows = {t: [] for t in wanted}, 0

        def out():
            for t, found in pending.items():
                if found:
                    whole = pa.concat_tables(found).combine_chunks()
                    found.clear()
                    own = pa.StructArray.from_arrays([whole.column(c).chunk(0) for c in whole.column_names], fields=list(schemas[t]))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(t), len(own)), *(own if o == t else pa.nulls(len(own), kinds[o]) for o in wanted)], ["t", *wanted])

        for file_id, content in _contents(batches, names, split):
            reader = _opened(content)
            for t, schema in schemas.items():
                if (found := _decoded(t, schema, file_id, f"memory/{file_id}", content, reader)) is not None:
                    pending[t].append(found)
                    rows += found.num_rows
            if rows >= PART_ROWS:
                yield from out()
                rows = 0
        yield from out()

    ddl = {t: ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T._parse_datatype_string(_ddl(t))) for t in wanted}
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _in_order(read_file, tables, split).mapInArrow(run, "t string, " + ", ".join(f"{t} struct<{d}>" for t, d in ddl.items())).write.partitionBy("t").parquet(folder)
    found = {}
    for t in wanted:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/t={t}")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        found[t] = spark.read.schema(f"{t} struct<{ddl[t]}>").parquet(at.toString()).select(f"{t}.*") if there else empty(spark, _ddl(t))
    return {t: _of_parts(t, df) for t, df in found.items()} if split else found


def _of_parts(table: str, rows: DataFrame) -> DataFrame:
    """Rows of files' parts as those of whole files: groups that several parts list once, and the order of the listing, which is that of names."""
    listed = {"raw_read": (["file_id"], "rn", "rn_ord"), "ed_read": (["file_id", "gr"], "rn", "rn_ord"), "ed_group": (["file_id"], "gr", "gr_ord"), "bc_group": (["file_id"], "gr", "gr_ord"), "link": (["file_id", "group_path"], "name", "ord")}
    if table not in listed:
        return rows
    keys, name, order = listed[table]
    once = rows
    if table == "ed_group":
        once = rows.groupBy(*keys, name).agg(F.max_by("params", F.size("params")).alias("params"))
    if table == "link":
        once = rows.groupBy(*keys, name).agg(F.max("kind").alias("kind"))
    place = (F.row_number().over(Window.partitionBy(*keys).orderBy(name)) - 1).alias(order)
    return once.select(*(place if c == order else F.col(c) for c in rows.columns))


def write_files(built: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Writes ``folder/<file_id>.h5`` on a file system that all executors have mounted; file_id and error per file.

    A file is written under another name first, so that a lost executor leaves no half of one.
    """

    def run(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            ids, errors = batch.column("file_id").to_pylist(), []
            for file_id, content in zip(ids, batch.column("content").to_pylist()):
                path = f"{folder}/{file_id}.h5"
                if os.path.exists(path) and not overwrite:
                    errors.append("exists")
                    continue
                with open(f"{path}.{os.getpid()}", "wb") as out:
                    out.write(content)
                os.replace(f"{path}.{os.getpid()}", path)
                errors.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array(errors, pa.string())], ["file_id", "error"])

    return built.mapInArrow(run, "file_id string, error string")


__all__ = ["Fixed", "assemble", "build_file", "files", "list_paths", "load", "single_base_fastq", "write_files", "written_and_read"]
