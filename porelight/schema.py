"""Schemas of the logical tables, and the types of the hierarchical files' values.

Keys ``file_id``, ``gr``, ``rn``, ``st`` and the ``*_idx`` and ``*_ord`` columns
name where a row comes from; ``*_ord`` keeps the listing order, on which defaults
rest. Parquet with these schemas is the primary storage.
"""

from __future__ import annotations

from pyspark.sql import types as T

CHANNEL = "struct<channel_number:string,digitisation:double,offset:double,range:double,sampling_rate:double>"
RAW_PARAMS = "struct<read_id:string,read_number:bigint,start_mux:bigint,start_time:bigint,duration:bigint>"
ED_PARAMS = "struct<read_id:string,read_number:bigint,scaling_used:bigint,start_mux:bigint,start_time:bigint,duration:bigint,median_before:double,abasic_found:bigint>"
EV_PARAMS = "struct<start_time:double,duration:double>"
MODEL_PARAMS = "struct<scale:double,shift:double,drift:double,var:double,scale_sd:double,var_sd:double>"
MAP = "map<string,string>"

TABLES = {
    "read_file": f"file_id string, path string, file_version string, channel {CHANNEL}, tracking {MAP}, context {MAP}, sequences {MAP}",
    "attr": "file_id string, obj_path string, name string, type_class string, value string",
    "link": "file_id string, group_path string, name string, ord int, kind string",
    "raw_read": f"file_id string, rn string, rn_ord int, packed boolean, params {RAW_PARAMS}, signal array<smallint>",
    "ed_group": f"file_id string, gr string, gr_ord int, params {MAP}",
    "ed_read": f"file_id string, gr string, rn string, rn_ord int, packed boolean, params {ED_PARAMS}",
    "ed_event": "file_id string, gr string, rn string, event_idx int, start bigint, length bigint, mean double, stdv double",
    "bc_group": f"file_id string, gr string, gr_ord int, name string, version string, ed_gr string, bc_1d_gr string, params {MAP}, config {MAP}, summary {MAP}, log string",
    "bc_strand": "file_id string, gr string, st tinyint, have_fastq boolean, have_events boolean, have_model boolean, have_alignment boolean, packed_fastq boolean, packed_events boolean, packed_alignment boolean",
    "bc_fastq": "file_id string, gr string, st tinyint, fq string",
    "bc_event": "file_id string, gr string, st tinyint, event_idx int, mean double, stdv double, start double, length double, p_model_state double, move bigint, model_state string",
    "bc_events_params": f"file_id string, gr string, st tinyint, params {EV_PARAMS}",
    "bc_model_state": "file_id string, gr string, st tinyint, state_idx int, level_mean double, level_stdv double, sd_mean double, sd_stdv double, kmer string",
    "bc_model_params": f"file_id string, gr string, st tinyint, model_file string, params {MODEL_PARAMS}",
    "bc_alignment": "file_id string, gr string, idx int, template_index bigint, complement_index bigint, kmer string",
    "pack_stream": f"file_id string, obj_path string, stream string, bytes binary, params {MAP}",
    "codeword": "map_name string, symbol bigint, is_escape boolean, code string, len int",
}

#: Spark types of numeric kinds on file: (kind, bytes).
NUMERIC = {
    ("int", 1): T.ByteType(), ("int", 2): T.ShortType(), ("int", 4): T.IntegerType(), ("int", 8): T.LongType(),
    ("uint", 1): T.ShortType(), ("uint", 2): T.IntegerType(), ("uint", 4): T.LongType(), ("uint", 8): T.DecimalType(20, 0),
    ("float", 4): T.FloatType(), ("float", 8): T.DoubleType(),
}


def table(spark, name: str, rows=()):
    """A DataFrame of one of ``TABLES``."""
    return spark.createDataFrame(list(rows), TABLES[name])


def flatten(schema: T.StructType, prefix: str = "") -> list[str]:
    """Paths of the leaf members, in order."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += flatten(f.dataType, f"{path}.") if isinstance(f.dataType, T.StructType) else [path]
    return out


def leaf(schema: T.StructType, path: str) -> T.DataType:
    """Type of a leaf member; ``KeyError`` if it is missing."""
    kind: T.DataType = schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            raise KeyError(path)
        kind = kind[name].dataType
    return kind
