"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porelight.runtime import shared_folder, ship_package

#: Word separators of every operator here: space and U+0009 to U+000D. They are
#: the separators of ``bytes.split()`` too, so texts are handled as UTF-8.
SPACE = r"\x20\x09-\x0D"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``; for narrow tables, see ``stored`` for others."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; ``discard`` removes it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of ``stored`` tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage, and so return heap and buffers outside of it to the system.

    A JVM keeps the heap that it once touched, and frees direct buffers and generated
    classes only as it collects, which with a large heap is seldom. For queries of very
    many small jobs; the work is a collection for each core, whatever the data.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def bounded(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, broadcast if it has at most ``most`` rows; beyond, left to a shuffle. For narrow checkpointed tables, which have no size of their own."""
    return F.broadcast(df) if df.count() <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The column's texts as UTF-8, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.schema.field(column).type) else pa.binary()
    return batch.column(column).cast(kind).to_pylist()


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema) -> DataFrame:
    """``mapInArrow`` with state made once a task: ``make`` returns the function of a batch."""

    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows, with all their columns, for which the function that ``make`` returns says so."""

    def made():
        keep = make()
        return lambda batch: batch.filter(pa.array(keep(batch), pa.bool_()))

    return map_batches(df, made, df.schema)
