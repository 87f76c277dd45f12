"""Session helpers: shipping this package to Python workers, the folder that all share, empty tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once an application.

    The archive is served by the driver, so executors need no folder in common
    with it, and no installation.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="porelight-"), "porelight_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    sc.addPyFile(archive)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the setting ``spark.checkpoint.dir`` of the session.

    A folder of its own is set only where there is none, as in tests on one machine.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or os.path.join(tempfile.gettempdir(), "porelight-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def empty(spark: SparkSession, ddl: str) -> DataFrame:
    """A table without rows that the optimizer knows to be so: joins and unions with it go from the plan."""
    return spark.range(1).where(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(ddl).fields))
