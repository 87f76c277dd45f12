"""The coder of ``range_coder`` as functions of Spark, which run on the executors' JVMs.

``BlockCoder.java`` is compiled on the driver by Janino, with which Spark compiles
what it generates, and sent to the executors as a jar of the application.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_made: dict[str, object] = {}  # the coder of an application


def _coder(spark: SparkSession):
    sc = spark.sparkContext
    if sc.applicationId not in _made:
        jvm = sc._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(Path(__file__).with_name("BlockCoder.java").read_text())
        jar = os.path.join(tempfile.mkdtemp(prefix="porelight-"), "porelight_block_coder.jar")
        with zipfile.ZipFile(jar, "w") as out:
            for name, code in dict(compiler.getBytecodes()).items():
                out.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        sc._jsc.addJar(jar)
        _made[sc.applicationId] = compiler.getClassLoader().loadClass("porelight.BlockCoder").getDeclaredConstructor(sc._gateway.new_array(jvm.java.lang.Class, 0)).newInstance(sc._gateway.new_array(jvm.java.lang.Object, 0))
    return _made[sc.applicationId]


def _called(spark: SparkSession, name: str, function, column: str) -> Column:
    spark._jsparkSession.udf().register(name, function, spark.sparkContext._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return F.call_udf(name, F.col(column))


def encoded(spark: SparkSession, column: str, id_bits: int = 16) -> Column:
    """Blocks of ``column``, which has ids as little-endian integers of 16 bits, or of 32 where ``id_bits`` are over 16."""
    return _called(spark, f"porelight_encode_{id_bits}", _coder(spark).encoder(id_bits), column)


def decoded(spark: SparkSession, column: str, id_bits: int = 16) -> Column:
    """The ids of blocks, as ``encoded`` takes them; a block that is damaged ends the query."""
    return _called(spark, f"porelight_decode_{id_bits}", _coder(spark).decoder(id_bits), column)
