"""Scalar expressions against the values their definitions give."""

import math

import pytest
from pyspark.sql import functions as F

from porelight.functions import expr


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_"))
    return row.select(column.alias("x")).first()[0]


def test_time(spark):
    assert one(spark, expr.time_to_int(F.col("t"), F.lit(4000.0)), t=0.00237) == 9
    assert one(spark, expr.time_to_int(F.col("t"), F.lit(10.0)), t=-0.29) == -2
    assert one(spark, expr.time_to_float(F.col("n"), F.lit(4000.0)), n=9) == pytest.approx(0.002375)
    assert one(spark, expr.as_time(F.col("n"), F.lit(4000.0)), n=14520) == "0:00:03.630"
    assert one(spark, expr.as_time(F.col("n"), F.lit(1.0)), n=math.nan) == "nan"


def test_start_time(spark):
    assert str(one(spark, expr.start_time_of(F.col("t")), t="2016-01-02T03:04:05Z")) == "2016-01-02 03:04:05"
    assert str(one(spark, expr.start_time_of(F.col("t")), t="86400")) == "1970-01-02 00:00:00"
    assert one(spark, expr.start_time_of(F.col("t")), t="soon") is None


def test_fastq(spark):
    assert tuple(one(spark, expr.split_fastq(F.col("f")), f="@n c\nAC\n+\nII")) == ("n c", "AC", "", "II")
    assert tuple(one(spark, expr.split_fastq(F.col("f")), f="@n\nAC\n+")) == ("", "", "", "")
    assert one(spark, expr.build_fastq(F.lit("r"), F.lit("ACGT")), f="") == "@r\nACGT\n+\n!!!!\n"


def test_quality(spark):
    assert one(spark, expr.masked_quality(F.lit("I")), x=0) == 31
    assert one(spark, expr.masked_quality(F.lit("I"), 3), x=0) == 28
    assert [one(spark, expr.quantise(F.col("p"), 2), p=p) for p in (0.0, 0.5, 1.0)] == [0, 2, 3]
    assert [one(spark, expr.dequantise(F.col("v"), 2), v=v) for v in (0, 2, 3)] == [0, 0.5, 0.75]


def test_kmers(spark):
    assert one(spark, expr.kmer_at(F.col("s"), F.lit(2), 3), s="ACGTAC") == "GTA"
    assert one(spark, expr.find_kmer(F.col("s"), F.lit("AC"), F.lit(1)), s="ACGTAC") == 4
    assert one(spark, expr.find_kmer(F.col("s"), F.lit("TT"), F.lit(0)), s="ACGTAC") == -1
    assert one(spark, expr.is_homopolymer(F.col("s")), s="AAA") and not one(spark, expr.is_homopolymer(F.col("s")), s="AAC")


@pytest.mark.parametrize("x", [0.0, 1.0, 1400.5, 0.1, 1234567.0, 1e-5, 3.14159265, 100000.0, 999999.5, -2.5, 1e20, 0.00012345678])
def test_six_digits(spark, x):
    assert one(spark, expr.six_digits(F.col("x")), x=x) == f"{x:g}"


def test_missing_members(spark):
    row = spark.sql("SELECT named_struct('median_before', CAST(NULL AS double), 'abasic_found', CAST(NULL AS bigint), 'read_id', CAST(NULL AS string)) AS p")
    p = row.select(expr.with_defaults(F.col("p")).alias("p")).first()[0]
    assert math.isnan(p.median_before) and p.abasic_found == 2 and p.read_id == ""
    with pytest.raises(ValueError):
        expr.event_stdv(None, None)


def test_caller(spark):
    maps = spark.createDataFrame([({"name": "ONT Sequencing Workflow", "chimaera version": "1"},), ({"name": "MinKNOW-Live-Basecalling", "version": "3"},), ({"x": "y"},)], "m map<string,string>")
    assert [tuple(r[0]) for r in maps.select(expr.caller_of(F.col("m"))).collect()] == [("metrichor", "1+?"), ("minknow", "3"), ("?", "?")]
