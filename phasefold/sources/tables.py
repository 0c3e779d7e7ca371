"""Series from files: any Spark format, values that aren't numbers become null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasefold.operators.latest import q


def read_series(spark: SparkSession, path: str, columns: list[str], order: str | None = None, run: str | None = None, kind: str = "csv") -> DataFrame:
    """(run_id, pos, columns): rows in the order of ``order`` (of the file where none is given) within each run.

    Order keys that are numbers go by value, before all others.
    """
    reader = spark.read.format(kind)
    raw = reader.option("header", True).load(path) if kind == "csv" else reader.load(path)
    raw = raw.withColumn("__n", F.monotonically_increasing_id())
    run_id = F.col(q(run)).try_cast("long") if run else F.lit(0).cast("long")
    key = F.col(q(order)) if order else F.col("__n")
    rows = raw.select(run_id.alias("run_id"), key.alias("__k"), F.col("__n"), *[F.col(q(c)).try_cast("double").alias(c) for c in columns])
    number = [F.asc_nulls_last(F.col("__k").try_cast("double"))] if order and dict(raw.dtypes)[order] == "string" else []
    at = F.row_number().over(Window.partitionBy("run_id").orderBy(*number, "__k", "__n")) - 1
    return rows.select("run_id", at.cast("long").alias("pos"), *[F.col(q(c)) for c in columns])
