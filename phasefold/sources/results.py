"""Results as parquet folders with a note of their kind, on any file system that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


#: The tables of each kind of record and their columns. Runs and targets are columns, so nothing is padded.
RECORDS = {
    "simplex": {"predictions": "run_id long, pos long, target string, pred double, variance double", "scores": "target string, score double"},
    "smap": {"predictions": "run_id long, pos long, target string, pred double, variance double, coef array<double>, sv array<double>", "scores": "target string, score double"},
    "multiview": {"predictions": "run_id long, pos long, target string, pred double", "views": "rank int, combo array<int>, corr double, max_ae double, sum_ae double, rmse double"},
    "selection": {"steps": "target string, step int, variable string, score double, slope double", "candidates": "target string, step int, variable string, score double", "dimensions": "target string, variable string, e int, peak double", "predictions": "run_id long, pos long, target string, pred double"},
    "selection_folds": {"steps": "fold int, target string, step int, variable string, score double, slope double", "predictions": "fold int, run_id long, pos long, target string, pred double"},
    "cross_map": {"skills": "lib_size int, source string, target string, skill double"},
    "cross_map_folds": {"skills": "lib_size int, source string, target string, mean double, std double"},
}


def pack(kind: str, name: str, df: DataFrame) -> DataFrame:
    """A table with exactly the columns and types that its kind of record has; a lost column is an error."""
    if kind not in RECORDS or name not in RECORDS[kind]:
        raise ValueError(f"no table {name!r} of kind {kind!r}")
    columns = [c.strip().split(" ", 1) for c in RECORDS[kind][name].split(", ")]
    lost = [c for c, _ in columns if c not in df.columns]
    if lost:
        raise ValueError(f"columns {lost} are missing")
    return df.select(*[df[f"`{c}`"].cast(t).alias(c) for c, t in columns])


def save(path: str, kind: str, parameters: dict, **tables: DataFrame) -> None:
    """One sub-folder for each table, and the kind and parameters as JSON. Tables of a known kind are packed."""
    if kind in RECORDS:
        tables = {name: pack(kind, name, df) for name, df in tables.items()}
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    note = json.dumps({"kind": kind, "parameters": parameters, "tables": sorted(tables)})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")


def load(spark: SparkSession, path: str) -> tuple[str, dict, dict[str, DataFrame]]:
    meta = json.loads(spark.read.text(f"{path}/_meta").first()[0])
    return meta["kind"], meta["parameters"], {n: spark.read.parquet(f"{path}/{n}") for n in meta["tables"]}
