"""Of rows delivered more than once, the one that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], stamp: str, values: list[str]) -> DataFrame:
    """One row per key: the values of the row with the largest ``stamp``.

    A null stamp counts as oldest. Rows that tie on the stamp give, column by
    column, the smallest value (nulls last), so the result does not depend on
    the order of arrival. Rows with a null in a key cannot be told apart and are
    dropped. A null value of the latest row stays null: it withdraws the reading.
    """
    when = F.coalesce(F.col(q(stamp)).cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800)))
    known = [F.col(q(k)).isNotNull() for k in keys]
    slim = df.where(_all(known)).select(*[F.col(q(k)) for k in keys], when.alias("__at"), *[F.col(q(v)) for v in values])
    slim = slim.repartition(*[F.col(q(k)) for k in keys])  # both aggregations below keep this partitioning
    each = slim.groupBy(*[F.col(q(k)) for k in keys], "__at").agg(*[F.min(F.col(q(v))).alias(f"__v{i}") for i, v in enumerate(values)])
    last = each.groupBy(*[F.col(q(k)) for k in keys]).agg(*[F.max_by(f"__v{i}", "__at").alias(v) for i, v in enumerate(values)])
    return last


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
