"""Joins that survive keys with a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


HEAVY = 1000  # rows of a key that may count as heavy


def join_unique(left: DataFrame, right: DataFrame, key: str, shares: int = 400) -> DataFrame:
    """Inner join of ``left`` with ``right``, in which ``key`` is unique.

    The ``shares`` most frequent keys of ``left`` with more than ``HEAVY`` rows
    have their right rows broadcast (at most ``shares`` rows, whatever the input);
    their left rows stay where they are. All other keys are joined by a shuffle
    in which no key has more than 1/``shares`` of the rows or ``HEAVY`` rows. Null
    keys match nothing. ``left`` is read twice or thrice: materialize it.
    """
    counted = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > HEAVY)
    heavy = [r[0] for r in counted.orderBy(F.desc("count")).limit(shares).collect()]
    if not heavy:
        return left.join(right, key)
    is_heavy = F.col(key).isin(heavy)
    few = right.where(is_heavy)
    return left.where(is_heavy).join(F.broadcast(few), key).unionByName(left.where(~is_heavy).join(right.where(~is_heavy), key))
