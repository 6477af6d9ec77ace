"""Joins that survive a key which holds a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_to_unique(
    big: DataFrame, small: DataFrame, keys: list[str], weight: str, hot_share: float = 0.001, min_hot: int = 100_000, how: str = "inner"
) -> DataFrame:
    """Inner or left join of ``big`` with ``small``, whose ``weight`` says how many rows of ``big`` each of its unique keys has.

    Keys with at least ``hot_share`` of all rows number at most ``1 / hot_share``, so they are broadcast whatever the
    input's size, and their rows are not moved; all other keys meet in a shuffled join. ``small`` should be materialized,
    as one aggregate over it decides whether there are hot keys. Null keys never match; in a left join they are not shuffled.
    """
    total, largest = small.agg(F.sum(weight), F.max(weight)).first()
    limit = max(float(total or 0) * hot_share, float(min_hot))
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = big.where(whole) if how == "left" else big
    if (largest or 0) < limit:
        joined = rows.join(small.drop(weight), keys, how)
    else:
        hot = F.broadcast(small.where(F.col(weight) >= limit).drop(weight))
        rest = small.where(F.col(weight) < limit).drop(weight)
        joined = rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys, how))
    return joined.unionByName(big.where(~whole), allowMissingColumns=True) if how == "left" else joined
