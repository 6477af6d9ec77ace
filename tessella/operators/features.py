"""Columns made ready for models: tiers, scales, indicator columns and shares of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.operators.cleaning import counted_percentile


def price_tiers(df: DataFrame, price: str, out: str = "price_tier", cuts: tuple[float, float] = (1 / 3, 2 / 3)) -> DataFrame:
    """``df`` with low_price, mid_price or high_price by the exact quantiles of all prices; a missing price is high_price."""
    q = counted_percentile(df, [], price, list(cuts)).select(F.col("at")[0].alias("_q1"), F.col("at")[1].alias("_q2"))
    tier = F.when(F.col(price) <= F.col("_q1"), "low_price").when(F.col(price) <= F.col("_q2"), "mid_price").otherwise("high_price")
    return df.crossJoin(F.broadcast(q)).withColumn(out, tier).drop("_q1", "_q2")


def z_scores(df: DataFrame, columns: list[str], prefix: str = "z_") -> DataFrame:
    """``df`` with each column's z-score by population deviation; a constant column gives 0."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    scaled = {prefix + c: (F.col(c) - F.col(f"_m_{c}")) / F.coalesce(F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(1.0)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def min_max(df: DataFrame, column: str, low: float, high: float, out: str) -> DataFrame:
    """``df`` with the column stretched to [low, high]; a constant column gives the middle."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    part = (F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    value = F.when(F.col(column).isNotNull(), F.coalesce(F.lit(low) + part * (high - low), F.lit((low + high) / 2)))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, value).drop("_lo", "_hi")


def label(c: str, unknown: str = "Unknown / Missing") -> Column:
    """The stripped value; null, empty and unknown in any case give ``unknown``."""
    s = strip(c)
    return F.when(s.isNull() | F.lower(s).isin("", "unknown"), unknown).otherwise(s)


def safe_name(prefix: str, value: str) -> str:
    """A column name for one level: its ASCII letters and digits in lower case, runs of others as one underscore."""
    kept = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in value)
    return f"{prefix}_{'_'.join(kept.lower().split())}"


def one_hot(df: DataFrame, column: str, prefix: str, most: int = 1000, drop_first: bool = False) -> DataFrame:
    """``df`` with a 0/1 column for each level in alphabetical order. Raises beyond ``most`` levels, as columns don't scale."""
    levels = [r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{column} has over {most} levels")
    return df.withColumns({safe_name(prefix, v): F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in sorted(levels)[int(drop_first) :]})


def largest_of(columns: list[str]) -> Column:
    """The place, from 1, of the first largest of the columns; null if all are null."""
    a = F.array(*[F.col(c) for c in columns])
    return F.array_position(a, F.array_max(a)).cast("int")


def row_shares(values: Column) -> Column:
    """An array divided by its sum, as it is where that is 0."""
    whole = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return F.transform(values, lambda x: x / F.when(whole == 0, F.lit(1.0)).otherwise(whole))
