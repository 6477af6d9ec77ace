"""Key figures of groups of reviews, their uncertainty and their stability over time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kpi_by(df: DataFrame, groups: list[str]) -> DataFrame:
    """Reviews, mean rating, recommendation rate in percent, mean price, different products and first and last day of each
    group; null is a group of its own. Sums and counts are merged before the shuffle."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("review_count"), F.avg("rating").alias("avg_rating"), (F.avg("is_recommended") * 100).alias("recommendation_rate"),
        F.avg("price_usd_clean").alias("avg_price_usd"), F.countDistinct("product_id").alias("unique_products"),
        F.date_format(F.min("submission_date"), "yyyy-MM-dd").alias("date_min"), F.date_format(F.max("submission_date"), "yyyy-MM-dd").alias("date_max"),
    )


def size_note(n: Column, very_small: int = 30, small: int = 100) -> Column:
    return F.when(n < very_small, "very small sample").when(n < small, "small sample").otherwise("adequate sample")


def uncertainty(df: DataFrame, levels: dict[str, list[str]], segment: str = "all", z: float = 1.96) -> DataFrame:
    """Normal confidence intervals of mean rating (within 1 to 5) and recommendation rate (within 0 to 100) for the groups
    of every level, in one table: level, first group column as ``brand``, last one as ``segment``."""
    parts = []
    for level, groups in levels.items():
        rows = df if len(groups) == 1 else df.where(F.col(groups[-1]).isNotNull())
        a = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("review_count"), F.avg("rating").alias("m"), F.stddev_samp("rating").alias("sd"), F.avg("is_recommended").alias("p"))
        n, p = F.col("review_count"), F.col("p")
        rating, rate = z * F.coalesce("sd", F.lit(0.0)) / F.sqrt(n), z * F.sqrt(p * (1 - p) / n) * 100
        parts.append(
            a.select(
                F.lit(level).alias("level"), F.col(groups[0]).alias("brand"), (F.lit(segment) if len(groups) == 1 else F.col(groups[-1])).alias("segment"), "review_count",
                F.col("m").alias("avg_rating"), F.greatest(F.lit(1.0), F.col("m") - rating).alias("avg_rating_low"), F.least(F.lit(5.0), F.col("m") + rating).alias("avg_rating_high"),
                (p * 100).alias("recommendation_rate"), F.greatest(F.lit(0.0), p * 100 - rate).alias("recommendation_rate_low"), F.least(F.lit(100.0), p * 100 + rate).alias("recommendation_rate_high"),
                size_note(n).alias("note"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def stability(df: DataFrame, group: str, period: str) -> DataFrame:
    """Months of each group, deviation of the monthly mean rating and rate, and its smallest month; an aggregate of one."""
    monthly = kpi_by(df.where(F.col(period).isNotNull()), [group, period])
    return monthly.groupBy(group).agg(
        F.countDistinct(period).alias("months"), F.stddev_samp("avg_rating").alias("avg_rating_sd"), F.stddev_samp("recommendation_rate").alias("rec_rate_sd"), F.min("review_count").alias("min_reviews")
    )


def shares(counts: DataFrame, within: list[str], n: str, out: str) -> DataFrame:
    """``counts`` with each row's share in percent of its group's total."""
    return counts.withColumn(out, F.col(n) * 100.0 / F.sum(n).over(Window.partitionBy(*within)))


def top_groups(df: DataFrame, within: str, groups: list[str], top: int) -> DataFrame:
    """The ``top`` most frequent combinations of ``groups`` in each ``within``; ties by the groups in order."""
    counted = df.groupBy(within, *groups).agg(F.count(F.lit(1)).alias("review_count"))
    place = F.row_number().over(Window.partitionBy(within).orderBy(F.desc("review_count"), *[F.asc_nulls_first(g) for g in groups]))
    return counted.withColumn("place", place).where(F.col("place") <= top)


def consistency(df: DataFrame, group: str, parts: dict[str, str], required: list[str]) -> DataFrame:
    """(check, expected, actual, status): whether the groups of each partition add up to all rows and nothing required is
    missing. ``parts`` gives the column of each partition."""
    total = F.count(F.lit(1))
    cells = [F.struct(F.lit("groups").alias("check"), F.countDistinct(group).alias("expected"), F.countDistinct(group).alias("actual"))]
    cells += [F.struct(F.lit(f"{name}_counts_sum_to_rows").alias("check"), total.alias("expected"), F.count(c).alias("actual")) for name, c in parts.items()]
    lacking = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in required])
    cells.append(F.struct(F.lit("required_fields_missing").alias("check"), F.lit(0).cast("long").alias("expected"), lacking.alias("actual")))
    one = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    rows = one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(cells))])).alias("r")).select("r.*")
    return rows.withColumn("status", F.when(F.col("expected") == F.col("actual"), "PASS").otherwise("CHECK"))
