"""Missing values of whole tables: for each column, for each table, and for chosen columns with their reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _gone(df: DataFrame, c: str) -> Column:
    null = F.col(c).isNull()
    return null | F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else null


def missing_by_column(df: DataFrame, dataset: str) -> DataFrame:
    """(dataset, column, missing_count, missing_pct) of every column, counted in one pass; NaN is missing."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(_gone(df, c)).alias(c) for c in df.columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_count")) for c in df.columns]))
    rows = one.select("_rows", cells.alias("c")).select("_rows", "c.*")
    pct = F.coalesce(F.try_divide(F.col("missing_count") * 100.0, F.col("_rows")), F.lit(0.0))
    return rows.select(F.lit(dataset).alias("dataset"), "column", "missing_count", pct.alias("missing_pct"))


def missing_overview(datasets: dict[str, DataFrame], critical: list[str]) -> DataFrame:
    """A row for each table: rows, columns, missing cells, their share, columns with any and missing critical cells."""
    parts = []
    for name, df in datasets.items():
        each = missing_by_column(df, name)
        rows = df.agg(F.count(F.lit(1)).alias("rows"))
        cells = each.groupBy("dataset").agg(
            F.count(F.lit(1)).alias("columns_checked"), F.sum("missing_count").alias("total_missing_cells"), F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"),
            F.coalesce(F.sum(F.when(F.col("column").isin(critical), F.col("missing_count"))), F.lit(0)).alias("critical_fields_missing_cells"),
        )
        parts.append(cells.crossJoin(rows))
    share = F.coalesce(F.try_divide(F.col("total_missing_cells") * 100.0, F.col("rows") * F.col("columns_checked")), F.lit(0.0))
    return reduce(DataFrame.unionByName, parts).withColumn("overall_missing_pct", share)


def missing_of(datasets: dict[str, DataFrame], described: dict[str, tuple[str, str]]) -> DataFrame:
    """``missing_by_column`` of the ``described`` columns of each table, with their field group and the reason to look."""
    spark = next(iter(datasets.values())).sparkSession
    meta = spark.createDataFrame([(c, g, r) for c, (g, r) in described.items()], "column string, field_group string, included_reason string")
    every = reduce(DataFrame.unionByName, [missing_by_column(df, name) for name, df in datasets.items()])
    return every.join(F.broadcast(meta), "column")
