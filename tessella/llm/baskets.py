"""Pairs of items that records hold together more often than by chance, counted over collapsed baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import one_spaced
from tessella.plans.materialize import materialize


def baskets(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(items, n): each different set of items that records hold, and the number of records with it.

    An item is the column's name, ``=`` and its value in lower case and one-spaced; null and blank give none. Rows of one
    id are one record, which holds the items of all of them; rows without an id are no record. Records without items count.
    """
    value = {c: F.nullif(one_spaced(c), F.lit("")) for c in columns}
    rows = df.where(F.col(id_col).isNotNull()).select(id_col, *[F.concat(F.lit(f"{c}="), v).alias(f"_{i}") for i, (c, v) in enumerate(value.items())])
    sets = [F.array_sort(F.collect_set(f"_{i}")).alias(f"_{i}") for i in range(len(columns))]
    one = rows.groupBy(id_col).agg(*sets)
    names = [f"_{i}" for i in range(len(columns))]
    return one.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).select(F.array(*names).alias("items"), "n")


def pairs(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Every pair of items of different columns that some record holds: item_a < item_b, ``pair_count``, ``count_a``,
    ``count_b``, the number of ``records`` and ``lift``, the pair's share against the product of the items' shares.

    Pairs are made of the different baskets, not of the records, so their number follows that of the values.
    """
    collapsed = materialize(baskets(df, id_col, columns), "baskets")
    single = materialize(collapsed.select(F.explode(F.flatten("items")).alias("item"), "n").groupBy("item").agg(F.sum("n").alias("n")), "items")
    records = collapsed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"))
    k = len(columns)
    crosses = [(i, j) for i in range(k) for j in range(i + 1, k)]
    parts = [
        collapsed.select(F.explode(F.col("items")[i]).alias("a"), "items", "n").select("a", F.explode(F.col("items")[j]).alias("b"), "n")
        for i, j in crosses
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    both = every.select(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"), "n").groupBy("item_a", "item_b").agg(F.sum("n").alias("pair_count"))
    a = single.select(F.col("item").alias("item_a"), F.col("n").alias("count_a"))
    b = single.select(F.col("item").alias("item_b"), F.col("n").alias("count_b"))
    lift = F.col("pair_count").cast("double") * F.col("records") / (F.col("count_a").cast("double") * F.col("count_b"))
    return both.join(a, "item_a").join(b, "item_b").crossJoin(F.broadcast(records)).withColumn("lift", lift)


def above_chance(found: DataFrame) -> DataFrame:
    """The pairs in at least 0.5 % of all records and at least 1.5 times as often as by chance, compared in whole numbers."""
    n, c, a, b = (F.col(x).cast("decimal(18,0)") for x in ("records", "pair_count", "count_a", "count_b"))
    return found.where((200 * F.col("pair_count") >= F.col("records")) & (c * n >= a * b * F.lit(1.5).cast("decimal(2,1)")))
