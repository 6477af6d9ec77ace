"""Samples and splits that don't depend on how rows are partitioned: rows in the order of a hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def sample_by_group(df: DataFrame, group: str, id_col: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each group, those of least hash. The window keeps only ``n`` rows of a group in each task
    before the shuffle, so a group with a third of all rows is not gathered."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(id_col, seed), id_col))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def split_at(df: DataFrame, id_col: str, share: float, seed: int, out: str = "part") -> DataFrame:
    """``df`` with ``out``: train for exactly the first ``floor(share * n)`` rows in hash order, test for the rest.

    The place of the cut is found by counts of hash prefixes and then within one prefix, so rows are never sorted whole.
    """
    h = hash_order(id_col, seed)
    marked = df.withColumns({"_h": h, "_p": F.substring(h, 1, 4)})
    counts = marked.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))  # 65,536 rows at most
    cut = F.floor(F.lit(share) * F.sum("n").over(Window.partitionBy()) + 1e-9)
    places = counts.withColumns({"upto": upto, "cut": cut})
    edge = places.where((F.col("upto") >= F.col("cut")) & (F.col("upto") - F.col("n") < F.col("cut"))).select("_p", (F.col("cut") - F.col("upto") + F.col("n")).alias("take")).first()
    if edge is None:
        return marked.withColumn(out, F.lit("test")).drop("_h", "_p")
    last = marked.where(F.col("_p") == edge["_p"]).select("_h", F.col(id_col).alias("_i")).orderBy("_h", "_i").limit(int(edge["take"])).orderBy(F.desc("_h"), F.desc("_i")).first()
    inside = (F.col("_h") < last["_h"]) | ((F.col("_h") == last["_h"]) & (F.col(id_col) <= last["_i"]))
    return marked.withColumn(out, F.when(inside, "train").otherwise("test")).drop("_h", "_p")


def without_top_share(df: DataFrame, value: str, id_col: str, share: float = 0.01) -> DataFrame:
    """``df`` without the ``ceil(share * n)`` rows (at least one) of largest ``value``; ties by id, nulls last.

    The limit is found by counts of values; only the ties at it are looked at by id.
    """
    n = df.count()
    drop = max(1, -int(-n * share // 1)) if n else 0
    if not drop:
        return df
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc_nulls_last("v")).rowsBetween(Window.unboundedPreceding, 0))
    edge = counts.withColumn("upto", upto).where(F.col("upto") >= drop).orderBy("upto").limit(1).first()
    here = F.col(value).eqNullSafe(F.lit(edge["v"]))
    ids = df.where(here).select(id_col).orderBy(id_col).limit(int(drop - (edge["upto"] - edge["n"])))
    above = F.coalesce(F.col(value) > F.lit(edge["v"]), F.lit(False)) if edge["v"] is not None else F.col(value).isNotNull()
    return df.where(~above).join(ids, id_col, "left_anti")
