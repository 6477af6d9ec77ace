"""Association rules of a constrained form: pairs of columns and what follows from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mine(df: DataFrame, pairs: list[tuple[str, str]], consequents: list[str]) -> DataFrame:
    """Support, confidence and lift of every rule from a pair of columns to a consequent column.

    All families are counted over one table of the different combinations of all columns, which one aggregation of the rows
    gives; what follows works on combinations, not on rows. Null values take no part in a family.
    """
    columns = list(dict.fromkeys([c for p in pairs for c in p] + consequents))
    combos = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    families = []
    for a, b in pairs:
        for c in consequents:
            whole = F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(c).isNotNull()
            item = lambda name: F.concat(F.lit(f"{name}="), F.col(name).cast("string"))
            families.append(F.when(whole, F.struct(F.lit(f"{a} + {b} => {c}").alias("rule_family"), F.concat_ws(" | ", item(a), item(b)).alias("antecedent"), item(c).alias("consequent"))))
    each = combos.select(F.explode(F.array_compact(F.array(*families))).alias("r"), "n").select("r.*", "n")
    counted = each.groupBy("rule_family", "antecedent", "consequent").agg(F.sum("n").alias("rule_count"))
    over = lambda *keys: F.sum("rule_count").over(Window.partitionBy(*keys))
    counted = counted.withColumns({"antecedent_count": over("rule_family", "antecedent"), "consequent_count": over("rule_family", "consequent")})
    total = df.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    confidence, base = F.col("rule_count") / F.col("antecedent_count"), F.col("consequent_count") / F.col("_n")
    return counted.crossJoin(F.broadcast(total)).select(
        "rule_family", "antecedent", "consequent", (F.col("rule_count") / F.col("_n")).alias("support"), confidence.alias("confidence"),
        (confidence / base).alias("lift"), "antecedent_count", "rule_count", base.alias("consequent_support"),
    )


def filtered(rules: DataFrame, support: float, confidence: float, lift: float) -> DataFrame:
    return rules.where((F.col("support") >= support) & (F.col("confidence") >= confidence) & (F.col("lift") >= lift))


def families(rules: DataFrame) -> DataFrame:
    return rules.groupBy("rule_family").agg(F.count(F.lit(1)).alias("rules"), F.max("lift").alias("max_lift"), F.max("confidence").alias("max_confidence"), F.max("support").alias("max_support"))


def sensitivity(rules: DataFrame, base: tuple[float, float, float], strict: tuple[float, float, float]) -> DataFrame:
    """One row: rules that pass the base and the strict limits, those of the base that stay, and their share in percent."""
    ok = [reduce(lambda a, b: a & b, [F.col(c) >= v for c, v in zip(("support", "confidence", "lift"), limits)]) for limits in (base, strict)]
    n = rules.agg(F.count_if(ok[0]).alias("base_rules"), F.count_if(ok[1]).alias("strict_rules"), F.count_if(ok[0] & ok[1]).alias("stable_rules"))
    return n.withColumn("stable_share_pct", F.coalesce(F.try_divide(F.col("stable_rules") * 100.0, F.col("base_rules")), F.lit(0.0)))
