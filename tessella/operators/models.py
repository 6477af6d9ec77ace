"""Models of a yes-or-no outcome: feature vectors, logistic regression, forest, exact figures and permutation importance."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vectoriser(words: list[str], numbers: list[str]) -> Pipeline:
    """Indicators of all levels but the alphabetically first, then the numbers. Levels not seen in fitting give no indicator."""
    index = StringIndexer(inputCols=words, outputCols=[f"_i_{w}" for w in words], stringOrderType="alphabetDesc", handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"_i_{w}" for w in words], outputCols=[f"_h_{w}" for w in words], dropLast=True)
    return Pipeline(stages=[index, hot, VectorAssembler(inputCols=[*[f"_h_{w}" for w in words], *numbers], outputCol="features")])


def feature_names(model: PipelineModel, words: list[str], numbers: list[str]) -> list[str]:
    """One name for each place of the vectors; with ``keep``, the encoder's dropped level is that of unseen values."""
    return [f"{w}={v}" for w, levels in zip(words, model.stages[0].labelsArray) for v in levels] + numbers


def logistic(l2: float = 0.002) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="target", regParam=l2, elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10)


def forest(trees: int = 60, depth: int = 6, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="target", numTrees=trees, maxDepth=depth, minInstancesPerNode=15, subsamplingRate=1.0, featureSubsetStrategy="sqrt", seed=seed)


def scored(model, df: DataFrame, *keep: str) -> DataFrame:
    return model.transform(df).select(*keep, "target", vector_to_array("probability")[1].alias("score"))


def auc(df: DataFrame, groups: list[str], label: str, score: str, bins: int = 4096) -> DataFrame:
    """Exact area under the curve of each group with the mean rank for ties, 0.5 where a class is missing.

    Scores are counted by value, ranks start from the counts of ``bins`` ranges of the score in [0, 1], and only values of one
    range are sorted together, so no task holds all scores.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    values = rows.groupBy(*groups, F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p")).withColumn("_b", F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s"))) * bins))
    ranges = values.groupBy(*groups, "_b").agg(F.sum("_n").alias("_m"))
    below = F.coalesce(F.sum("_m").over(Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = values.withColumn("_in", inside).join(ranges.withColumn("_below", below).drop("_m"), [*groups, "_b"])
    mean_rank = F.col("_below") + F.col("_in") + (F.col("_n") + 1) / 2
    sums = ranked.groupBy(*groups).agg(F.sum(F.col("_p") * mean_rank).alias("r"), F.sum("_p").cast("double").alias("p"), F.sum(F.col("_n") - F.col("_p")).cast("double").alias("q"))
    return sums.select(*groups, F.coalesce(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")), F.lit(0.5)).alias("auc"))


def figures(df: DataFrame, groups: list[str], label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and F1 of each group in one pass; a score at the threshold counts as yes, 0 for 0 / 0."""
    yes, true = F.col(score) >= threshold, F.col(label) == 1
    n = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), F.count_if(yes & true).alias("tp"), F.count_if(yes & ~true).alias("fp"), F.count_if(~yes & true).alias("fn"), F.count_if(~yes & ~true).alias("tn"))
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp = F.col("tp")
    return n.select(
        *groups, "rows", part(tp + F.col("tn"), F.col("rows")).alias("accuracy"), part(tp, tp + F.col("fp")).alias("precision"),
        part(tp, tp + F.col("fn")).alias("recall"), part(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"),
    )


def evaluate(df: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    return auc(df, groups, label, score).join(figures(df, groups, label, score), groups)


def permuted(df: DataFrame, column: str, id_col: str, seed: int, blocks: int = 4096) -> DataFrame:
    """``df`` with the values of ``column`` moved by one place in a hash-random order within hash-random blocks."""
    h = F.xxhash64(F.lit(seed), F.lit(column), F.col(id_col))
    w = Window.partitionBy("_b").orderBy("_k", id_col)
    moved = df.withColumns({"_k": h, "_b": F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(column), F.col(id_col)), F.lit(blocks))})
    first = F.first(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return moved.withColumn(column, F.when(F.lead(F.lit(1)).over(w).isNull(), first).otherwise(F.lead(column).over(w))).drop("_k", "_b")


def permutation_importance(vectors: PipelineModel, model, test: DataFrame, columns: list[str], id_col: str, seed: int = 42, blocks: int = 64) -> DataFrame:
    """(feature, auc_drop): what the area under the curve loses when a column's values are permuted; all columns in one job."""
    parts = scored(model, vectors.transform(test), id_col).withColumn("feature", F.lit(""))
    for c in columns:
        parts = parts.unionByName(scored(model, vectors.transform(permuted(test, c, id_col, seed, blocks)), id_col).withColumn("feature", F.lit(c)))
    each = auc(parts, ["feature"], "target", "score")
    base = each.where(F.col("feature") == "").select(F.col("auc").alias("_base"))
    return each.where(F.col("feature") != "").crossJoin(F.broadcast(base)).select("feature", (F.col("_base") - F.col("auc")).alias("auc_drop"))
