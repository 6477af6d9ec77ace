"""Queries of the models of whether a review recommends, and the SQL that their exact figures are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import models, sampling
from tessella.operators.features import label, z_scores
from tessella.plans.materialize import materialize
from tessella.segment_queries import SEGMENTS, segments
from tessella.sources.tables import table

WORD_COLUMNS = ["brand", "skin_type", "price_tier", "theme"]
NUMBER_COLUMNS = ["z_review_word_count", "z_sentiment_score"]
SEED = 42


def _examples(spark: SparkSession, sf_dir: str, without_dearest: bool = False) -> DataFrame:
    """Reviews with an outcome, their labels and scaled numbers, and the part of the split each is in."""
    s = segments(spark, sf_dir).where(F.col("is_recommended").isNotNull())
    if without_dearest:
        s = sampling.without_top_share(s, "price_usd_clean", "review_id")
    s = s.withColumns({c: label(c) for c in ("brand", "skin_type", "price_tier")}).withColumns({"theme": F.coalesce(F.col("topic").cast("string"), F.lit("none")), "target": F.col("is_recommended").cast("double")})
    s = s.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("review_word_count", "sentiment_score")})
    s = sampling.split_at(s, "review_id", 0.8, SEED)
    scaled = z_scores(s, ["review_word_count", "sentiment_score"])
    return materialize(scaled.select("review_id", "part", "target", *WORD_COLUMNS, *NUMBER_COLUMNS), "examples")


def _fitted(examples: DataFrame):
    train = examples.where(F.col("part") == "train")
    vectors = models.vectoriser(WORD_COLUMNS, NUMBER_COLUMNS).fit(train)
    ready = materialize(vectors.transform(train).select("features", "target"), "vectors")
    return vectors, {"logistic regression": models.logistic().fit(ready), "random forest": models.forest().fit(ready)}


def _metrics(spark: SparkSession, sf_dir: str, without_dearest: bool = False) -> DataFrame:
    examples = _examples(spark, sf_dir, without_dearest)
    vectors, fitted = _fitted(examples)
    test = vectors.transform(examples.where(F.col("part") == "test"))
    parts = None
    for name, model in fitted.items():
        one = models.scored(model, test, "review_id").withColumn("model", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return models.evaluate(parts, ["model"], "target", "score")


def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with an outcome, how many recommend, and the sizes of the split."""
    s = sampling.split_at(segments(spark, sf_dir).where(F.col("is_recommended").isNotNull()), "review_id", 0.8, SEED)
    return s.agg(F.count(F.lit(1)).alias("reviews"), F.round(F.avg("is_recommended") * 100, 6).alias("recommended_pct"), F.count_if(F.col("part") == "train").alias("train_size"), F.count_if(F.col("part") == "test").alias("test_size"))


def score_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well sentiment alone tells who recommends, for each price tier."""
    s = segments(spark, sf_dir).where(F.col("is_recommended").isNotNull() & F.col("price_tier").isNotNull() & F.col("sentiment_score").isNotNull())
    scored = s.withColumn("score", F.round(1 / (1 + F.exp(-F.col("sentiment_score"))), 9))
    e = models.evaluate(scored, ["price_tier"], "is_recommended", "score")
    return e.select("price_tier", "rows", *[F.round(c, 6).alias(c) for c in ("auc", "accuracy", "precision", "recall", "f1")])


def model_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models on the held-out fifth."""
    return _metrics(spark, sf_dir)


def model_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models with and without the dearest hundredth, and what changes."""
    base, other = (_metrics(spark, sf_dir, w).select("model", F.col("auc").alias(f"auc_{n}"), F.col("f1").alias(f"f1_{n}")) for w, n in ((False, "base"), (True, "robust")))
    return base.join(other, "model").withColumns({"auc_change": F.col("auc_robust") - F.col("auc_base"), "f1_change": F.col("f1_robust") - F.col("f1_base")})


def logistic_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients, odds ratios and directions, the largest first."""
    vectors, fitted = _fitted(_examples(spark, sf_dir))
    names = models.feature_names(vectors, WORD_COLUMNS, NUMBER_COLUMNS)
    rows = [(n, float(c)) for n, c in zip(names, fitted["logistic regression"].coefficients)]
    df = spark.createDataFrame(rows, "feature string, coefficient double")
    return df.withColumns({"odds_ratio": F.exp("coefficient"), "direction": F.when(F.col("coefficient") >= 0, "positive").otherwise("negative")}).orderBy(F.abs("coefficient").desc(), "feature")


def forest_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each column is worth to the forest: gain of its splits, and loss of area when it is permuted."""
    examples = _examples(spark, sf_dir)
    vectors, fitted = _fitted(examples)
    names = models.feature_names(vectors, WORD_COLUMNS, NUMBER_COLUMNS)
    gains: dict[str, float] = {}
    for n, g in zip(names, fitted["random forest"].featureImportances.toArray()):
        column = n.split("=", 1)[0]
        gains[column] = gains.get(column, 0.0) + float(g)
    gain = spark.createDataFrame(list(gains.items()), "feature string, split_gain double")
    drops = models.permutation_importance(vectors, fitted["random forest"], examples.where(F.col("part") == "test"), [*WORD_COLUMNS, *NUMBER_COLUMNS], "review_id")
    return gain.join(drops, "feature")


def queries() -> dict:
    return {f.__name__: f for f in (class_balance, score_figures, model_figures, model_robustness, logistic_coefficients, forest_importance)}


def oracle_sql() -> dict[str, str]:
    r6 = lambda *cs: ", ".join(f"round({e}, 6) as {c}" for c, e in cs)
    return {
        "class_balance": f"""with {SEGMENTS}, e as (select *, row_number() over (order by md5('{SEED}:' || review_id), review_id) as place, count(*) over () as n from s where is_recommended is not null)
            select count(*) as reviews, round(avg(is_recommended) * 100, 6) as recommended_pct, count(*) filter (place <= floor(0.8 * n)) as train_size, count(*) filter (place > floor(0.8 * n)) as test_size from e""",
        "score_figures": f"""with {SEGMENTS}, e as (select price_tier, is_recommended as y, round(1 / (1 + exp(-sentiment_score)), 9) as z from s where is_recommended is not null and price_tier is not null and sentiment_score is not null),
            k as (select *, rank() over (partition by price_tier order by z) + (count(*) over (partition by price_tier, z) - 1) / 2.0::double as r from e),
            g as (select price_tier, count(*) as rows, sum(r) filter (y = 1) as sr, sum(y)::double as p, sum(1 - y)::double as q, count(*) filter (z >= 0.5 and y = 1)::double as tp, count(*) filter (z >= 0.5 and y = 0)::double as fp, count(*) filter (z < 0.5 and y = 1)::double as fn, count(*) filter (z < 0.5 and y = 0)::double as tn from k group by price_tier)
            select price_tier, rows, {r6(('auc', 'coalesce((sr - p * (p + 1) / 2) / nullif(p * q, 0), 0.5)'), ('accuracy', '(tp + tn) / rows'), ('precision', 'coalesce(tp / nullif(tp + fp, 0), 0)'), ('recall', 'coalesce(tp / nullif(tp + fn, 0), 0)'), ('f1', 'coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)'))} from g""",
    }
