"""Brands within clusters: shares against an equal split, differences to the cluster, peers and weak spots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def brand_profile(df: DataFrame, cluster: str = "cluster", brand: str = "brand") -> DataFrame:
    """For each brand of each cluster: reviews, share in percent, its distance from an equal share of all brands, mean rating,
    rate and sentiment and their distance from the cluster's. Rows without cluster or brand take no part."""
    sums = df.where(F.col(cluster).isNotNull() & F.col(brand).isNotNull()).groupBy(F.col(cluster).alias("cluster"), F.col(brand).alias("brand")).agg(
        F.count(F.lit(1)).alias("review_count"), F.sum("rating").alias("_r"), F.count("rating").alias("_rn"), F.sum("is_recommended").alias("_c"), F.count("is_recommended").alias("_cn"), F.avg("sentiment_score").alias("avg_sentiment"),
    )
    own = Window.partitionBy("cluster")
    brands = sums.agg(F.countDistinct("brand").alias("_brands"))
    rate = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    out = sums.withColumns(
        {
            "brand_share_pct": F.col("review_count") * 100.0 / F.sum("review_count").over(own), "avg_rating": rate("_r", "_rn"), "recommendation_rate": rate("_c", "_cn") * 100,
            "cluster_avg_rating": F.try_divide(F.sum("_r").over(own).cast("double"), F.sum("_rn").over(own)), "cluster_rec_rate": F.try_divide(F.sum("_c").over(own) * 100.0, F.sum("_cn").over(own)),
        }
    ).crossJoin(F.broadcast(brands))
    return out.select(
        "cluster", "brand", "review_count", "brand_share_pct", (F.col("brand_share_pct") - F.lit(100.0) / F.col("_brands")).alias("over_index_pct"), "avg_rating", "recommendation_rate", "avg_sentiment",
        "cluster_avg_rating", "cluster_rec_rate", (F.col("avg_rating") - F.col("cluster_avg_rating")).alias("rating_vs_cluster"), (F.col("recommendation_rate") - F.col("cluster_rec_rate")).alias("rec_vs_cluster"),
    )


def against_peers(profile: DataFrame, focal: str) -> DataFrame:
    """For each cluster: the focal brand's figures, the leading brand, the peers' least and largest rating and rate, and
    whether the focal brand is ``weak``: below every peer in rating or in rate, or at or over an equal share. A cluster
    without the focal brand has null figures and is not weak."""
    mine = F.col("brand") == focal
    pick = lambda c: F.max(F.when(mine, F.col(c)))
    peer = lambda f, c: f(F.when(~mine, F.col(c)))
    out = profile.groupBy("cluster").agg(
        pick("brand_share_pct").alias("share_pct"), pick("over_index_pct").alias("over_index_pct"), pick("avg_rating").alias("rating"), pick("recommendation_rate").alias("rec_rate"),
        F.max_by("brand", F.struct("review_count", "brand")).alias("leading_brand"), peer(F.min, "avg_rating").alias("peer_min_rating"), peer(F.max, "avg_rating").alias("peer_max_rating"),
        peer(F.min, "recommendation_rate").alias("peer_min_rec"), peer(F.max, "recommendation_rate").alias("peer_max_rec"),
    )
    weak = (F.col("rating") < F.col("peer_min_rating")) | (F.col("rec_rate") < F.col("peer_min_rec")) | (F.col("over_index_pct") >= 0)
    place = F.when(F.col("over_index_pct") >= 5, "over").when(F.col("over_index_pct") <= -5, "under").when(F.col("over_index_pct").isNotNull(), "even")
    return out.withColumns({"weak": F.coalesce(weak, F.lit(False)), "index_note": place})
