"""Clusters of records: k-means, how well they part, what they hold and which number of them to take."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.sampling import hash_order


def k_means(df: DataFrame, columns: list[str], id_col: str, k: int, seed: int, rounds: int = 120) -> tuple[DataFrame, list, float]:
    """(id, cluster) of every row, the centres and the sum of squared distances. Rows with a null feature take no part; with
    fewer different rows than ``k`` there are fewer clusters."""
    vectors = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df.select(id_col, *columns))
    model = KMeans(k=k, seed=seed, maxIter=rounds, tol=0.0, initMode="random", featuresCol="_v", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).select(id_col, "cluster"), model.clusterCenters(), model.summary.trainingCost


def principal(df: DataFrame, columns: list[str], id_col: str, k: int = 2) -> DataFrame:
    """(id, pc1 .. pck): coordinates on the first components of the centred columns; signs are arbitrary."""
    vectors = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip").transform(df.select(id_col, *columns))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(vectors).transform(vectors)
    out = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred).withColumn("_a", vector_to_array("_p"))
    return out.select(id_col, *[F.col("_a")[i].alias(f"pc{i + 1}") for i in range(k)])


def _distance(a: str, b: str, columns: list[str]):
    total = F.lit(0.0)
    for c in columns:
        total = total + F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), 2)
    return F.sqrt(total)


def sampled_silhouette(df: DataFrame, columns: list[str], id_col: str, cluster: str, sample: int = 1800, seed: int = 42) -> DataFrame:
    """One row: the mean silhouette over ``sample`` rows of least hash, by Euclidean distance. This is a sampling operator:
    the bound on the sample is its parameter, and only the sample is paired. A row alone in its cluster has a mean distance of 0
    to it; with one cluster the figure is null."""
    s = df.where(F.col(cluster).isNotNull()).orderBy(hash_order(id_col, seed), id_col).limit(sample).select(id_col, F.col(cluster).alias("c"), *columns)
    pairs = s.alias("a").crossJoin(F.broadcast(s.alias("b"))).select(F.col(f"a.{id_col}").alias("i"), F.col("a.c").alias("own"), F.col("b.c").alias("c"), _distance("a", "b", columns).alias("d"))
    each = pairs.groupBy("i", "own", "c").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("n"))
    own = F.coalesce(F.try_divide(F.col("s"), F.col("n") - 1), F.lit(0.0))
    ab = each.groupBy("i").agg(F.max(F.when(F.col("own") == F.col("c"), own)).alias("a"), F.min(F.when(F.col("own") != F.col("c"), F.col("s") / F.col("n"))).alias("b"))
    value = F.when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).when(F.col("b").isNotNull(), 0.0)
    return ab.agg(F.avg(value).alias("silhouette"), F.count(F.lit(1)).alias("sampled"))


def centroids(df: DataFrame, columns: list[str], cluster: str) -> DataFrame:
    return df.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(*[F.avg(c).alias(c) for c in columns])


def separation(df: DataFrame, columns: list[str], cluster: str) -> DataFrame:
    """One row: the mean distance of the centroids of any two clusters, of which there are few; 0 for one cluster."""
    c = centroids(df, columns, cluster)
    pairs = c.alias("a").join(F.broadcast(c.alias("b")), F.col("a.cluster") < F.col("b.cluster"))
    return pairs.agg(F.coalesce(F.avg(_distance("a", "b", columns)), F.lit(0.0)).alias("separation"))


def representatives(df: DataFrame, columns: list[str], cluster: str, id_col: str, top: int = 3) -> DataFrame:
    """(cluster, id, place, distance) of the ``top`` rows nearest to their cluster's centroid; ties by id."""
    c = centroids(df, columns, cluster).withColumnsRenamed({x: f"_{x}" for x in columns})
    total = F.lit(0.0)
    for x in columns:
        total = total + F.pow(F.col(x) - F.col(f"_{x}"), 2)
    near = df.join(F.broadcast(c), df[cluster] == c["cluster"]).select(c["cluster"], id_col, F.sqrt(total).alias("distance"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.round("distance", 9), id_col))
    return near.withColumn("place", place).where(F.col("place") <= top)


def distributions(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """(cluster, column, dominant, dominant_pct, distribution): the values of each column of each cluster from the most
    frequent on, ties by value; null and blank are Unknown / Missing."""
    value = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("Unknown / Missing"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns]))
    counted = df.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("cluster"), cells.alias("x")).groupBy("cluster", "x.column", "x.value").agg(F.count(F.lit(1)).alias("n"))
    pct = counted.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("cluster", "column")))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value", "pct")))
    out = pct.groupBy("cluster", "column").agg(order.alias("o"))
    text = F.array_join(F.transform("o", lambda x: F.concat(x["value"], F.lit(" "), F.format_string("%.1f", x["pct"]), F.lit("%"))), ", ")
    return out.select("cluster", "column", F.col("o")[0]["value"].alias("dominant"), F.col("o")[0]["pct"].alias("dominant_pct"), text.alias("distribution"))


def cluster_profile(df: DataFrame, cluster: str, themes: list[str], outcomes: list[str], top: int = 3) -> DataFrame:
    """For each cluster: size, share, the ``top`` theme columns by mean (ties by name) with their means, and the means of
    ``outcomes``."""
    rows = df.where(F.col(cluster).isNotNull())
    base = rows.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"avg_{c}") for c in outcomes], *[F.avg(t).alias(t) for t in themes])
    ranked = F.slice(F.array_sort(F.array(*[F.struct((-F.round(F.col(t), 9)).alias("m"), F.lit(t).alias("t")) for t in themes])), 1, top)
    cells = base.withColumns({"_r": ranked, "share_pct": F.col("size") * 100.0 / F.sum("size").over(Window.partitionBy())})
    return cells.select(
        "cluster", "size", "share_pct", *[f"avg_{c}" for c in outcomes], *[x for i in range(top) for x in (F.get("_r", F.lit(i))["t"].alias(f"theme_{i + 1}"), (-F.get("_r", F.lit(i))["m"]).alias(f"theme_{i + 1}_mean"))]
    )


def compare_k(df: DataFrame, clusters: dict[int, str], brand: str) -> DataFrame:
    """For each number of clusters: smallest and largest share, the mean share of the clusters' most frequent brand, and the
    number of clusters under 8 % and of those with a brand of 90 % or more. All numbers come from one pass over the rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("cluster")) for k, c in clusters.items()]))
    counted = df.select(cells.alias("x"), F.col(brand).alias("brand")).where(F.col("x.cluster").isNotNull()).groupBy("x.k", "x.cluster", "brand").agg(F.count(F.lit(1)).alias("n"))
    each = counted.groupBy("k", "cluster").agg(F.sum("n").alias("size"), F.max(F.when(F.col("brand").isNotNull(), F.col("n"))).alias("most"))
    share = each.withColumns({"share": F.col("size") * 100.0 / F.sum("size").over(Window.partitionBy("k")), "brand_share": F.coalesce(F.col("most"), F.lit(0)) * 100.0 / F.col("size")})
    return share.groupBy("k").agg(
        F.count(F.lit(1)).alias("clusters"), F.min("share").alias("smallest_pct"), F.max("share").alias("largest_pct"), F.avg("brand_share").alias("avg_dominant_brand_pct"),
        F.count_if(F.col("share") < 8).alias("tiny_clusters"), F.count_if(F.col("brand_share") >= 90).alias("one_brand_clusters"),
    )


def choose_k(compared: DataFrame, silhouette: str = "silhouette", favourite: int | None = 5) -> DataFrame:
    """``compared`` with ``score``, best first: balanced sizes (up to 4 points), a mean brand share within 55 % (1), a silhouette within
    0.03 of the best (1.5) and half a point for a favourite number; ties to the smaller k."""
    small = F.when(F.col("smallest_pct") >= 10, 2.0).when(F.col("smallest_pct") >= 8, 1.0).otherwise(0.0)
    large = F.when(F.col("largest_pct") <= 50, 2.0).when(F.col("largest_pct") <= 55, 1.0).otherwise(0.0)
    mixed = F.when(F.col("avg_dominant_brand_pct") <= 55, 1.0).otherwise(0.0)
    close = F.when(F.col(silhouette) >= F.max(silhouette).over(Window.partitionBy()) - 0.03, 1.5).otherwise(0.0)
    liked = F.when(F.col("k") == favourite, 0.5).otherwise(0.0) if favourite is not None else F.lit(0.0)
    scored = compared.withColumn("score", small + large + mixed + close + liked)
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "k")))
