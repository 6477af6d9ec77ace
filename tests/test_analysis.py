import math

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import brands, clusters, features, models, rules, terms, topics


def test_terms_keep_order_and_pairs_after_filtering(spark):
    df = spark.createDataFrame([("It's the Dry cheek, and dry-cheek 12!",), ("",), (None,), ("one",), ("ÉTÉ ok",)], "t string")
    found = [r[0] for r in df.select(terms.terms(F.col("t"))).collect()]
    assert found == [["it's", "dry", "cheek", "dry", "cheek", "it's dry", "dry cheek", "cheek dry", "dry cheek"], [], None, [], []]


def test_sentiment_as_by_hand(spark):
    texts = ["not worth the money", "very very dry", "Love this! love this", "", None, "no really gentle", "12 34"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(terms.sentiment(F.col("t"))).collect()]
    want = [(-1.5 + 1.7 - 1.0) / 3, -1.35 / (math.sqrt(3) + 1), (3.0 + 2.0) / 3, 0.0, 0.0, -1.35 / (math.sqrt(3) + 1), 0.0]
    assert np.allclose(got, want)


def test_factorisation_follows_the_update_formulas(spark):
    x = np.array([[1, 0, 2, 0, 1], [0, 1, 0, 3, 0], [2, 0, 1, 0, 0], [0, 2, 0, 1, 1], [1, 1, 1, 1, 1], [0, 0, 0, 0, 0]], float)
    rows = [(i, [int(p) for p in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, places array<int>, weights array<double>")
    w0 = np.array([r["w"] for r in df.select("id", topics.start_weights(2, 42).alias("w")).orderBy("id").collect()])
    h = np.random.default_rng(42).random((2, 5)) + 1e-4
    w, errors = w0, []
    for _ in range(5):
        h = h * (w.T @ x) / np.maximum(w.T @ w @ h, 1e-8)
        w = w * (x @ h.T) / np.maximum(w @ h @ h.T, 1e-8)
        errors.append(np.linalg.norm(x - w @ h))
    weights, matrix, seen = topics.factorise(df, 5, 2, 42, rounds=5, block=2, tolerance=0)
    got = np.array([r["w"] for r in weights.orderBy("id").collect()])
    assert np.allclose(matrix, h) and np.allclose(got, w) and np.allclose(seen, errors[:4]) and all(a >= b - 1e-9 for a, b in zip(seen, seen[1:]))


def test_silhouette_and_representatives(spark):
    points = [(1, 0.0, 0.0, 0), (2, 1.0, 0.0, 0), (3, 10.0, 0.0, 1), (4, 11.0, 0.0, 1), (5, 30.0, 0.0, 2)]
    df = spark.createDataFrame(points, "id long, x double, y double, c int")
    want = []
    for i, x, _, c in points:
        own = [abs(x - p[1]) for p in points if p[3] == c and p[0] != i]
        a = sum(own) / len(own) if own else 0.0
        b = min(np.mean([abs(x - p[1]) for p in points if p[3] == k]) for k in {p[3] for p in points} - {c})
        want.append((b - a) / max(a, b))
    assert math.isclose(clusters.sampled_silhouette(df, ["x", "y"], "id", "c").first()["silhouette"], np.mean(want))
    assert clusters.sampled_silhouette(df.where("c = 0"), ["x", "y"], "id", "c").first()["silhouette"] is None
    assert math.isclose(clusters.separation(df, ["x", "y"], "c").first()[0], np.mean([10.0, 29.5, 19.5]))
    assert {r["cluster"]: r["id"] for r in clusters.representatives(df, ["x", "y"], "c", "id", 1).collect()} == {0: 1, 1: 3, 2: 5}
    found, centres, cost = clusters.k_means(df.where("c < 2"), ["x", "y"], "id", 2, 1)
    assert len({r["cluster"] for r in found.collect()}) == 2 and math.isclose(cost, 1.0)


def test_rules_and_their_counts(spark):
    df = spark.createDataFrame([("t", "lo", "y"), ("t", "lo", "y"), ("t", "hi", "n"), ("u", "lo", "y"), ("u", None, "n")], "a string, b string, c string")
    got = {(r["antecedent"], r["consequent"]): (r["support"], r["confidence"], round(r["lift"], 6)) for r in rules.mine(df, [("a", "b")], ["c"]).collect()}
    assert got[("a=t | b=lo", "c=y")] == (0.4, 1.0, round(1 / 0.6, 6)) and len(got) == 3
    assert rules.filtered(rules.mine(df.limit(0), [("a", "b")], ["c"]), 0.1, 0.1, 1).count() == 0


def test_area_under_the_curve_with_ties(spark):
    y, s = [1, 0, 1, 0, 1, 0, 0, 1], [0.5, 0.5, 0.5, 0.5, 0.9, 0.1, 0.5, 0.1]
    df = spark.createDataFrame([("g", a, b) for a, b in zip(y, s)] + [("h", 1, 0.3)], "g string, y int, s double")
    got = {r["g"]: r["auc"] for r in models.auc(df, ["g"], "y", "s").collect()}
    assert got == {"g": 0.59375, "h": 0.5}
    assert models.figures(df, ["g"], "y", "s").where("g = 'h'").first()["precision"] == 0.0


def test_permuting_moves_every_value_once(spark):
    df = spark.range(500).select("id", F.col("id").alias("v"))
    moved = models.permuted(df, "v", "id", 3, 8).collect()
    assert sorted(r["v"] for r in moved) == list(range(500)) and sum(r["v"] == r["id"] for r in moved) < 5


def test_scales_of_a_constant_and_indicators(spark):
    df = spark.createDataFrame([(1, 2.0, "a b"), (2, 2.0, "c"), (3, None, None)], "id long, x double, k string")
    z = features.min_max(features.z_scores(df, ["x"]), "x", 0.0, 10.0, "m").orderBy("id").collect()
    assert [(r["z_x"], r["m"]) for r in z] == [(0.0, 5.0), (0.0, 5.0), (None, None)]
    hot = features.one_hot(df, "k", "k").orderBy("id").collect()
    assert [(r["k_a_b"], r["k_c"]) for r in hot] == [(1, 0), (0, 1), (0, 0)]


def test_a_brand_that_a_cluster_lacks(spark):
    df = spark.createDataFrame([(1, "a", 5, 1, 0.1), (1, "b", 3, 0, 0.2), (2, "b", 4, 1, 0.3)], "c int, brand string, rating int, is_recommended int, sentiment_score double")
    peers = {r["cluster"]: r for r in brands.against_peers(brands.brand_profile(df, "c"), "a").collect()}
    assert peers[2]["rating"] is None and not peers[2]["weak"] and peers[1]["share_pct"] == 50.0 and peers[1]["weak"]
