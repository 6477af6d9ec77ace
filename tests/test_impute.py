from pyspark.sql import functions as F

from tessella.operators.impute import fill_reviews, nearest, review_numbers

SCHEMA = "review_id long, author_id string, product_id string, rating string, price_usd string, helpfulness double, total_feedback_count long, skin_type string, skin_tone string, eye_color string, hair_color string"


def test_missing_numbers_stay_missing(spark):
    rows = [(1, "a", "p", "5", None, None, None, None, None, None, None), (2, "a", "p", "5", "2000", 0.5, 0, None, None, None, None)]
    n = review_numbers()
    df = spark.createDataFrame(rows, SCHEMA).select("review_id", *[c.alias(k) for k, c in n.items()])
    _, away = nearest([{"price": 0.0, "feedback": 9.0, "helpfulness": 1.0}], ["price", "feedback", "helpfulness"], [], 1.0)
    one, two = (r.asDict() for r in df.withColumn("away", away).orderBy("review_id").collect())
    assert one["price"] is None and one["feedback"] is None and one["away"] == 0.0
    assert two["feedback"] == 0.0 and abs(two["price"] - 6.908755) < 1e-6 and two["away"] > 0


def test_missing_price_is_not_filled_from_the_dearest(spark):
    usual = [(i, f"a{i}", "p", "5", "10", 0.9, 3, "dry", "fair", "blue", "brown") for i in range(1, 31)]
    dear = [(i, f"a{i}", "p", "1", "9999", 0.1, 90, "oily", "deep", "green", "black") for i in range(31, 36)]
    lacking = [(i, f"a{i}", "p", "5", None, 0.9, 3, "dry", "fair", "blue", "brown") for i in range(36, 40)]
    found = fill_reviews(spark.createDataFrame(usual + dear + lacking, SCHEMA)).where(F.col("column_name") == "price_usd")
    assert {r["id"]: float(r["value"]) for r in found.collect()} == {i: 10.0 for i in range(36, 40)}
