from pyspark.sql import functions as F

from tessella.operators import cleaning, kpi, missing, sampling

SCHEMA = (
    "review_id long, row_index long, author_id string, rating string, is_recommended string, helpfulness double, total_feedback_count long, total_neg_feedback_count long, total_pos_feedback_count long,"
    "submission_time string, review_text string, review_title string, skin_tone string, eye_color string, skin_type string, hair_color string, product_id string, product_name string, brand_name string, price_usd string, source_file string"
)


def _row(i, author="a", rating="5", rec="1", when="2020-03-01", text="fine", product="p", brand="B", price="10", skin=None, file="f1"):
    return (i, i, author, rating, rec, None, None, None, None, when, text, None, None, None, skin, None, product, "n", brand, price, file)


ROWS = [
    _row(1), _row(2, file="f2"), _row(3, text="\t fine \n", file="f3"), _row(4, text="  "), _row(5, text=None), _row(6, text="other", rec="2"), _row(7, text="x1", rec="x"), _row(8, text="x2", rec=None),
    _row(9, text="x3", rating="4.5", when="02/28/2020"), _row(10, text="x4", rating="0"), _row(11, text="x5", rating="abc"), _row(12, text="x6", when="30.02.2020", price="-1"), _row(13, text="x7", price="12", brand="b "),
    _row(14, text="x8", price="11", rec="1.0"), _row(15, text="x9", price="9999"), _row(16, text="y1", product=None, price="n/a", brand="C"), _row(17, text="y2", product=None, price="7", brand="D"), _row(18, text="y3", product="q", price=None, brand="D"),
]


def test_cleaning_steps(spark):
    raw = spark.createDataFrame(ROWS, SCHEMA)
    c = {r["review_id"]: r for r in cleaning.clean_reviews(raw).collect()}
    assert sorted(c) == [1, 9, 12, 13, 14, 15, 16, 17, 18]
    assert c[9]["rating"] == 4 and str(c[9]["submission_date"]) == "2020-02-28" and c[12]["submission_date"] is None and c[1]["quarter"] == "2020Q1"
    assert c[12]["price_usd"] is None and c[12]["price_usd_clean"] == 10.5 and c[15]["price_usd"] is None  # the median of 10, 10, 11, 12
    assert c[16]["price_usd_clean"] != 7.0 and c[18]["price_usd_clean"] == 7.0  # no group for a missing product; the brand's median
    assert c[13]["brand"] == "B" and c[1]["skin_type"] == "Unknown"
    log = {r["step"]: (r["rows"], r["removed"], r["set_missing"]) for r in cleaning.cleaning_log(raw).collect()}
    assert log["drop_exact_duplicate_rows"] == (16, 2, 0) and log["drop_duplicate_review_keys"] == (16, 0, 0) and log["drop_missing_review_text"] == (14, 2, 0)
    assert log["drop_rating_outside_1_to_5"] == (9, 2, 0) and log["price_above_fence"][2] == 1 and log["price_not_positive"][2] == 1 and log["parse_submission_time"][2] == 1


def test_empty_table(spark):
    raw = spark.createDataFrame([], SCHEMA)
    clean = cleaning.clean_reviews(raw)
    assert clean.count() == 0 and kpi.kpi_by(clean, ["brand"]).count() == 0
    assert {r["rows"] for r in cleaning.cleaning_log(raw).collect()} == {0}
    assert {r["missing_pct"] for r in missing.missing_by_column(raw, "x").collect()} == {0.0}


def test_intervals_of_one_row_and_of_ties(spark):
    df = spark.createDataFrame([("a", 5, 1), ("b", 1, 0), ("b", 5, 1)], "brand string, rating int, is_recommended int")
    one, two = kpi.uncertainty(df, {"brand": ["brand"]}).orderBy("brand").collect()
    assert (one["avg_rating_low"], one["avg_rating_high"], one["recommendation_rate_low"]) == (5.0, 5.0, 100.0)
    assert (two["avg_rating_low"], two["avg_rating_high"], two["note"]) == (1.0, 5.0, "very small sample")


def test_samples_don_t_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 50).cast("double").alias("v"))
    pick = lambda d: sorted(tuple(r) for r in sampling.sample_by_group(d, "g", "id", 7, 1).select("g", "id").collect())
    assert pick(df) == pick(df.repartition(13)) and len(pick(df)) == 21
    parts = sampling.split_at(df, "id", 0.8, 5).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"train": 800, "test": 200}
    left = sampling.without_top_share(df, "v", "id", 0.03)
    assert left.count() == 970 and left.where("v = 49").count() == 0 and left.where("v = 48").count() == 10
    assert sampling.without_top_share(df.limit(0), "v", "id").count() == 0
