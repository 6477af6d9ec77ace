from tessella.llm.baskets import above_chance, pairs


def test_counts_and_ratio(spark):
    rows = [(1, "A", "x"), (1, " a ", "X"), (2, "a", "x"), (3, "B  b", "y"), (4, None, " "), (None, "a", "x")]
    df = spark.createDataFrame(rows, "id long, one string, two string")
    found = {(r["item_a"], r["item_b"]): (r["pair_count"], r["count_a"], r["count_b"], r["records"], r["lift"]) for r in pairs(df, "id", ["one", "two"]).collect()}
    assert found == {("one=a", "two=x"): (2, 2, 2, 4, 2.0), ("one=b b", "two=y"): (1, 1, 1, 4, 4.0)}


def test_just_at_the_limits(spark):
    rows = [("in", "b", 1, 2, 1, 3), ("out", "b", 1, 2, 1, 2), ("rare", "b", 1, 1, 1, 201)]
    df = spark.createDataFrame([(a, b, *map(int, n)) for a, b, *n in rows], "item_a string, item_b string, pair_count long, count_a long, count_b long, records long")
    assert [r["item_a"] for r in above_chance(df).collect()] == ["in"]
