import random

from tessella.llm.components import connected_components, groups_by_entities, record_groups, split_records
from pyspark.sql import functions as F


def _by_hand(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_of_chains_stars_and_random_pairs(spark):
    r = random.Random(3)
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(80)] + [(f"r{r.randint(0, 150)}", f"r{r.randint(0, 150)}") for _ in range(90)]
    pairs = [(a, b) for a, b in pairs if a != b]
    df = spark.createDataFrame([*pairs, *pairs[:5], ("x", "x"), (None, "y")], "u string, v string")
    assert {r["node"]: r["root"] for r in connected_components(df).collect()} == _by_hand(pairs)


def test_groups_over_several_entities(spark):
    rows = [(1, "a", "s1"), (2, "a", None), (3, None, "s1"), (4, "b", "s2"), (5, "c", "s2"), (6, None, None), (7, "", ""), (8, "d", "s9")]
    found = groups_by_entities(spark.createDataFrame(rows, "id long, author string, source string"), "id", ["author", "source"]).collect()
    assert {r["id"]: r["group_id"] for r in found} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "u string, v string")
    records = spark.createDataFrame([], "id long, a string, y int")
    assert connected_components(none).count() == 0
    assert record_groups(records, "id", "a", none).count() == 0
    assert split_records(records, "id", "a", none, [("train", 0.8), ("test", 0.2)], F.col("y") == 1).count() == 0


def test_splits_keep_groups_whole_in_the_given_proportions(spark):
    r = random.Random(8)
    rows = [(i, f"a{int(r.random() ** 3 * 900)}", r.randint(0, 1)) for i in range(9000)]
    df = spark.createDataFrame(rows, "id long, a string, y int")
    links = spark.createDataFrame([("a1", "a2"), ("a2", "a700")], "u string, v string")
    out = split_records(df, "id", "a", links, [("train", 0.7), ("validation", 0.1), ("test", 0.2)], F.col("y") == 1).collect()
    groups = {}
    for x in out:
        assert groups.setdefault(x["group_id"], x["split_name"]) == x["split_name"]
    part = {k: sum(x["split_name"] == k for x in out) / len(out) for k in ("train", "validation", "test")}
    assert len(out) == 9000 and abs(part["train"] - 0.7) < 0.005 and abs(part["test"] - 0.2) < 0.005
