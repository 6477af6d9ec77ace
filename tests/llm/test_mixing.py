import random
from collections import defaultdict

from tessella.llm.mixing import _encoding, mix, vocabulary_path

TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def _docs(spark, sizes):
    random.seed(4)
    rows, n = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            rows.append((n, source, "naïve word " * random.randint(0, 30), "clash"))
            n += 1
    return rows, spark.createDataFrame(rows, "doc_id long, source string, text string, uses string")


def _check(spark, sizes, targets, **more):
    rows, docs = _docs(spark, sizes)
    chosen, report = mix(docs, "doc_id", "source", "text", spark.createDataFrame(targets, TARGETS), rows_a_range=20, **more)
    encoding = _encoding(vocabulary_path())
    tokens = {d: len(encoding.encode_ordinary(t)) for d, _, t, _ in rows}
    used, uses, share = defaultdict(int), defaultdict(dict), {}
    for r in chosen.collect():
        assert r["tokens"] == tokens[r["doc_id"]]
        uses[r["mix_name"], r["source"]][r["doc_id"]] = r["uses"]
        used[r["mix_name"], r["source"]] += r["tokens"] * r["uses"]
    for r in report.collect():
        key = r["mix_name"], r["source"]
        assert r["used"] == used[key] <= r["budget"] and r["most_uses"] == max(uses[key].values(), default=0) <= r["max_repeats"]
        assert r["budget"] - r["used"] <= max([tokens[d] for d, s, _, _ in rows if s == key[1]], default=0)
        share[key] = r["actual_share"]
        if uses[key]:
            assert max(uses[key].values()) - min([uses[key].get(d, 0) for d, s, _, _ in rows if s == key[1]]) <= 1
    return share, uses


def test_shares_are_met_with_repeats_and_a_source_without_documents(spark):
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.3, 4), ("m", "none", 0.2, 2), ("n", "b", 1.0, 2)]
    share, uses = _check(spark, {"a": 200, "b": 60, "left out": 30, None: 5}, targets)
    assert abs(share["m", "a"] - 0.625) < 0.02 and abs(share["m", "b"] - 0.375) < 0.02 and share["m", "none"] == 0
    assert share["n", "b"] == 1 and set(uses["n", "b"].values()) == {2}


def test_a_fixed_size_is_cut_exactly(spark):
    share, uses = _check(spark, {"a": 200, "b": 200}, [("m", "a", 0.75, 1), ("m", "b", 0.25, 1)], total_tokens=2000)
    assert abs(share["m", "a"] - 0.75) < 0.05 and 0 < len(uses["m", "b"]) < 200


def test_empty_tables(spark):
    assert _check(spark, {}, [("m", "a", 1.0, 1)])[0] == {("m", "a"): 0.0}
    assert _check(spark, {"a": 3}, [])[0] == {}
