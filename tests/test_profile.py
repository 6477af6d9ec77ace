from pyspark.sql import functions as F

from tessella.operators import profile
from tessella.operators.profile import Checked

SCHEMA = "load string, v string, n double, t string, loaded_on date"


def _columns():
    x = F.col("_v").try_cast("decimal(20,4)")
    return [Checked("v", r"^-?[0-9]+$", x.between(1, 5), x, x)]


def _rows(spark):
    rows = [("f_01", "1", 0.5, "x" * 70_000, None), ("f_01", " 2 ", None, "x" * 70_000, None), ("f_01", "9", float("nan"), None, None), ("f_01", "?", 1.0, "", None), ("f_01", None, 1.0, "y", None), ("f_02", "1", 0.5, None, None), ("f_02", "1", 0.5, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stored_counts_merge_with_a_new_load(spark):
    df, cols = _rows(spark), _columns()
    whole = profile.column_profile(profile.value_counts(df, "load", cols))
    apart = profile.merged(profile.value_counts(df.where("load = 'f_01'"), "load", cols), profile.value_counts(df.where("load = 'f_02'"), "load", cols))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, profile.column_profile(apart).collect()))
    name = F.col("load")
    stored = profile.value_counts(df.where("load = 'f_01'"), "load", cols)
    later = profile.load_changes(df.where("load = 'f_02'"), "load", F.substring(name, 1, 1), F.substring(name, 3, 2), cols, stored=stored)
    assert {(r["load"], r["finding"]) for r in profile.findings(later).collect()} == {("f_01", "pattern"), ("f_01", "range"), ("f_02", "null_rate"), ("f_02", "shift")}


def test_every_column_by_its_type(spark):
    df = _rows(spark)
    cols = _columns() + profile.other_columns(df, _columns(), digests=("t",), without=("load",))
    got = {(r["load"], r["column_name"]): r for r in profile.column_profile(profile.value_counts(df, "load", cols)).collect()}
    v, n, t = (got["f_01", c] for c in "vnt")
    assert (v["rows"], v["nulls"], v["distinct_values"], v["malformed"], v["out_of_range"], v["s0"]) == (5, 1, 4, 1, 1, 2)
    assert (n["nulls"], n["distinct_values"], float(n["s1"])) == (2, 2, 2.5)
    assert (t["nulls"], t["distinct_values"], float(t["s1"])) == (2, 2, 140_001.0)


def test_empty_table(spark):
    name = F.col("load")
    changes = profile.load_changes(_rows(spark).limit(0), "load", name, name, _columns())
    assert changes.count() == 0 and profile.findings(changes).count() == 0


def test_columns_of_any_type_are_profiled(spark):
    sql = "select 'f_01' as load, id as k, cast(id as decimal(9,2)) as d, id > 1 as b, date'2020-01-01' + cast(id as int) as day, timestamp'2020-01-01 10:00:00' as at, array(id) as a, cast(id as smallint) as s, case id when 0 then '　x \n' when 1 then 'x' else '  \t' end as t from range(3)"
    df = spark.sql(sql)
    cols = profile.other_columns(df, [], digests=(), without=("load",))
    got = {r["column_name"]: r for r in profile.column_profile(profile.value_counts(df, "load", cols)).collect()}
    assert {n: (r["rows"], r["nulls"], r["distinct_values"]) for n, r in got.items()} == {n: (3, 0, k) for n, k in {"k": 3, "d": 3, "b": 2, "day": 3, "at": 1, "a": 3, "s": 3}.items()} | {"t": (3, 1, 1)}
    assert [float(got[n]["s1"]) for n in ("k", "d", "s")] == [3.0] * 3 and got["day"]["s0"] == 0


def test_queries_profile_every_column(spark, tmp_path, monkeypatch):
    from tessella import queries

    made, whole = [], profile.load_changes
    monkeypatch.setattr(profile, "load_changes", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    names = "review_id bigint, row_index bigint, author_id string, rating string, is_recommended string, price_usd string, submission_time string, review_text string, source_file string, loaded_at timestamp_ntz"
    rows = [(i, i, "a", "9", "1", "5", "2020-01-01", "t", f"reviews_x_0{1 + i % 2}.csv", None) for i in range(6)]
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "reviews.parquet"))
    found = queries.p4_found(spark, str(tmp_path)).collect()
    profiled = {r["column_name"] for r in made[0].select("column_name").collect()}
    assert profiled == {n.split()[0] for n in names.split(", ")} - {"source_file"}
    assert {(r["column_name"], r["finding"]) for r in found} == {("rating", "range"), ("submission_time", "range")}


def test_squares_of_too_large_numbers_are_not_left_out(spark):
    df = spark.sql("select 'f_01' as load, id as small, id * 300000000000 as large from range(3)")
    got = {r["column_name"]: r for r in profile.column_profile(profile.value_counts(df, "load", profile.other_columns(df, [], without=("load",)))).collect()}
    assert (float(got["small"]["s2"]), got["large"]["s2"], got["large"]["deviation"], got["large"]["mean"]) == (5.0, None, None, 3e11)
