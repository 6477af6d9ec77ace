import pytest

from tessella.sources import files
from tessella.sources.raw_lines import RAW_COLUMNS


def test_raw_files_with_quotes_breaks_and_other_column_orders(spark, tmp_path):
    names = list(RAW_COLUMNS)
    (tmp_path / "reviews_a.csv").write_bytes((",".join(f'"{n}"' for n in names) + "\n" + "1,a,5,1,0.5,1,0,1,2020-01-01,\"caf\xe9, \"\"x\"\"\nline\",t,,,,,p,n,b,9.5\n").encode("latin-1"))
    (tmp_path / "reviews_b.csv").write_text(",".join(names) + "\n2,b,4,0,,0,0,0,2020-01-02,fine,t,,,,,p,n,b,8\n")
    (tmp_path / "other.csv").write_text("x\n1\n")
    df = files.read_raw_files(spark, str(tmp_path))
    found = {r["author_id"]: (r["review_text"], r["source_file"], r["skin_tone"]) for r in df.collect()}
    assert found == {"a": ('caf\xe9, "x"\nline', "reviews_a.csv", None), "b": ("fine", "reviews_b.csv", None)}
    assert {r["source_file"]: r["raw_rows"] for r in files.file_rows(df).collect()} == {"reviews_a.csv": 1, "reviews_b.csv": 1}
    with pytest.raises(FileNotFoundError):
        files.read_raw_files(spark, str(tmp_path), "nothing*.csv")


def test_sinks_and_numbers(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i:03}", i % 7) for i in range(50)], "k string, v int")
    numbered = files.number_rows(df, ["k"], "n", rows_a_range=9)
    assert [r["n"] for r in numbered.orderBy("k").collect()] == list(range(1, 51))
    files.write_tables({"one": df, "two": numbered}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/two")).count() == 50
    files.write_final(df.selectExpr("k", "date'2020-01-05' as d"), str(tmp_path / "f"), {"d": "day", "k": "key"}, ["d"])
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).first().asDict() == {"day": "2020-01-05", "key": "k000"}
    assert files.write_metadata(df.selectExpr("count(*) as rows"), str(tmp_path / "m")) == {"rows": 50}
