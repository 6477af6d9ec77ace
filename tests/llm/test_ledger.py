from pyspark.sql import functions as F

from tessella.llm.ledger import CopyLedger, canonical_keys, copies_of, fold_batches

ROWS = [
    (1, "A 1", "Title", "Some text!", "01"), (2, "a1", "some TEXT", "title", "01"), (3, "a1", "title", "some other text", "01"), (4, None, "title", "some text", "01"),
    (5, "a-1", "TITLE", "some   text", "02"), (6, "a1", "!!", None, "02"), (7, "b", None, "x" * 100_000, "02"), (8, "B", "X" * 100_000, "", "03"),
]
SCHEMA = "review_id long, owner string, title string, body string, load string"


def _found(keys, ledger):
    return {tuple(r) for r in copies_of(keys, ledger).collect()}


def test_copies_over_batches(spark):
    keys, ledger = fold_batches(spark.createDataFrame(ROWS, SCHEMA), "load", "review_id", "owner", ("title", "body"))
    assert _found(keys, ledger) == {(1, 2), (1, 5), (7, 8)}
    assert {r["copies"] for r in ledger.counts().collect()} == {3, 1, 2}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessella_ledger")]


def test_a_kept_ledger_goes_on_and_counts_no_batch_twice(spark, tmp_path):
    df, folder = spark.createDataFrame(ROWS, SCHEMA), f"file://{tmp_path}/ledger"
    fold_batches(df.where(F.col("load") == "01"), "load", "review_id", "owner", ("title", "body"), folder)
    keys, ledger = fold_batches(df, "load", "review_id", "owner", ("title", "body"), folder)
    assert ledger.batches == ["01", "02", "03"] and _found(keys, ledger) == {(1, 2), (1, 5), (7, 8)}
    again = CopyLedger(spark, folder)
    assert again.version == 3 and again.counts().agg(F.sum("copies")).first()[0] == 6


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    keys, ledger = fold_batches(df, "load", "review_id", "owner", ("title", "body"))
    assert _found(keys, ledger) == set()
    assert canonical_keys(df, "review_id", "owner", ("title", "body")).count() == 0
