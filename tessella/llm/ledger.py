"""Duplicates hidden by formatting differences, counted in an incremental ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import letters_digits
from tessella.plans.materialize import delete, new_path
from tessella.plans.skew import join_to_unique

KEY = ["key_a", "key_b"]


def canonical_keys(df: DataFrame, id_col: str, owner: str, fields: tuple[str, str], keep: list[str] | None = None) -> DataFrame:
    """128-bit key of each record: the letters and digits of ``owner`` and of two ``fields`` in either order.

    Rows with an empty owner key, or without a letter or digit in both fields, have no copies and are left out. Two
    64-bit hashes of the canonical text stand for it, so neither text nor its length is ever shuffled. Other columns
    are dropped but for ``keep``; null fields count as empty.
    """
    one, two = (letters_digits(F.col(f)) for f in fields)
    slim = df.select(F.col(id_col).alias("id"), *(keep or []), letters_digits(F.col(owner)).alias("_o"), one.alias("_a"), two.alias("_b"))
    text = F.concat_ws("\x01", "_o", F.least("_a", "_b"), F.greatest("_a", "_b"))
    return (
        slim.where((F.col("_o") != "") & ((F.col("_a") != "") | (F.col("_b") != "")))
        .withColumn("_t", text)
        .select("id", *(keep or []), F.xxhash64("_t").alias("key_a"), F.xxhash64(F.lit(7), F.col("_t")).alias("key_b"))
    )


class CopyLedger:
    """Counts of canonical keys, kept in a folder as a table bucketed by key and updated batch by batch.

    ``add`` aggregates a batch (partly before its shuffle, so a key with a third of all rows costs one row a task),
    full-outer-joins it against the ledger's matching buckets, adds the counts and keeps the smallest id. Only the batch is
    shuffled: the ledger is already bucketed on the key, and the join's result is written without a further shuffle.

    Each state is written whole before the one before it is deleted, so a job that is cut off leaves the last one. A ledger
    made on a folder that holds one goes on from there, in any session, and skips the named batches that it has taken in.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.folder = folder or new_path(spark, "ledger")
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.version, self.batches, self._path = 0, [], None
        if folder and (states := self._states()):
            last = spark.read.parquet(states[-1]).first()
            self.version, self.buckets, self._path, self.batches = last["version"], last["buckets"], last["path"], list(last["batches"])

    def _states(self) -> list[str]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state-*/_SUCCESS")
        return sorted(s.getPath().getParent().toString() for s in pattern.getFileSystem(conf).globStatus(pattern) or [])

    def _table(self, path: str) -> str:
        name = f"tessella_ledger_{uuid.uuid4().hex}"
        self.spark.sql(f"create table {name} (key_a bigint, key_b bigint, copies bigint, first_id bigint) using parquet clustered by (key_a, key_b) into {self.buckets} buckets location '{path}'")
        return name

    def add(self, keys: DataFrame, batch: str | None = None) -> "CopyLedger":
        """Take in a batch of ``canonical_keys``; an empty batch changes no count, and a named one counts once."""
        if batch is not None and batch in self.batches:
            return self
        new = keys.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
        old_path, old_table = self._path, None
        if old_path is not None:
            old_table = self._table(old_path)
            old = self.spark.table(old_table).withColumnsRenamed({"copies": "_copies", "first_id": "_first"})
            new = old.join(new, KEY, "full_outer").select(
                *KEY,
                (F.coalesce("_copies", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("copies"),
                F.least("_first", "first_id").alias("first_id"),
            )
        else:
            new = new.repartition(self.buckets, *KEY)
        name, path = f"tessella_ledger_{uuid.uuid4().hex}", f"{self.folder}/counts-{self.version + 1:06}-{uuid.uuid4().hex}"
        new.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        taken = [*self.batches, *([batch] if batch is not None else [])]
        state = self.spark.createDataFrame([(self.version + 1, self.buckets, path, taken)], "version int, buckets int, path string, batches array<string>")
        state.coalesce(1).write.parquet(f"{self.folder}/state-{self.version + 1:06}")
        for table in (name, old_table):
            if table is not None:
                self.spark.sql(f"drop table {table}")
        for gone in (old_path, f"{self.folder}/state-{self.version:06}" if self.version else None):
            if gone is not None:
                delete(self.spark, gone)
        self.version, self.batches, self._path = self.version + 1, taken, path
        return self

    def counts(self) -> DataFrame:
        """key_a, key_b, copies, first_id of every key so far."""
        schema = "key_a long, key_b long, copies long, first_id long"
        return self.spark.createDataFrame([], schema) if self._path is None else self.spark.read.schema(schema).parquet(self._path)


def fold_batches(df: DataFrame, batch: str, id_col: str, owner: str, fields: tuple[str, str], folder: str | None = None) -> tuple[DataFrame, CopyLedger]:
    """The canonical keys of all rows and the ledger after all batches, in the order of column ``batch``.

    The texts are read once; the keys are written by batch, so each batch is read once too. With the ``folder`` of a kept
    ledger, only batches that it has not taken in are added. The number of batches is that of the loads.
    """
    spark = df.sparkSession
    named = canonical_keys(df.withColumn("_batch", F.coalesce(F.col(batch).cast("string"), F.lit(""))), id_col, owner, fields, ["_batch"])
    path = new_path(spark, "keys")
    named.write.partitionBy("_batch").parquet(path)
    keys = spark.read.schema(f"id {named.schema['id'].dataType.simpleString()}, key_a long, key_b long, _batch string").parquet(path)
    ledger = CopyLedger(spark, folder)
    for row in keys.select("_batch").distinct().orderBy("_batch").collect():
        ledger.add(keys.where(F.col("_batch").eqNullSafe(F.lit(row[0]))), row[0] or "")
    return keys, ledger


def copies_of(keys: DataFrame, ledger: CopyLedger) -> DataFrame:
    """(first_id, id) for each record that is a copy of an earlier one, as the ledger has it."""
    repeated = ledger.counts().where(F.col("copies") > 1)
    found = join_to_unique(keys.select("id", *KEY), repeated, KEY, "copies")
    return found.where(F.col("id") != F.col("first_id")).select("first_id", "id")


def collapsed(df: DataFrame, ledger: CopyLedger, keys: DataFrame, id_col: str) -> DataFrame:
    """One whole record for each key, with its number of copies; records without a key stay as they are, with one."""
    firsts = ledger.counts().select(F.col("first_id").alias(id_col), "copies")
    later = copies_of(keys, ledger).select(F.col("id").alias(id_col))
    clash = {"copies"} & set(df.columns)
    return (
        df.withColumnsRenamed({c: f"{c}_given" for c in clash})
        .join(later, id_col, "left_anti")
        .join(firsts, id_col, "left")
        .withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long"))
    )
