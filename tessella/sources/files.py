"""Raw review files in, result tables out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources.raw_lines import RAW_COLUMNS


def read_raw_files(spark: SparkSession, folder: str, pattern: str = "reviews*.csv", encoding: str = "ISO-8859-1", columns: list[str] | None = None) -> DataFrame:
    """The records of all files of ``folder`` whose names fit ``pattern``, as strings, with ``source_file``.

    Files are read in one scan; only ``columns`` (all raw columns by default) are kept, by their names in each file's header,
    and records may hold line breaks in quotes. Raises where no file fits.
    """
    wanted = columns or list(RAW_COLUMNS)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    files = sorted(s.getPath().toString() for s in place.getFileSystem(conf).globStatus(place) or [])
    if not files:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    reader = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"').option("nullValue", "").option("pathGlobFilter", pattern)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in reader.csv(files[0]).columns])
    return reader.schema(schema).option("enforceSchema", False).csv(folder).select(*wanted, F.col("_metadata.file_name").alias("source_file"))


def file_rows(df: DataFrame) -> DataFrame:
    """Records of each file."""
    return df.groupBy("source_file").agg(F.count(F.lit(1)).alias("raw_rows"))


def number_rows(df: DataFrame, order: list[str], out: str = "review_id", rows_a_range: int = 1_000_000) -> DataFrame:
    """``df`` with numbers from 1 in the given order, which should be total, or equal rows are numbered in any order.

    Rows are sorted by range over all tasks and numbered from the sizes of the ranges before, so none holds all of them.
    """
    ranges = max(1, -(-df.count() // rows_a_range))
    sorted_rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    numbered = sorted_rows.rdd.zipWithIndex().map(lambda r: (*r[0], r[1] + 1))
    return df.sparkSession.createDataFrame(numbered, T.StructType([*df.schema.fields, T.StructField(out, T.LongType(), False)]))


def write_csv(df: DataFrame, folder: str) -> None:
    """UTF-8 with a header; no byte-order mark, which Spark's writer doesn't know."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(folder)


def write_tables(tables: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    """One folder for each named table, in place of a workbook's sheets; ``kind`` is any of Spark's formats or csv."""
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}") if kind == "csv" else df.write.mode("overwrite").format(kind).save(f"{folder}/{name}")


def write_final(df: DataFrame, folder: str, columns: dict[str, str], days: list[str]) -> None:
    """The chosen columns in order under their new names, with ``days`` written as YYYY-MM-DD."""
    write_csv(df.select(*[(F.date_format(c, "yyyy-MM-dd") if c in days else F.col(c)).alias(name) for c, name in columns.items()]), folder)


def write_metadata(counts: DataFrame, folder: str) -> dict:
    """The only row of ``counts`` as a JSON file; it is given back too."""
    counts.coalesce(1).write.mode("overwrite").json(folder)
    return json.loads(counts.toJSON().first())
