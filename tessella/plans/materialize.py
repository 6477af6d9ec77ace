"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_folders[app] = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, _own_folders[app], True)
    return "file://" + _own_folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage but the written files, so a lost executor costs a re-read and not a recomputation.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tessella_path = path  # so that discarding it need not list its files
    return back


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark knows; one that isn't there is no error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    delete(df.sparkSession, df._tessella_path)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once for each row: nothing is pushed into or through a generator, while a plain
    projection would be copied to every place that its result is used in."""
    return df.select("*", F.explode(F.array(value)).alias(name))
