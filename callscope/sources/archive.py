"""Archives of rows by dataset and day, in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86400


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    if spark._jsc is not None and not spark._jsc.sc().isStopped():
        remove(spark, path)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a job, below the one that the cluster names in spark.checkpoint.dir; a local one only in a local session without that setting.

    Results are read from it as long as the program runs; it goes when the program ends with the session still open.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set")
        root = "file:///tmp/checkpoints"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    return path


def checksum() -> Column:
    """Aggregate: a number that depends on all ids and times, in any order."""
    return F.sum(F.xxhash64("id", "epoch").cast("decimal(38,0)"))


def manifest(rows: DataFrame, *keys: str) -> DataFrame:
    """By keys and day: rows, coverage, a sum of ids and a checksum."""
    day = F.floor(F.col("epoch") / DAY).alias("day")
    return rows.groupBy(*keys, day).agg(F.count("*").alias("n"), F.min("epoch").alias("first"), F.max("epoch").alias("last"), F.sum("id").alias("id_sum"), checksum().alias("checksum"))


def write(rows: DataFrame, path: str, dataset: str, files: int = 8) -> DataFrame:
    """Writes rows as Parquet by dataset and day, at most `files` for a day, and returns the manifest of what lies there.

    Days that are written again replace what was there, so that a job may run twice.
    """
    kept = rows.withColumns({"dataset": F.lit(dataset), "day": F.floor(F.col("epoch") / DAY)})
    dealt = kept.repartition("day", F.pmod("id", F.lit(files)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "day").parquet(path)
    return manifest(read(rows.sparkSession, path, dataset, rows.schema))


def read(spark: SparkSession, path: str, dataset: str, schema=None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of [start, end) of a dataset; only days that the range touches are opened."""
    reader = spark.read.schema(f"{_ddl(schema)}, dataset string, day bigint") if schema is not None else spark.read
    rows = reader.parquet(path).where(F.col("dataset") == dataset)
    rows = rows.where((F.col("day") >= start // DAY) & (F.col("epoch") >= start)) if start is not None else rows
    rows = rows.where((F.col("day") <= (end - 1) // DAY) & (F.col("epoch") < end)) if end is not None else rows
    return rows.drop("dataset", "day")


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def moved(rows: DataFrame, path: str, dataset: str, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """Rows from the cutoff on, and the manifest of the archive that now holds the older ones."""
    return rows.where(F.col("epoch") >= cutoff), write(rows.where(F.col("epoch") < cutoff), path, dataset)
