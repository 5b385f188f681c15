"""Materialisation of rollups from archives, with progress by file: each file is read once, and a file that has changed since is an error.

The ledger lists the files whose rows are in the rollup, with their size and time. A run lists the archive (without opening files), refuses if a known file is gone or
isn't what it was, reads the days that hold new files, and of these the new files alone. Rollup and ledger are written by run, the ledger last: a
run that dies between is done again, and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive

_LEDGER = "file string, size long, modified timestamp, day long, n long, run int"


class ChangedArchive(ValueError):
    """A file that is in a rollup isn't any more what was read."""


def listed(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """file, size, modified, day of each file of a dataset; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{path}/dataset={dataset}")
    day = F.regexp_extract("path", r"/day=(-?\d+)/", 1).cast("long")
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), day.alias("day"))


def known(spark: SparkSession, root: str, run: int) -> DataFrame:
    """The ledger of the runs before `run`."""
    empty = spark.createDataFrame([], _LEDGER)
    return empty if run == 0 else spark.read.schema(_LEDGER).parquet(f"{root}/ledger").where(F.col("run") < run)


def materialise(spark: SparkSession, path: str, dataset: str, schema, root: str, run: int, rollup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds the rows of all files that the ledger below `root` lacks to its rollup, as run number `run`; returns the ledger's rows of this run."""
    files, before = listed(spark, path, dataset), known(spark, root, run)
    same = ["file", "size", "modified"]
    odd = before.join(files, same, "left_anti").select("file").first()
    if odd:
        raise ChangedArchive(odd[0])
    new = files.join(before, same, "left_anti")
    days = [r[0] for r in new.select("day").distinct().collect()]  # partitions, to open no others
    rows = spark.read.schema(f"{archive._ddl(schema)}, dataset string, day bigint").parquet(path).where((F.col("dataset") == dataset) & F.col("day").isin(days or [None]))
    held = rows.withColumn("__file", F.col("_metadata.file_path")).join(new.select(F.col("file").alias("__file")), "__file", "left_semi")
    rollup(held.drop("dataset", "day", "__file")).write.mode("overwrite").parquet(f"{root}/rollup/run={run}")
    counts = held.groupBy(F.col("__file").alias("file")).agg(F.count("*").alias("n"))
    written = new.join(counts, "file", "left").select("file", "size", "modified", "day", F.coalesce("n", F.lit(0)).alias("n"))
    written.write.mode("overwrite").parquet(f"{root}/ledger/run={run}")
    return spark.read.schema(_LEDGER).parquet(f"{root}/ledger").where(F.col("run") == run)


def rollups(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all runs, with the run that made them."""
    return spark.read.parquet(f"{root}/rollup")
