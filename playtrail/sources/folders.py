"""Listing and changing folders wherever the table is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the folders or files that match, in order; [] where there is none."""
    system, where = file_system(spark, pattern)
    return sorted(found.getPath().toString() for found in system.globStatus(where) or ())


def exists(spark: SparkSession, path: str) -> bool:
    system, where = file_system(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    system, where = file_system(spark, path)
    if not system.delete(where, True) and system.exists(where):
        raise OSError(f"cannot delete {path}")


def move(spark: SparkSession, source: str, target: str) -> None:
    """Put a folder in its place in one step."""
    system, where = file_system(spark, target)
    system.mkdirs(where.getParent())
    if not system.rename(file_system(spark, source)[1], where):
        raise OSError(f"cannot move {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    system, where = file_system(spark, path)
    stream = system.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    system, where = file_system(spark, path)
    stream = system.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def folder_states(spark: SparkSession, *paths: str) -> DataFrame:
    """(folder, files, bytes, newest, names) of every folder below the paths that holds Parquet
    files; two listings agree where none of its files was added, taken away or written anew. Spark
    lists the folders; no file is opened."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(list(paths))
    )
    cut = F.regexp_extract("path", "^(.*)/([^/]+)$", 1)
    return files.groupBy(cut.alias("folder")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
        F.max("modificationTime").alias("newest"),
        F.bit_xor(F.xxhash64("path")).alias("names"),
    )
