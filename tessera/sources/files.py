"""File sources and sinks: walks, text sniffing, slices, versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths, text

MAX_FILE = 1 << 20
MAX_WALK = 50_000


def walk(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), ignored: list[str] = (".git", "node_modules", "target")) -> DataFrame:
    """(path, size, mtime, content) of the files below a root; content is read only if it is asked for."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    rows = rows.select(F.substring(relative, F.lit(len(root.rstrip("/")) + 2), F.length(relative)).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ignored))) & paths.path_filter(F.col("path"), list(include), list(exclude)))


def bounded(files: DataFrame, most: int = MAX_WALK) -> tuple[DataFrame, bool]:
    """At most so many files, and whether there were more."""
    return files.orderBy("path").limit(most), files.limit(most + 1).count() > most


def is_text(content: Column, size: Column, most: int = MAX_FILE) -> Column:
    """No zero byte and not too large."""
    return (size <= most) & (F.instr(F.hex(F.substring(content, 1, 8192)), "00") % 2 == 0)


def read_slice(files: DataFrame, first: int = 1, last: int = 2000, width: int = 2000) -> DataFrame:
    """(path, line, text): a range of lines, long ones cut."""
    rows = files.select("path", F.posexplode(text.lines(F.col("text"))).alias("line", "line_text"))
    return rows.select("path", (F.col("line") + 1).cast("long").alias("line"), F.substring("line_text", 1, width).alias("text")).where(F.col("line").between(first, last))


def publish(df: DataFrame, folder: str, generation: str, *sort: str) -> None:
    """Write a generation beside the others and point to it afterwards, so readers see the old or the new one."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode("errorifexists").parquet(f"{folder}/{generation}")
    df.sparkSession.createDataFrame([(generation,)], "current string").coalesce(1).write.mode("overwrite").json(f"{folder}/_current")


def current(spark: SparkSession, folder: str, fingerprint: str | None = None) -> DataFrame | None:
    """The published generation, or nothing if it is of another fingerprint."""
    name = spark.read.schema("current string").json(f"{folder}/_current").first()[0]
    return None if fingerprint is not None and not name.startswith(fingerprint) else spark.read.parquet(f"{folder}/{name}")
