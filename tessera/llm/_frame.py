"""What the operators of this folder share on the Spark side."""

from __future__ import annotations

import ctypes
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_FOLDER = "/tmp/checkpoints"
#: A key with more than one HOT-th of the rows is dealt to SALTS tasks.
HOT, SALTS = 1024, 64
#: Partitions of a shuffle by group number, at most; beyond that a partition has several groups, one after the other.
PARTITIONS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or LOCAL_FOLDER
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that goes when the application ends; results may read it until then."""
    path = f"{shared_folder(spark)}-{name}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(p)
    files.deleteOnExit(p)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there and survives lost executors."""
    path = temporary_folder(df.sparkSession, "rows")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete what stored() wrote for df; nothing may read it any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> list:
    """The keys that have more than total / HOT of all rows: fewer than HOT, whatever the size of the data."""
    return [r[0] for r in counts.where(F.col(n) > max(16, total // HOT)).select(key).collect() if r[0] is not None]


def _marked(df: DataFrame, key: str, hot: list) -> DataFrame:
    """df with __hot: is the key one of the (fewer than HOT) hot ones?"""
    if not hot:
        return df.withColumn("__hot", F.lit(False))
    keys = df.sparkSession.createDataFrame(pa.table({"__key": [bytes(k) if isinstance(k, bytearray) else k for k in hot]}))
    keys = F.broadcast(keys.select(F.col("__key").cast(df.schema[key].dataType).alias(key), F.lit(True).alias("__hot")))
    return df.join(keys, key, "left").withColumn("__hot", F.coalesce("__hot", F.lit(False)))


def dealt(df: DataFrame, key: str, hot: list, salt: str) -> DataFrame:
    """df with the place (salt) of a row among those of its key: rows of hot or null keys are dealt by row numbers to SALTS places.

    The rows must come straight from files, so that a repeated task deals alike."""
    place = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    return _marked(df, key, hot).withColumn(salt, F.when(F.col(key).isNull() | F.col("__hot"), place).otherwise(0).cast("int")).drop("__hot")


def in_all_places(df: DataFrame, key: str, hot: list, salt: str) -> DataFrame:
    """df with a copy of each row for every place of its key."""
    if not hot:
        return df.withColumn(salt, F.lit(0))
    places = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return _marked(df, key, hot).withColumn(salt, F.explode(places)).drop("__hot")


def look_up(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "left") -> DataFrame:
    """left (from files) joined with right, which has a key at most once, so that no key's rows are all in one task."""
    return dealt(left, key, hot, "__salt").join(in_all_places(right, key, hot, "__salt"), [key, "__salt"], how).drop("__salt")


def numbered(df: DataFrame, column: str, n: int) -> DataFrame:
    """df with the rows of each of n groups (a column with 0 to n - 1) in a partition of their own, up to PARTITIONS of them: hashing would put several together."""
    return df.repartitionById(min(n, PARTITIONS), F.col(column))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def as_binary(name: str) -> Column:
    return F.col(name).cast("binary")


def split_by(key: np.ndarray, *arrays: np.ndarray):
    """(key, slices of the arrays) for each distinct key."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key, arrays = key[order], [a[order] for a in arrays]
    cuts = np.flatnonzero(np.diff(key)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
        yield int(key[lo]), [a[lo:hi] for a in arrays]


def one_blas_thread() -> None:
    """Inside a task: keep numpy's BLAS to the task's own core, as threads beside it mostly spin. Without OpenBLAS nothing happens."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def keep_freed_memory() -> None:
    """Inside a task: the process keeps up to 64 MB of freed memory, and arrays of up to 16 MB come from it. By default the C library may give freed arrays back at once, by what the process did before, and each new one is mapped again page by page. Without glibc nothing happens."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD
        mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD
