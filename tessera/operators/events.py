"""Event sums, watermarks, latest rows, identities, upserts, freshness and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def savings(events: DataFrame, *keys: str) -> DataFrame:
    """(keys, events, original, compressed, saved): sums of tokens; a row never saves less than nothing in total."""
    g = events.groupBy(*keys) if keys else events.groupBy()
    sums = g.agg(F.count("*").alias("events"), F.coalesce(F.sum("original"), F.lit(0)).alias("original"), F.coalesce(F.sum("compressed"), F.lit(0)).alias("compressed"))
    return sums.withColumn("saved", F.greatest(F.col("original") - F.col("compressed"), F.lit(0)))


def watermark(events: DataFrame) -> DataFrame:
    return events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("watermark"))


def advance(cached: DataFrame, delta: DataFrame, *keys: str) -> DataFrame:
    """Warm sums and those of newer rows (id above each key's watermark) as one, without reading the old rows."""
    fresh = delta.join(cached.select(*keys, "watermark"), list(keys), "left").where(F.col("watermark").isNull() | (F.col("id") > F.col("watermark"))).drop("watermark")
    new = savings(fresh, *keys).join(fresh.groupBy(*keys).agg(F.max("id").alias("watermark")), list(keys))
    both = cached.unionByName(new.select(*cached.columns))
    out = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("events", "original", "compressed")], F.max("watermark").alias("watermark"))
    return out.withColumn("saved", F.greatest(F.col("original") - F.col("compressed"), F.lit(0))).select(*cached.columns)


def latest(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """The row with the largest order of each key, null keys included."""
    value = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(value, F.col(order)).alias("__v")).select(*keys, "__v.*").select(*rows.columns)


def identity_dedup(rows: DataFrame, identity: list[Column]) -> DataFrame:
    """The row with the smallest id of each null-safe identity."""
    w = Window.partitionBy(*identity).orderBy("id")
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(base: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """changes replace base rows with the same keys (null-safe); the others are added."""
    c = changes.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        one = base[k].eqNullSafe(F.col(f"__{k}"))
        on = one if on is None else on & one
    return base.join(c, on, "left_anti").unionByName(changes)


def insert_new(base: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """changes whose keys base lacks are added, the others ignored."""
    return base.unionByName(changes.dropDuplicates(list(keys)).join(base.select(*keys), list(keys), "left_anti").select(*base.columns))


def freshness(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, verdict) of two snapshots (path, mtime, size, hash): hot, content_fresh, stale, deleted or new."""
    a, b = before.select("path", *[F.col(c).alias(f"a_{c}") for c in ("mtime", "size", "hash")]), now.select("path", *[F.col(c).alias(f"b_{c}") for c in ("mtime", "size", "hash")])
    same = (F.col("a_mtime") == F.col("b_mtime")) & (F.col("a_size") == F.col("b_size"))
    verdict = F.when(F.col("b_hash").isNull(), "deleted").when(F.col("a_hash").isNull(), "new").when(same, "hot").when((F.col("a_size") == F.col("b_size")) & (F.col("a_hash") == F.col("b_hash")), "content_fresh").otherwise("stale")
    return a.join(b, "path", "full_outer").select("path", verdict.alias("verdict"))


def content_hash(content: Column, most: int = 4 << 20) -> Column:
    """A hash for equality; zero for content beyond a size."""
    return F.when(F.octet_length(content) > most, F.lit(0)).otherwise(F.xxhash64(content))


def to_embed(chunks: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """chunks (hash, …) whose vectors can be reused from index (hash, vector), and those to embed."""
    return chunks.join(index.select("hash", "vector").dropDuplicates(["hash"]), "hash"), chunks.join(index.select("hash"), "hash", "left_anti")


def compaction_due(deltas: DataFrame, soft: tuple[int, int] = (1_000, 32 << 20), hard: tuple[int, int] = (5_000, 128 << 20)) -> DataFrame:
    """(files, bytes, due): none, soft or hard, for a table of delta files (size)."""
    s = deltas.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    over = lambda x: (F.col("files") >= x[0]) | (F.col("bytes") >= x[1])
    return s.withColumn("due", F.when(over(hard), "hard").when(over(soft), "soft").otherwise("none"))


def compact(rows: DataFrame, bytes_per_file: int, total_bytes: int, *order: str) -> DataFrame:
    """rows as few files of a size, sorted."""
    return rows.repartitionByRange(1 + total_bytes // bytes_per_file, *order).sortWithinPartitions(*order)


def history(rows: DataFrame, depth: int = 20) -> DataFrame:
    """The newest versions of each path (path, version, …), up to a depth."""
    w = Window.partitionBy("path").orderBy(F.desc("version"))
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= depth).drop("__n")


def as_of(rows: DataFrame, version: int) -> DataFrame:
    """The state of all paths at a version: what a restore brings back."""
    return latest(rows.where(F.col("version") <= version), "version", "path")
