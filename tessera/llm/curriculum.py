"""Mixing sources to target weights over time.

Every source has a target of words and a weight schedule over training time [0, 1], a
piecewise linear density. Its integral, scaled to the target, is the source's cumulative
demand for words. The source's stream is its documents in a fixed pseudo-random order,
pass after pass; a document is due when the cumulative demand reaches its offset in that
stream, so the inverse of the demand at the offset is its training position. Documents
are range-sorted by position.

Targets: sources in code-point order, null last, have the weights 3, 1, 2, repeating, and
share `share` of all words; a target stops at `most` times the source's words and the
excess is shared anew by weight until none is above.

Offsets come from two prefix sums, of buckets in a source and of documents in a bucket,
so a source that holds a third of all rows is spread over many tasks; the order is by
md5 of the id, of which the bucket is the beginning, so the result does not depend on
their number. All of it is DataFrame code.

Defined cases: null text has no words and is never due; null is a source of its own; a
null doc_id is ordered like an empty text; equal rows are taken one after the other; the
last document of a stream is taken in part, up to the target; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _frame

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Knots (time, weight) of the schedules that sources take in turn: rising, falling, even.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)))


def inverse_demand(schedule: Sequence[tuple[float, float]], part: Column) -> Column:
    """The time at which the integral of a schedule reaches a part (0 to 1) of the whole."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule[:-1], schedule[1:], strict=True):
        area = (w0 + w1) / 2 * (t1 - t0)
        if t1 > t0 and area > 0:
            pieces.append((total, t0, w0, (w1 - w0) / (t1 - t0)))
            total += area
    out, following = None, total
    for before, t0, w0, slope in reversed(pieces):
        y = part * total - before
        t = t0 + y / w0 if slope == 0 else t0 + (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * y)) - w0) / slope
        out = t if out is None else F.when(part * total < following, t).otherwise(out)
        following = before
    return out


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with their rank in code-point order, null last, without a task that holds them all."""
    dealt = _frame.stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").count().orderBy("__part").collect()  # a row for each partition
    before, at = {}, 0
    for p, n in sizes:
        before[p] = at
        at += n
    offset = F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]) if before else F.lit(None)
    own = F.row_number().over(Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("rank", own - 1 + offset[F.col("__part")] if before else F.lit(0)).drop("__part")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """(source, source_size, rank, target) from (source, size)."""
    sources = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = _frame.stored(sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * most))
    wanted, level, capped = None, None, -1
    while True:  # each round finds more sources at their cap, or ends
        full = F.lit(False) if level is None else F.col("cap") < F.lit(level) * F.col("weight")
        r = sources.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("int"))).first()
        wanted = share * (r[0] or 0)
        if r[3] == capped or not r[2]:
            break
        level, capped = (wanted - r[1]) / r[2], r[3]
    return sources.select("source", "source_size", "rank", F.least("cap", F.lit(level or 0.0) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, rows_per_bucket: int = 50_000) -> DataFrame:
    """Per row of docs (doc_id, text, source), in the order of training: doc_id, source, size, source_size, target,
    taken (words, over all passes), passes (how often it is due), position (of its first time, null if never) and positions."""
    sizes = _frame.stored(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    plan = targets(sizes, share, most, weights)
    digits = 1
    while sizes.count() / 16**digits > rows_per_bucket:
        digits += 1
    keyed = sizes.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("bucket", F.substring("key", 1, digits))
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.select("source", "bucket", before.alias("before"))
    both = buckets.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source"))).select(F.col("b.source").alias("s"), F.col("bucket").alias("k"), "before", "source_size", "rank", "target")
    rows = keyed.join(both, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("offset", F.col("before") + inner)
    whole = F.floor("target").cast("long")
    passes = F.sequence(F.lit(0), F.lit(max(0, int(-(-most // 1)) - 1)))
    due = F.transform(passes, lambda p: F.col("source_size") * p + F.col("offset"))
    due = F.filter(due, lambda u: (u < whole) & (F.col("size") > 0))
    taken = F.aggregate("due", F.lit(0).cast("long"), lambda n, u: n + F.least(F.col("size"), whole - u))

    def position(u: Column) -> Column:
        out = None
        for i, schedule in enumerate(schedules):
            t = inverse_demand(schedule, u / F.col("target"))
            out = F.when(F.col("rank") % len(schedules) == i, t) if out is None else out.when(F.col("rank") % len(schedules) == i, t)
        return out

    rows = rows.withColumn("due", due).withColumn("positions", F.transform("due", position))
    out = rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), F.size("due").alias("passes"), F.get("positions", F.lit(0)).alias("position"), "positions")
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mixed(docs: DataFrame, **kwargs) -> DataFrame:
    """The rows of docs, with their own columns, as often as the mix takes them (in part counts as once).

    Rows of one doc_id are taken equally often."""
    plan = mix(docs, **kwargs).groupBy(F.col("doc_id").alias("__id")).agg(F.max("passes").alias("__passes")).where("__passes > 0")
    out = docs.join(plan, docs["doc_id"].eqNullSafe(F.col("__id")))
    return out.withColumn("__nth", F.explode(F.expr("sequence(1, __passes)"))).select(*[docs[f"`{c}`"] for c in docs.columns])
