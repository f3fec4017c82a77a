"""Corpus inspections: markers, sizes, duplicates, conflicts, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The markers of open work.
MARKERS = ("TODO", "FIXME", "HACK", "XXX", "BUG")
MIN_SPAN, MIN_COPIES, TOP_FILES, TOP_ITEMS = 10, 2, 20, 100


def marker_items(lines: DataFrame) -> DataFrame:
    """(…, marker, author, body) for lines (…, line_text) whose comment opens with a marker; the comment sign is at the start or after a space."""
    comment = r"(?:^|\s)(?://+|#+|--|/\*+|<!--|\*)\s*(" + "|".join(MARKERS) + r")\b(?:\(([^)]*)\))?:?\s*(.*)$"
    rows = lines.where(F.col("line_text").rlike(comment))
    part = lambda i: F.regexp_extract("line_text", comment, i)
    return rows.withColumn("marker", part(1)).withColumn("author", F.nullif(part(2), F.lit(""))).withColumn("body", F.substring(F.trim(F.regexp_replace(part(3), r"\s*(?:\*/|-->)\s*$", "")), 1, 200))


def marker_counts(items: DataFrame, *keys: str) -> DataFrame:
    """A count for each marker, 0 included."""
    return items.groupBy(*keys).agg(*[F.count_if(F.col("marker") == m).alias(m.lower()) for m in MARKERS], F.count("*").alias("total"))


def metrics(files: DataFrame) -> DataFrame:
    """(lang, files, bytes, loc) for each language and, with a null lang, for all."""
    loc = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return files.withColumn("loc", loc.cast("long")).rollup("lang").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("loc").alias("loc"))


def largest_files(files: DataFrame, k: int = TOP_FILES) -> DataFrame:
    loc = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return files.select("path", loc.cast("long").alias("loc")).orderBy(F.desc("loc"), "path").limit(k)


def fragments(lines: DataFrame, span: int = MIN_SPAN) -> DataFrame:
    """(file, hash, start, end) of every window of span lines; digits and names count as they are."""
    w = Window.partitionBy("file").orderBy("line")
    rows = lines.select("file", "line", F.xxhash64("line_text").alias("h")).withColumn("hs", F.collect_list("h").over(w.rowsBetween(0, span - 1)))
    return rows.where(F.size("hs") == span).select("file", F.xxhash64("hs").alias("hash"), F.col("line").alias("start"), (F.col("line") + span - 1).alias("end"))


def duplicate_groups(found: DataFrame) -> DataFrame:
    """(hash, n, file, start, end): fragments that occur twice or more, with the first as sample."""
    return found.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("file", "start", "end")).alias("s")).where(F.col("n") >= MIN_COPIES).select("hash", "n", "s.file", "s.start", "s.end")


def maximal(intervals: DataFrame) -> DataFrame:
    """Intervals (file, start, end, hash) that no earlier one of the file reaches."""
    w = Window.partitionBy("file").orderBy("start", F.desc("end"), "hash").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("before", F.max("end").over(w)).where(F.col("before").isNull() | (F.col("before") < F.col("start"))).drop("before")


def merged_intervals(intervals: DataFrame) -> DataFrame:
    """(file, start, end): overlapping and adjacent intervals as one."""
    w = Window.partitionBy("file").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("new", (before.isNull() | (F.col("start") > before + 1)).cast("int")).withColumn("g", F.sum("new").over(w))
    return rows.groupBy("file", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def duplicated_lines(intervals: DataFrame, totals: DataFrame) -> DataFrame:
    """(file, duplicated, total, percent) of totals (file, total)."""
    n = merged_intervals(intervals).groupBy("file").agg(F.sum(F.col("end") - F.col("start") + 1).alias("duplicated"))
    rows = totals.join(n, "file", "left").withColumn("duplicated", F.coalesce("duplicated", F.lit(0)))
    return rows.withColumn("percent", F.when(F.col("total") == 0, 0.0).otherwise(100.0 * F.col("duplicated") / F.col("total")))


def without_mirrors(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """(hash) of groups (hash, file) without those whose files are all in one expected pair (a, b) and include both."""
    p = pairs.select(F.struct("a", "b").alias("pair"), F.explode(F.array("a", "b")).alias("file")).distinct()
    sizes = groups.groupBy("hash").agg(F.count_distinct("file").alias("files"))
    covered = groups.select("hash", "file").distinct().join(p, "file").groupBy("hash", "pair").agg(F.count_distinct("file").alias("n")).where("n = 2")
    gone = covered.join(sizes, "hash").where("files = 2").select("hash").distinct()
    return groups.select("hash").distinct().join(gone, "hash", "left_anti")


def conflict_regions(lines: DataFrame) -> DataFrame:
    """(file, start, end): from the last start marker before each end marker that has none between."""
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    opens, closes = F.col("line_text").startswith("<<<<<<<"), F.col("line_text").startswith(">>>>>>>")
    marks = lines.where(opens | closes).withColumn("open", F.when(opens, F.col("line"))).withColumn("close", F.when(closes, F.col("line")))
    rows = marks.withColumn("o", F.last("open", True).over(w)).withColumn("c", F.last("close", True).over(w))
    return rows.where(F.col("close").isNotNull() & F.col("o").isNotNull() & (F.col("c").isNull() | (F.col("c") < F.col("o")))).select("file", F.col("o").alias("start"), F.col("line").alias("end"))


def conflict_context(lines: DataFrame, regions: DataFrame, around: int = 3) -> DataFrame:
    """The lines of each region and around it, each once."""
    near = regions.select("file", F.explode(F.sequence(F.greatest(F.col("start") - around, F.lit(1)), F.col("end") + around)).alias("line")).distinct()
    return lines.join(near, ["file", "line"])


def ranked_items(items: DataFrame, k: int = TOP_ITEMS) -> DataFrame:
    """items (role, pos, …): products first, then tests, then tools."""
    rank = F.when(F.col("role") == "product", 0).when(F.col("role") == "test", 1).otherwise(2)
    return items.orderBy(rank, "pos").limit(k)


def diagnostics(rows: DataFrame) -> DataFrame:
    """(file, errors, warnings) of fresh diagnostics, each once."""
    once = rows.where("not stale").dropDuplicates(["file", "line", "severity", "message", "source"])
    return once.groupBy("file").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def health(percent: Column) -> Column:
    return F.when(percent >= 50, "high").when(percent > 0, "some").otherwise("none")


def memory_estimates(**parts: DataFrame) -> DataFrame:
    """(subsystem, rows, bytes) of the named tables: the sizes of their texts and arrays, 8 for any other value."""
    out = None
    for name, df in parts.items():
        width = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.coalesce(F.greatest(F.size(f.name), F.lit(0)) * 8, F.lit(0)) if f.dataType.typeName() == "array" else F.lit(8) for f in df.schema.fields), F.lit(0))
        own = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).cast("long").alias("bytes")).select(F.lit(name).alias("subsystem"), "rows", "bytes")
        out = own if out is None else out.unionByName(own)
    return out
