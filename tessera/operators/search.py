"""Pattern search: a gate for regular expressions, a trigram plan, an inverted index, grep and glob."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import grams, paths, text

with warnings.catch_warnings():
    warnings.simplefilter("ignore")
    from re import _constants as _kinds
    from re import _parser

MAX_FILE = 1 << 20
MAX_WALK = 50_000
MAX_MATCHES = 100
MAX_GLOB = 100
#: Files of an index bucket, at least.
FILES = 4


def unsupported(pattern: str) -> str | None:
    """The feature that a linear-time engine lacks: look-around, back-references, possessive or atomic groups."""
    escaped = re.sub(r"\\\\", "", pattern)
    for name, sign in (("lookahead", r"(?<!\\)\(\?[=!]"), ("lookbehind", r"(?<!\\)\(\?<[=!]"), ("atomic group", r"(?<!\\)\(\?>"), ("backreference", r"\\[1-9]|\\k<|\(\?P="), ("possessive quantifier", r"(?<!\\)[*+?}]\+")):
        if re.search(sign, escaped):
            return name
    return None


@dataclass
class TrigramPlan:
    """Trigrams that every match has, and groups of which it has at least one."""

    all_of: set[str] = field(default_factory=set)
    any_of: list[set[str]] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not self.all_of and not self.any_of


def _grams(run: str) -> set[str]:
    low = run.translate(str.maketrans(text.UPPER, text.LOWER))
    return {low[i : i + 3] for i in range(len(low) - 2)}


def _walk(items) -> tuple[list[str], list[set[str]]]:
    """Literal runs that must occur, and groups of trigrams of which one must."""
    runs, groups, run = [], [], ""
    for op, arg in items:
        if op is _kinds.LITERAL:
            run += chr(arg)
            continue
        if op is _kinds.SUBPATTERN and not arg[1] and not arg[2]:
            inner, more = _walk(arg[3])
            whole = all(o is _kinds.LITERAL for o, _ in arg[3])
            if whole and inner:
                run += inner[0]
                continue
            runs += [run, *inner]
            groups += more
        elif op in (_kinds.MAX_REPEAT, _kinds.MIN_REPEAT) and arg[0] >= 1:
            inner, more = _walk(arg[2])
            runs.append(run + inner[0] if inner and all(o is _kinds.LITERAL for o, _ in arg[2]) else run)
            runs += inner
            groups += more
        elif op is _kinds.BRANCH:
            runs.append(run)
            choices: set[str] | None = set()
            for branch in arg[1]:
                inner, _ = _walk(branch)
                own = set().union(*map(_grams, inner)) if inner else set()
                choices = choices | own if own and choices is not None else None
            if choices:
                groups.append(choices)
        else:
            runs.append(run)
        run = ""
    return [r for r in [*runs, run] if r], groups


def trigram_plan(pattern: str, literal: bool = False, ignore_case: bool = False) -> TrigramPlan:
    """What the index can tell about a pattern; empty if nothing, and then all documents are candidates."""
    if ignore_case and not pattern.isascii():
        return TrigramPlan()
    if literal:
        return TrigramPlan(_grams(pattern))
    runs, groups = _walk(_parser.parse(pattern))
    return TrigramPlan(set().union(*map(_grams, runs)) if runs else set(), groups)


def predicate(column: Column, pattern: str, literal: bool = False, ignore_case: bool = False) -> Column:
    if literal:
        return text.fold_ascii(column).contains(pattern.translate(str.maketrans(text.UPPER, text.LOWER))) if ignore_case else column.contains(pattern)
    if feature := unsupported(pattern):
        raise ValueError(f"unsupported regular expression: {feature}")
    return column.rlike(("(?im)" if ignore_case else "(?m)") + pattern)


def postings(docs: DataFrame) -> DataFrame:
    """(trigram, doc_id, next_mask) of docs (doc_id, text); trigrams are packed longs, next_mask has a bit for each character that follows."""
    return docs.select("doc_id", F.inline(grams.posted(F.col("text")))).select("trigram", "doc_id", "next_mask")


def write_index(docs: DataFrame, folder: str, buckets: int = 64) -> None:
    """The postings under folder, a directory for each bucket of trigrams, sorted so that row groups can be skipped."""
    rows = postings(docs).withColumn("bucket", F.pmod(F.xxhash64("trigram"), F.lit(buckets)).cast("int"))
    # documents of a bucket are dealt to several files, so a trigram that most documents have is not one task's
    part = F.pmod(F.xxhash64("doc_id"), F.lit(FILES))
    rows.repartition(F.col("bucket"), part).sortWithinPartitions("bucket", "trigram", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_sizes(index: DataFrame) -> DataFrame:
    """(doc_id, n): how many distinct trigrams each document has."""
    return index.groupBy("doc_id").agg(F.count("*").alias("n"))


def read_index(spark: SparkSession, folder: str, trigrams: set[str] | None = None, buckets: int = 64) -> DataFrame:
    """The postings of some trigrams: only their buckets are read."""
    if not trigrams:
        rows = spark.read.parquet(folder).drop("bucket")
        return rows if trigrams is None else rows.limit(0)
    keys = sorted(map(grams.packed, trigrams))
    own = sorted(set(spark.sql("SELECT 1").select(*[F.pmod(F.xxhash64(F.lit(k)), F.lit(buckets)).cast("int") for k in keys]).first()))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [p for p in (f"{folder.rstrip('/')}/bucket={b}" for b in own) if files.exists(path(p))]
    if not there:
        return spark.read.parquet(folder).drop("bucket").limit(0)
    return spark.read.parquet(*there).where(F.col("trigram").isin(keys))


def plan_trigrams(plan: TrigramPlan) -> set[str]:
    """All that a plan looks up."""
    return plan.all_of.union(*plan.any_of)


def snapshot(base: DataFrame, delta: DataFrame, superseded: DataFrame) -> DataFrame:
    """Base postings without superseded documents, and the delta's."""
    return base.join(superseded.select("doc_id"), "doc_id", "left_anti").unionByName(delta)


def candidates(index: DataFrame, plan: TrigramPlan) -> DataFrame:
    """doc_ids that have all of a plan's trigrams and one of each group."""
    keys = lambda ts: sorted(map(grams.packed, ts))
    hits = index.where(F.col("trigram").isin(keys(plan.all_of.union(*plan.any_of)))).groupBy("doc_id").agg(F.count_if(F.col("trigram").isin(keys(plan.all_of))).alias("n"), *[F.max(F.col("trigram").isin(keys(g))).alias(f"g{i}") for i, g in enumerate(plan.any_of)])
    keep = F.col("n") == len(plan.all_of)
    for i in range(len(plan.any_of)):
        keep = keep & F.col(f"g{i}")
    return hits.where(keep).select("doc_id")


def line_table(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, line from 1, line_text) of docs (text)."""
    return docs.select(*keys, F.posexplode(text.lines(F.col("text"))).alias("line", "line_text")).withColumn("line", (F.col("line") + 1).cast("long"))


def grep(docs: DataFrame, pattern: str, literal: bool = False, ignore_case: bool = False, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, line, column, line_text, match_text): the first match of each line. With an index, only its candidates are searched."""
    hit = predicate(F.col("text"), pattern, literal, ignore_case)
    plan = trigram_plan(pattern, literal, ignore_case)
    if index is not None and not plan.empty:
        docs = docs.join(candidates(index, plan), "doc_id", "left_semi")  # the pattern is left to the lines: as a filter of docs it would go below the join
    else:
        docs = docs.where(hit)  # before lines are made: it reaches the scan
    rows = line_table(docs, "doc_id").where(predicate(F.col("line_text"), pattern, literal, ignore_case))
    if literal:
        at = F.instr(text.fold_ascii(F.col("line_text")), pattern.translate(str.maketrans(text.UPPER, text.LOWER))) if ignore_case else F.instr("line_text", pattern)
        return rows.select("doc_id", "line", at.cast("long").alias("column"), "line_text", F.substring("line_text", at, F.lit(len(pattern))).alias("match_text"))
    own = F.regexp_extract("line_text", ("(?i)" if ignore_case else "") + f"({pattern})", 1)
    return rows.withColumn("match_text", own).select("doc_id", "line", F.instr("line_text", F.col("match_text")).cast("long").alias("column"), "line_text", "match_text")


def capped(matches: DataFrame, most: int = MAX_MATCHES) -> DataFrame:
    """Matches in file order up to a limit; totals are counted apart."""
    return matches.orderBy("doc_id", "line", "column").limit(most)


def display_cap(matches: DataFrame, above: int = 10, shown: int = 5) -> DataFrame:
    """Of files with more than above matches the first few, with the number of the others."""
    own = Window.partitionBy("doc_id")
    rows = matches.withColumn("n", F.count("*").over(own)).withColumn("nth", F.row_number().over(own.orderBy("line", "column")))
    return rows.where((F.col("n") <= above) | (F.col("nth") <= shown)).withColumn("remaining", F.when(F.col("n") > above, F.col("n") - shown).otherwise(0).cast("long")).drop("n", "nth")


def by_mtime(matches: DataFrame, files: DataFrame) -> DataFrame:
    return matches.join(files.select("doc_id", "path", "mtime"), "doc_id").orderBy(F.desc("mtime"), "path", "line", "column")


def merge_roots(results: DataFrame) -> DataFrame:
    """Matches of several roots, each once."""
    return results.dropDuplicates(["doc_id", "line", "column"])


def glob(files: DataFrame, pattern: str, root: str = "", most: int | None = MAX_GLOB) -> DataFrame:
    out = files.where(paths.within(F.col("path"), root) & paths.path_filter(F.col("path"), [pattern])).select("path").orderBy("path")
    return out if most is None else out.limit(most)


def by_directory(files: DataFrame) -> DataFrame:
    """(dir, names sorted, n)."""
    return files.groupBy(paths.directory(F.col("path")).alias("dir")).agg(F.sort_array(F.collect_list(paths.file_name(F.col("path")))).alias("names"), F.count("*").alias("n"))


def artifact_directories(files: DataFrame, share: float = 0.6) -> DataFrame:
    """Folders of which at least share of the files are build artifacts: (dir, files, artifacts)."""
    low = F.lower(F.col("path"))
    artifact = low.rlike("(" + "|".join(map(re.escape, paths.ARTIFACT_SUFFIXES)) + ")$")
    return files.groupBy(paths.directory(F.col("path")).alias("dir")).agg(F.count("*").alias("files"), F.count_if(artifact).alias("artifacts")).where(F.col("artifacts") >= share * F.col("files"))


def nested_roots(roots: DataFrame) -> DataFrame:
    """Distinct paths without folders below another one of the folders: (path, is_dir)."""
    distinct = roots.distinct()
    above = distinct.where("is_dir").select(F.col("path").alias("above"))
    up = F.filter(paths.ancestors(F.col("path")), lambda a: a != "")
    below = distinct.where("is_dir").select("path", F.explode(up).alias("above")).join(above, "above").select("path").distinct()
    return distinct.join(below, "path", "left_anti")
