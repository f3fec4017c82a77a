"""Reduction of noisy line streams: (stream, pos, text) tables and whole outputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx

#: How many blocks of a class stay.
CAPS = {"error": 20, "failure": 20, "warning": 10, "issue": 20, "list": 20, "timing": 20, "inventory": 50}
RUN_LINES, RUN_NAMES, MAX_FOLDED = 4, 8, 400
#: What tells a failing line, in any case or exactly as written.
ANY_CASE = ("error:", "internalerror", "traceback", "exception", "no module named", "undefined reference", "linker command failed", "undefined:", "expected declaration", "collect2: error", "ld: error", "fatal error", "panic", "cannot find", "not found", "no such")
AS_WRITTEN = ("error[", "Error", "ERROR", "FAILED", "FAIL")
KEPT_MARK = "[failure lines of the raw output]"


#: A word of failure, unless a count of 0 stands before it.
FAILURE_WORD = r"(?<![a-z0-9_])(?<!(?<![0-9])0{1,9}\s{0,9})(?:fail|failed|failure|failures)(?![a-z0-9_])"


def fails(line: Column) -> Column:
    """Does a line tell a failure: a sign of one, or a word of failure without a count of 0?"""
    low = F.lower(line)
    out = low.rlike(FAILURE_WORD)
    for x in ANY_CASE:
        out = out | low.contains(x)
    for x in AS_WRITTEN:
        out = out | line.contains(x)
    return out


def runs(lines: DataFrame, key: Column, *streams: str) -> DataFrame:
    """lines (streams, pos, ...) with __run, the number of the run of equal keys they are in."""
    own = Window.partitionBy(*streams).orderBy("pos")
    change = (~key.eqNullSafe(F.lag(key).over(own)) | (F.row_number().over(own) == 1)).cast("int")
    return lines.withColumn("__new", change).withColumn("__run", F.sum("__new").over(own)).drop("__new")


def dedup_runs(lines: DataFrame, *streams: str) -> DataFrame:
    """(streams, pos, text, n): a row for each run of equal lines; from four on the text says how many more."""
    r = runs(lines, F.col("text"), *streams).groupBy(*streams, "__run").agg(F.min("pos").alias("pos"), F.first("text").alias("text"), F.count("*").alias("n"))
    more = F.concat(F.col("text"), F.lit("\n... ("), (F.col("n") - 1).cast("string"), F.lit(" more)"))
    return r.select(*streams, "pos", F.when(F.col("n") >= RUN_LINES, more).otherwise(F.concat(F.call_function("repeat", F.concat("text", F.lit("\n")), (F.col("n") - 1).cast("int")), F.col("text"))).alias("text"), "n")


def class_cap(blocks: DataFrame, *streams: str, caps: dict[str, int] = CAPS) -> DataFrame:
    """blocks (streams, pos, cls, text) that stay: the first of each class up to its cap, all without a class."""
    cap = F.create_map(*[F.lit(x) for k, v in caps.items() for x in (k, v)])[F.col("cls")]
    nth = F.row_number().over(Window.partitionBy(*streams, "cls").orderBy("pos"))
    return blocks.withColumn("nth", nth).where(F.col("cls").isNull() | cap.isNull() | (F.col("nth") <= cap)).drop("nth")


def class_drops(blocks: DataFrame, *streams: str, caps: dict[str, int] = CAPS) -> DataFrame:
    """(streams, cls, dropped)."""
    cap = F.create_map(*[F.lit(x) for k, v in caps.items() for x in (k, v)])[F.col("cls")]
    return blocks.where("cls is not null").groupBy(*streams, "cls").agg(F.count("*").alias("n")).where(F.col("n") > cap).select(*streams, "cls", (F.col("n") - cap).cast("long").alias("dropped"))


def line_cap(lines: DataFrame, most: int, keep: str, *streams: str) -> DataFrame:
    """The first, the last or both ends of each stream (keep: head, tail, middle)."""
    w = Window.partitionBy(*streams)
    r = lines.withColumn("nth", F.row_number().over(w.orderBy("pos"))).withColumn("n", F.count("*").over(w))
    head = {"head": most, "tail": 0, "middle": most // 2}[keep]
    return r.where((F.col("n") <= most) | (F.col("nth") <= head) | (F.col("nth") > F.col("n") - (most - head))).drop("nth", "n")


def listing_fold(entries: DataFrame, *streams: str) -> DataFrame:
    """(streams, pos, line): entries (streams, pos, dir, name), of which eight or more in a row with one shape are a pattern."""
    masked = tx.mask_digits(F.col("name"))
    r = runs(entries.withColumn("shape", F.concat_ws("|", F.nullif(F.col("dir"), F.lit("")), masked)), F.col("shape"), *streams)
    shown = F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name"))
    g = r.withColumn("shown", shown).groupBy(*streams, "__run").agg(F.min("pos").alias("pos"), F.count("*").alias("n"), F.min_by("shown", "pos").alias("a"), F.max_by("shown", "pos").alias("z"), F.first("dir").alias("dir"), F.first(masked).alias("m"))
    pattern = F.translate("m", "#", "*")
    long_ = g.where(F.col("n") >= RUN_NAMES).select(*streams, "pos", F.concat(F.when(F.col("dir") == "", pattern).otherwise(F.concat_ws("/", "dir", pattern)), F.lit(" — "), F.col("n").cast("string"), F.lit(" files ("), "a", F.lit(" … "), "z", F.lit(")")).alias("line"))
    short = r.join(g.where(F.col("n") < RUN_NAMES).select(*streams, "__run"), [*streams, "__run"]).select(*streams, "pos", shown.alias("line"))
    return long_.unionByName(short)


@dataclass(frozen=True)
class Filter:
    """A declarative filter of one program's output."""

    program: str
    strip: Sequence[str] = ()
    done_when: str | None = None
    done_text: str = "ok"
    line_max: int | None = None
    max_lines: int | None = None
    keep: str = "tail"
    cls: str | None = None
    cls_pattern: str | None = None


#: Built-in filters: our own choice of what is noise in the output of common programs.
FILTERS = (
    Filter("make", strip=(r"^make\[\d+\]: (?:Entering|Leaving) directory", r"^\s*$"), done_when=r"(?m)^make: Nothing to be done", done_text="make: up to date", max_lines=80),
    Filter("df", max_lines=40, keep="head"),
    Filter("du", max_lines=40, keep="tail"),
    Filter("docker", strip=(r"^[0-9a-f]{12}: (?:Waiting|Pulling fs layer|Downloading|Verifying)",), max_lines=60),
    Filter("pip", strip=(r"^(?:Requirement already satisfied|Collecting|  Downloading|  Using cached)",), max_lines=40),
    Filter("terraform", strip=(r"Refreshing state\.\.\.|Reading\.\.\.$",), max_lines=120, keep="middle"),
    Filter("kubectl", max_lines=60, keep="head"),
    Filter("rsync", strip=(r"/$",), max_lines=40, keep="middle"),
    Filter("curl", strip=(r"^[* <>] ?[A-Za-z-]+: ",), max_lines=80),
    Filter("ansible-playbook", strip=(r"^(?:ok|skipping): \[", r"^\s*$"), max_lines=100),
    Filter("aws", max_lines=80, keep="head"),
    Filter("deno", strip=(r"^(?:Download|Check) ",), max_lines=80),
    Filter("gh", max_lines=60, keep="head"),
    Filter("gradle", strip=(r"^> Task \S+ (?:UP-TO-DATE|NO-SOURCE|SKIPPED|FROM-CACHE)$", r"^\s*$"), done_when=r"(?m)^BUILD SUCCESSFUL", done_text="gradle: build successful", max_lines=80),
    Filter("helm", max_lines=60, keep="head"),
    Filter("psql", max_lines=80, keep="head"),
    Filter("uv", strip=(r"^(?:Resolved|Prepared|Audited|Downloading|Building) ", r"^ [+~-] "), max_lines=40),
    Filter("wc", max_lines=40, keep="tail"),
    Filter("wget", strip=(r"^\s*\d+K [. ]+", r"^(?:Resolving|Connecting to|HTTP request sent)"), max_lines=40),
    Filter("xcodebuild", strip=(r"^(?:CompileC|CompileSwift|Ld|CpResource|ProcessInfoPlistFile|CodeSign|builtin-\S+)\b", r"^    (?:cd|export|/)", r"^\s*$"), max_lines=80),
    Filter("event", strip=(r"^view",), line_max=40, cls="list", cls_pattern=r"^click"),
)


def filtered(outputs: DataFrame, f: Filter) -> DataFrame:
    """(id, text): outputs (id, text, exit_code) after a filter: strip, short-circuit, cut lines, cap. Column expressions only."""
    kept = tx.lines(tx.strip_ansi(F.col("text")))
    if f.strip:
        noise = "|".join(f"(?:{p})" for p in f.strip)
        kept = F.filter(kept, lambda x: ~x.rlike(noise))
    body = outputs.withColumn("__l", kept).withColumn("__b", F.array_join("__l", "\n"))
    rows = F.col("__l")
    if f.line_max is not None:
        rows = F.transform(rows, lambda x: tx.truncate_line(x, f.line_max))
    if f.cls is not None:
        hit = (lambda x: x.rlike(f.cls_pattern)) if f.cls_pattern else (lambda x: F.lit(True))
        body = body.withColumn("__r", rows).withColumn("__n", place_of_hit(F.col("__r"), hit, CAPS[f.cls]))
        rest = F.filter(F.slice("__r", F.col("__n") + 1, F.size("__r")), lambda x: ~hit(x))
        text = join_blocks(F.concat(F.slice("__r", 1, F.col("__n")), rest))
    elif f.max_lines is not None:
        head = {"head": f.max_lines, "tail": 0, "middle": f.max_lines // 2}[f.keep]
        tail = f.max_lines - head
        ends = F.concat(F.slice(rows, 1, head) if head else F.array().cast("array<string>"), F.slice(rows, F.greatest(F.size(rows) - tail + 1, F.lit(1)), F.lit(tail)) if tail else F.array().cast("array<string>"))
        text = F.array_join(F.when(F.size(rows) <= f.max_lines, rows).otherwise(ends), "\n")
    else:
        text = F.array_join(rows, "\n")
    if f.done_when:
        safe = F.coalesce(F.col("exit_code") == 0, ~F.exists("__l", fails))
        text = F.when(safe & F.col("__b").rlike(f.done_when), f.done_text).otherwise(text)
    return body.withColumn("__t", text).select("id", F.col("__t").alias("text"))


def place_of_hit(rows: Column, hit: Callable[[Column], Column], nth: int) -> Column:
    """Where, from 1, the nth row that hits is; the number of rows, if fewer hit. One pass: an array that grows by a row at a time takes the square."""
    places = F.filter(F.transform(rows, lambda x, i: F.when(hit(x), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.get(places, F.lit(nth - 1)), F.size(rows))


def join_blocks(blocks: Column) -> Column:
    trimmed = F.transform(blocks, lambda b: F.rtrim(b))
    return F.array_join(F.filter(trimmed, lambda b: b != ""), "\n")


def missing_failures(raw: Column, reduced: Column) -> Column:
    """Distinct failing lines of the raw text, in order, that the reduced one lacks."""
    bare = lambda s: F.filter(F.transform(tx.lines(s), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_except(F.array_distinct(F.filter(bare(raw), fails)), bare(reduced))


def keep_failures(raw: Column, reduced: Column, exit_code: Column) -> Column:
    """The reduced text with the failing lines it lost, if the program failed."""
    lost = missing_failures(raw, reduced)
    return F.when((exit_code != 0) & (F.size(lost) > 0), F.concat(reduced, F.lit("\n" + KEPT_MARK + "\n"), F.array_join(lost, "\n"))).otherwise(reduced)


def dispatch(command: Column, filters: Sequence[Filter] = FILTERS) -> Column:
    """The filter for a command, 'generic' for pipelines and unknown programs."""
    bare = F.trim(F.regexp_replace(command, r"\s#.*$", ""))
    program = tx.program_name(bare)
    return F.when(bare.rlike(r"\|"), "generic").when(program.isin(*[f.program for f in filters]), program).otherwise("generic")


def compress(outputs: DataFrame, custom: dict[str, Callable[[DataFrame], DataFrame]] | None = None, filters: Sequence[Filter] = FILTERS) -> DataFrame:
    """(id, tool, text): outputs (id, command, text, exit_code) by their filter, custom ones (DataFrame → (id, text)) first; failing lines stay."""
    tool = dispatch(F.col("command"), filters)
    custom = custom or {}
    if custom:
        tool = F.when(tx.program_name(F.col("command")).isin(*custom), tx.program_name(F.col("command"))).otherwise(tool)
    rows, parts = outputs.withColumn("tool", tool), []
    for name, f in [*custom.items(), *((f.program, f) for f in filters if f.program not in custom), ("generic", None)]:
        own = rows.where(F.col("tool") == name)
        if f is None:
            lines = own.select("id", F.posexplode(tx.lines(tx.strip_ansi(F.col("text")))).alias("pos", "text"))
            g = dedup_runs(lines, "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"))
            out = g.select("id", F.array_join("x.text", "\n").alias("text"))
        else:
            out = filtered(own, f) if isinstance(f, Filter) else f(own)
        parts.append(out)
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    both = rows.join(merged.withColumnRenamed("text", "__r"), "id", "left")
    return both.select("id", "tool", keep_failures(F.col("text"), F.coalesce("__r", F.lit("")), F.col("exit_code")).alias("text"))
