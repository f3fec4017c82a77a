"""Outlines, chunks, embedding texts, symbols, fuzzy matching and edits."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx

EMBED_MAX, SIGNATURE_MAX, BODY_LINES, BODY_MAX, SUMMARY_EXPORTS = 1600, 400, 15, 300, 2
MAX_ANCHORS = 512


def headings(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, line, level, title, slug) of Markdown headings."""
    rows = docs.select(*keys, F.posexplode(tx.lines(F.col("text"))).alias("line", "t")).where(F.col("t").rlike("^#{1,6} +[^ ]"))
    title = F.trim(F.regexp_replace("t", "^#{1,6} +", ""))
    return rows.select(*keys, (F.col("line") + 1).cast("long").alias("line"), F.length(F.regexp_extract("t", "^#+", 0)).cast("long").alias("level"), title.alias("title"), tx.slugify(title).alias("slug"))


def outline(found: DataFrame, *keys: str) -> DataFrame:
    """headings with their parent: the last one before of a higher level (line 0 for none)."""
    before = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.col("level") > v, F.max(F.when(F.col("level") == v, F.col("line"))).over(before)) for v in range(1, 6)]
    return found.select(*keys, "line", "level", "title", F.coalesce(F.greatest(*above), F.lit(0)).cast("long").alias("parent"))


def outline_files(files: DataFrame) -> DataFrame:
    """(path, lang, size, breaks): a line for each file (path, lang, size, text)."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return files.select("path", "lang", "size", breaks.cast("long").alias("breaks"))


def symbols(files: DataFrame) -> DataFrame:
    """(path, name, scoped, kind, start_line, end_line, signature, exported) of Python files; others have none."""

    def found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
        for p in parts:
            rows = []
            for path, source in zip(p["path"], p["text"], strict=True):
                try:
                    todo = [(ast.parse(source or ""), [])]
                except (SyntaxError, ValueError):
                    continue
                while todo:
                    node, scope = todo.pop()
                    for c in ast.iter_child_nodes(node):
                        if isinstance(c, kinds):
                            kind = "class" if isinstance(c, ast.ClassDef) else "method" if scope and isinstance(node, ast.ClassDef) else "function"
                            signature = c.name if kind == "class" else f"{c.name}({ast.unparse(c.args)})"
                            rows.append((path, c.name, "::".join([*scope, c.name]), kind, c.lineno, c.end_lineno, signature, not c.name.startswith("_")))
                            todo.append((c, [*scope, c.name]))
            yield pd.DataFrame(rows, columns=["path", "name", "scoped", "kind", "start_line", "end_line", "signature", "exported"])

    return files.select("path", "text").mapInPandas(found, "path string, name string, scoped string, kind string, start_line long, end_line long, signature string, exported boolean")


def chunks(files: DataFrame, found: DataFrame) -> DataFrame:
    """(path, name, kind, start_line, end_line, body): a chunk for each symbol of two lines or more, and a summary of files with few exports."""
    lines = tx.lines(F.col("text"))
    own = found.where((F.col("end_line") > F.col("start_line")) | (F.col("kind") == "variable")).where("kind <> 'heading'").join(files.select("path", "text"), "path")
    body = F.array_join(F.slice(lines, F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    out = own.select("path", "name", "kind", "signature", "start_line", "end_line", body.alias("body"))
    few = files.join(found.where("exported").groupBy("path").agg(F.count("*").alias("n")), "path", "left").where(F.coalesce("n", F.lit(0)) <= SUMMARY_EXPORTS)
    return out.unionByName(few.select("path", F.substring_index("path", "/", -1).alias("name"), F.lit("file_summary").alias("kind"), F.lit(None).cast("string").alias("signature"), F.lit(1).cast("long").alias("start_line"), F.size(lines).cast("long").alias("end_line"), F.substring("text", 1, BODY_MAX).alias("body")))


def embed_text(path: Column, name: Column, kind: Column, signature: Column, body: Column) -> Column:
    head = F.substring(F.array_join(F.slice(tx.lines(body), 1, BODY_LINES), "\n"), 1, BODY_MAX)
    return F.substring(F.concat_ws("\n", F.concat(F.lit("name: "), name), F.concat(F.lit("file: "), path), F.concat(F.lit("kind: "), kind), F.concat(F.lit("signature: "), F.substring(signature, 1, SIGNATURE_MAX)), head), 1, EMBED_MAX)


def zoom(files: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(path, scoped, line, text): the lines of symbols of a name (the scoped name or its last part)."""
    own = found.where((F.col("scoped") == name) | (F.element_at(F.split("scoped", "::"), -1) == name)).select("path", "scoped", "start_line", "end_line")
    rows = files.join(own.select("path").distinct(), "path", "left_semi").select("path", F.posexplode(tx.lines(F.col("text"))).alias("line", "t")).withColumn("line", (F.col("line") + 1).cast("long"))
    return rows.join(own, "path").where(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("path", "scoped", "line", F.col("t").alias("text"))


#: Passes of line comparison, strictest first.
PASSES = (lambda s: s, lambda s: F.rtrim(s), lambda s: F.trim(s), lambda s: F.trim(tx.normalize_unicode(s)), lambda s: tx.reflow(tx.normalize_unicode(s)))


def find_lines(lines: DataFrame, needle: Sequence[str], passes: Sequence = PASSES) -> DataFrame:
    """(file, line, pass): where the lines of needle stand in lines (file, line, line_text), by the first pass with any hit in the file."""
    best = None
    spark = lines.sparkSession
    for n, norm in enumerate(passes):
        want = spark.createDataFrame([(i, x) for i, x in enumerate(needle)], "i long, w string").select("i", norm(F.col("w")).alias("w"))
        hits = lines.select("file", "line", norm(F.col("line_text")).alias("w")).join(F.broadcast(want), "w").groupBy("file", (F.col("line") - F.col("i")).alias("start")).agg(F.count("*").alias("n")).where(F.col("n") == len(needle))
        own = hits.select("file", F.col("start").alias("line"), F.lit(n).alias("pass"))
        best = own if best is None else best.unionByName(own.join(best.select("file").distinct(), "file", "left_anti"))
    return best


def nearest_miss(lines: DataFrame, needle: Sequence[str], anchors: int = 3) -> DataFrame:
    """(file, line, matching, diverges): the place with most equal lines, then the latest first difference, then the earliest start, from anchors on the first non-blank lines."""
    spark = lines.sparkSession
    want = spark.createDataFrame([(i, x.strip()) for i, x in enumerate(needle)], "i long, w string")
    first = [i for i, x in enumerate(needle) if x.strip()][:anchors]
    rows = lines.select("file", "line", F.trim("line_text").alias("w"))
    starts = rows.join(F.broadcast(want.where(F.col("i").isin(first))), "w").select("file", (F.col("line") - F.col("i")).alias("start")).distinct()
    at = starts.select("file", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(needle) - 1).cast("long"))).alias("i")).withColumn("line", F.col("start") + F.col("i"))
    same = at.join(rows, ["file", "line"], "left").join(F.broadcast(want.withColumnRenamed("w", "e")), "i").withColumn("eq", F.coalesce(F.col("w") == F.col("e"), F.lit(False)))
    scored = same.groupBy("file", "start").agg(F.count_if("eq").alias("matching"), F.coalesce(F.min(F.when(~F.col("eq"), F.col("i"))), F.lit(len(needle))).alias("diverges"))
    return scored.groupBy("file").agg(F.max_by(F.struct("start", "matching", "diverges"), F.struct("matching", "diverges", -F.col("start"))).alias("s")).select("file", F.col("s.start").alias("line"), "s.matching", "s.diverges")


def diff_counts(before: Column, after: Column) -> Column:
    """struct<added, removed> lines."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            ops = difflib.SequenceMatcher(None, (x or "").split("\n"), (y or "").split("\n"), autojunk=False).get_opcodes()
            out.append((sum(j2 - j1 for o, _, _, j1, j2 in ops if o != "equal"), sum(i2 - i1 for o, i1, i2, _, _ in ops if o != "equal")))
        return pd.DataFrame(out, columns=["added", "removed"])

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "added long, removed long")(before, after)


def _pattern(text: str) -> ast.AST:
    tree = ast.parse(text.replace("$$$", "__rest_").replace("$", "__one_"))
    node = tree.body[0]
    return node.value if isinstance(node, ast.Expr) else node


def _matches(p, n, bound: dict) -> bool:
    if isinstance(p, ast.Name) and p.id.startswith("__one_"):
        code = ast.unparse(n) if isinstance(n, ast.AST) else str(n)
        return bound.setdefault(p.id[6:], code) == code
    if isinstance(p, list):
        if p and isinstance(p[-1], ast.Name) and p[-1].id.startswith("__rest_"):
            head = p[:-1]
            if not isinstance(n, list) or len(n) < len(head):
                return False
            bound[p[-1].id[7:]] = ", ".join(map(ast.unparse, n[len(head) :]))
            return all(_matches(a, b, bound) for a, b in zip(head, n, strict=False))
        return isinstance(n, list) and len(p) == len(n) and all(_matches(a, b, bound) for a, b in zip(p, n, strict=True))
    if isinstance(p, ast.AST):
        return type(p) is type(n) and all(_matches(getattr(p, f, None), getattr(n, f, None), bound) for f in p._fields if f not in ("ctx", "type_comment", "kind"))
    return p == n


def ast_search(files: DataFrame, pattern: str) -> DataFrame:
    """(path, line, code, captures) of Python code like the pattern, with $X for one expression and $$$X for the rest of a list."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _pattern(pattern)
        for part in parts:
            rows = []
            for path, source in zip(part["path"], part["text"], strict=True):
                try:
                    tree = ast.parse(source or "")
                except (SyntaxError, ValueError):
                    continue
                for n in ast.walk(tree):
                    bound: dict = {}
                    if type(n) is type(p) and _matches(p, n, bound):
                        rows.append((path, n.lineno, ast.unparse(n), bound))
            yield pd.DataFrame(rows, columns=["path", "line", "code", "captures"])

    return files.select("path", "text").mapInPandas(run, "path string, line long, code string, captures map<string,string>")


def ast_replace(files: DataFrame, pattern: str, rewrite: str) -> DataFrame:
    """(path, text, n): files with matches of an expression pattern rewritten; other files as they are, formatting of changed ones is not kept."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = _pattern(pattern)

        class Change(ast.NodeTransformer):
            n = 0

            def generic_visit(self, node):
                node = super().generic_visit(node)
                bound: dict = {}
                if type(node) is type(p) and _matches(p, node, bound):
                    self.n += 1
                    out = rewrite
                    for k, v in sorted(bound.items(), key=lambda x: -len(x[0])):
                        out = out.replace("$$$" + k, v).replace("$" + k, v)
                    return ast.parse(out, mode="eval").body
                return node

            visit = generic_visit

        for part in parts:
            rows = []
            for path, source in zip(part["path"], part["text"], strict=True):
                try:
                    change = Change()
                    tree = change.visit(ast.parse(source or ""))
                    rows.append((path, ast.unparse(ast.fix_missing_locations(tree)) if change.n else source, change.n))
                except (SyntaxError, ValueError):
                    rows.append((path, source, 0))
            yield pd.DataFrame(rows, columns=["path", "text", "n"])

    return files.select("path", "text").mapInPandas(run, "path string, text string, n long")


def replace_exact(text: Column, old: str, new: str) -> Column:
    """A text edit that is made only if the old text occurs exactly once."""
    once = (F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) == len(old)
    return F.when(once, F.replace(text, F.lit(old), F.lit(new))).otherwise(text)


def organize_imports(imports: DataFrame) -> DataFrame:
    """imports (path, module, name, internal) once each, in order: standard library, external, internal."""
    import sys

    root = F.substring_index("module", ".", 1)
    group = F.when(F.col("internal"), 2).when(root.isin(*sorted(sys.stdlib_module_names)), 0).otherwise(1)
    return imports.dropDuplicates(["path", "module", "name"]).withColumn("grp", group).orderBy("path", "grp", "module", "name")


def apply_patch(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """(path, text, applied): files (path, text) after the hunks (path, nth, old, new) of their path, in order.

    Whole lines are sought from the end of the hunk before on. If one is not found nothing of
    the file changes (applied is false); a file without hunks is as it was (null). A null text
    counts as empty where there are hunks."""
    rows = hunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("nth", "old", "new"))).alias("h"))
    both = files.join(rows, "path", "left")
    start = F.struct(F.lit("").alias("done"), F.concat(F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("rest"), F.lit(True).alias("ok"))

    def step(state: Column, h: Column) -> Column:
        at = F.instr(state["rest"], F.concat(F.lit("\n"), h["old"], F.lit("\n")))
        found = state["ok"] & (at > 0)
        done = F.concat(state["done"], F.substring(state["rest"], F.lit(1), at), h["new"])
        rest = F.substring(state["rest"], at + 1 + F.length(h["old"]), F.length(state["rest"]))
        return F.struct(F.when(found, done).otherwise(state["done"]).alias("done"), F.when(found, rest).otherwise(state["rest"]).alias("rest"), found.alias("ok"))

    end = both.withColumn("__s", F.when(F.col("h").isNotNull(), F.aggregate("h", start, step)))
    whole = F.concat("__s.done", "__s.rest")
    return end.select("path", F.when(F.col("__s.ok"), F.substring(whole, F.lit(2), F.length(whole) - 2)).otherwise(F.col("text")).alias("text"), F.col("__s.ok").alias("applied"))
