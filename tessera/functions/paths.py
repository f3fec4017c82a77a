"""Path predicates and classifiers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and suffixes that mark tests, support files and generated files.
TEST_FOLDERS = ("__tests__", "__test__", "tests")
TEST_SUFFIXES = ("_test.rs", "_test.go", "_test.py", "_test.rb", "_test.exs", "_spec.rb")
TEST_CLASSES = ("Test.java", "Tests.java", "Test.kt", "Tests.kt", "Test.cs", "Tests.cs", "Test.swift", "Tests.swift", "Test.scala", "Spec.scala")
SUPPORT_FOLDERS = ("fixtures", "__fixtures__", "testdata", "test-data", "__mocks__", "__snapshots__", "corpora")
GENERATED_FOLDERS = ("gen", "generated", "__generated__")
GENERATED_SUFFIXES = ("_pb.ts", "_pb.js", "_pb.d.ts")
GENERATED_MARKERS = ("@generated", "code generated by", "do not edit")
ARTIFACT_SUFFIXES = (".min.js", ".min.css", ".map", ".html")

#: File name extensions of each language.
LANGUAGES = {
    "typescript": "ts mts cts", "tsx": "tsx", "javascript": "js jsx mjs cjs", "python": "py pyi", "rust": "rs", "go": "go", "c": "c h", "cpp": "cc cpp cxx hpp hh",
    "zig": "zig", "csharp": "cs", "bash": "sh bash zsh", "html": "html htm", "markdown": "md markdown mdx qmd Qmd rmd Rmd", "solidity": "sol", "scss": "scss", "vue": "vue",
    "json": "json jsonc", "scala": "scala sc", "java": "java", "ruby": "rb", "kotlin": "kt kts", "swift": "swift", "php": "inc php", "lua": "lua", "perl": "pl pm t",
    "yaml": "yaml yml", "pascal": "pas pp dpr dpk lpr", "r": "R r", "groovy": "groovy gvy gy gsh gradle", "objc": "m mm",
}


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest last."""
    parts = F.split(directory(path), "/")
    return F.when(directory(path) == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def _any_folder(path: Column, names: tuple[str, ...], last: bool = True) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def is_test_support(path: Column) -> Column:
    return _any_folder(path, SUPPORT_FOLDERS)


def is_test(path: Column) -> Column:
    name = file_name(path)
    low = F.lower(name)
    ends = lambda c, suffixes: c.rlike("(" + "|".join(map(re.escape, suffixes)) + ")$")
    return _any_folder(path, TEST_FOLDERS) | low.contains(".test.") | low.contains(".spec.") | ends(low, TEST_SUFFIXES) | (low.startswith("test_") & low.endswith(".py")) | ends(name, TEST_CLASSES)


def is_generated(path: Column, text: Column | None = None) -> Column:
    low = F.lower(path)
    out = _any_folder(low, GENERATED_FOLDERS) | file_name(low).rlike("(" + "|".join(map(re.escape, GENERATED_SUFFIXES)) + ")$") | file_name(low).contains(".generated.")
    if text is not None:
        head = F.lower(F.substring_index(text, "\n", 5))
        for marker in GENERATED_MARKERS:
            out = out | head.contains(marker)
        out = out | (head.contains("eslint-disable") & head.rlike("codegen|generated"))
    return out


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for lang, exts in LANGUAGES.items() for e in exts.split() for x in (e, lang)])
    name = file_name(path)
    ext = F.regexp_extract(name, r".\.([^.]+)$", 1)
    return F.when(name == "Jenkinsfile", "groovy").otherwise(F.try_element_at(table, ext))


def within(path: Column, root: str) -> Column:
    """Is a path the root or below it? Pushed down as a prefix."""
    root = root.rstrip("/")
    return F.lit(True) if root in ("", ".") else (path == root) | path.startswith(root + "/")


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: * and ? stay in a folder, ** crosses, {a,b} and [..] choose."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 2) if "]" in pattern[i + 2 :] else i + 1
            out += "[" + pattern[i + 1 : end].replace("!", "^", 1 if pattern[i + 1] == "!" else 0) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def path_filter(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Included by any glob (all, without one) and excluded by none; a glob without a slash looks at names."""
    one = lambda g: (path if "/" in g else file_name(path)).rlike(glob_regex(g))
    out = F.lit(True)
    if include:
        out = one(include[0])
        for g in include[1:]:
            out = out | one(g)
    for g in exclude:
        out = out & ~one(g)
    return out


def proximity(left: Column, right: Column) -> Column:
    """0.05 for each leading folder that two paths share, 0.5 at most."""
    a, b = F.split(directory(left), "/"), F.split(directory(right), "/")
    same = F.zip_with(a, b, lambda x, y: (x == y) & x.isNotNull() & (x != ""))
    first = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False)).cast("int")), 0)
    shared = F.when(first == 0, F.size(same)).otherwise(first - 1)
    return F.least(shared * 0.05, F.lit(0.5))


def is_entry_point(name: Column, kind: Column, exported: Column, lang: Column) -> Column:
    low = F.lower(name)
    script = lang.isin("typescript", "javascript", "tsx") & (low.isin("describe", "it", "test") | low.startswith("test") | low.startswith("spec"))
    return (
        (exported & (kind == "function"))
        | (exported & (kind == "method") & lang.isin("go", "rust"))
        | low.isin("main", "init", "setup", "bootstrap", "run")
        | script
        | ((lang == "python") & (low.startswith("test_") | name.isin("setUp", "tearDown")))
        | ((lang == "rust") & low.startswith("test_"))
        | ((lang == "go") & name.startswith("Test"))
    )
