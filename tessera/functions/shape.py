"""What kind of query a text is, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open a question, and patterns of code-like tokens, error codes, paths and expressions.
QUESTION_WORDS = ("how", "what", "where", "why", "when", "which", "who", "does")
CAMEL_CASE = r"[a-z][A-Z]"
SNAKE_CASE = r"[a-z]_[a-z]"
PASCAL_CASE = r"^[A-Z][a-z]+[A-Z]"
ACRONYM_PASCAL = r"\b[A-Z]{2,}[A-Z][a-z]"
DOTTED = r"[a-zA-Z]\.[a-zA-Z]"
HEX_CODE = r"0x[A-Fa-f0-9]+"
ERROR_PREFIX = r"\bERR_\w+"
NUMERIC_ERROR = r"\bE\d{4,}"
TYPESCRIPT_ERROR = r"\bTS\d{4,}\b"
HTTP_STATUS = r"\b[1-5]\d{2}\b"
URL = r"^(?:http|https|file|ftp|ssh)://[^\s*|()\[\]{}^$\\]+$"
WINDOWS_ABSOLUTE = r"^[A-Za-z]:[\\/][A-Za-z0-9_.\-+?\\/' ]+$"
WINDOWS_RELATIVE = r"^[A-Za-z0-9_.\-+?' ]+(\\[A-Za-z0-9_.\-+?' ]+)+$"
POSIX_ABSOLUTE = r"^/[A-Za-z0-9_.\-+?/' ]+$"
POSIX_RELATIVE = r"^[A-Za-z0-9_.\-+?' ]+(/[A-Za-z0-9_.\-+?' ]+)+$"
UNC = r"^\\\\[A-Za-z0-9_.\-+?\\']+$"
FILE_NAME = r"^[A-Za-z_][A-Za-z0-9_.\-+'? ]*\.[A-Za-z0-9]{1,8}$"
FILE = r"[/\\].*\.\w{1,5}$"
CODE = (CAMEL_CASE, SNAKE_CASE, PASCAL_CASE, ACRONYM_PASCAL, DOTTED)
ERROR_CODE = (HEX_CODE, ERROR_PREFIX, NUMERIC_ERROR, TYPESCRIPT_ERROR)
PATHS = (WINDOWS_ABSOLUTE, WINDOWS_RELATIVE, POSIX_ABSOLUTE, POSIX_RELATIVE, UNC, FILE_NAME)
#: What makes a path-like text an expression: quantified dots, and escapes that no path has.
NO_PATH = (r"\.[+*?]", r"\\x", r"\\[bBwWdDsS](?:$|[*+?{(\[|^$\\/])", r"\\[.*+?()\[\]{}^$|]")
#: Signs of an expression: groups, classes, escapes, quantifiers, anchors beside a word, back-references.
REGEX = (r"\(\?", r"\\[bBwWdDsSnrtx]", r"\\p\{|\\u\{", r"\\[1-9]", r"\.\*|\.\+", r"\[[^\]]*[A-Za-z0-9]-[A-Za-z0-9][^\]]*\]", r"\S\{\d+(?:,\d*)?\}", r"^\^[A-Za-z0-9_]{3}", r"[A-Za-z0-9_]{3}\$$", r"[a-z)\]]\|", r"\)[*+?]")
TITLE_RUN = r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b"
IDENTIFIER = r"\b[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*\b"
#: Weights of the semantic and the lexical lane, and whether the lexical lane is used.
WEIGHTS = {"identifier": (0.2, 0.8, True), "path": (0.1, 0.9, True), "error_code": (0.1, 0.9, True), "regex": (0.0, 1.0, False), "natural_language": (0.6, 0.4, False), "mixed": (0.4, 0.6, True)}
#: What a purely lexical hit is worth by kind of query.
LEXICAL_ONLY = {"identifier": 0.8, "path": 0.5, "error_code": 0.5, "mixed": 0.5, "natural_language": 0.0, "regex": 0.0}


def _any(column: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(or_, (column.rlike(p) for p in patterns))


def kind(query: Column) -> Column:
    q = F.trim(query)
    words = F.size(F.split(q, r"\s+"))
    first = F.lower(F.regexp_extract(q, r"^\S+", 0))
    prose = first.isin(*QUESTION_WORDS) | (words > 2) | q.rlike(r"^[a-z]{3,}\s+[a-z]{3,}$")
    status = q.rlike(HTTP_STATUS) & ((words <= 3) | F.lower(q).contains("http"))
    error, code = _any(q, ERROR_CODE) | status, _any(q, CODE)
    return (
        F.when(q == "", "natural_language")
        .when(q.rlike(URL) | (_any(q, PATHS) & ~_any(q, NO_PATH)), "path")
        .when(_any(q, REGEX), "regex")
        .when(q.rlike(FILE), "path")
        .when(error & prose, "mixed")
        .when(error, "error_code")
        .when(code & prose, "mixed")
        .when(code | ((words <= 2) & ~prose), "identifier")
        .otherwise("natural_language")
    )


def weights(kind_of: Column) -> Column:
    out = None
    for k, (semantic, lexical, used) in WEIGHTS.items():
        row = F.struct(F.lit(semantic).alias("semantic"), F.lit(lexical).alias("lexical"), F.lit(used).alias("use_lexical"))
        out = F.when(kind_of == k, row) if out is None else out.when(kind_of == k, row)
    return out


def lexical_only_weight(kind_of: Column) -> Column:
    return F.create_map(*[F.lit(x) for k, w in LEXICAL_ONLY.items() for x in (k, w)])[kind_of]


def identifier_tokens(query: Column, code_only: Column | bool = False) -> Column:
    found = F.array_distinct(F.regexp_extract_all(query, F.lit(f"({IDENTIFIER})"), F.lit(1)))
    only = F.lit(code_only) if isinstance(code_only, bool) else code_only
    return F.filter(found, lambda t: ~only | _any(t, CODE) | _any(t, ERROR_CODE))


def explicit_code_tokens(query: Column) -> Column:
    """Quoted text, neighbouring title-case words as one dotted name, and code-shaped tokens of prose."""
    quoted = F.regexp_extract_all(query, F.lit("[`'\"]([^`'\"]+)[`'\"]"), F.lit(1))
    titles = F.transform(F.regexp_extract_all(query, F.lit(f"({TITLE_RUN})"), F.lit(1)), lambda t: F.replace(t, F.lit(" "), F.lit(".")))
    rest = F.regexp_replace(query, TITLE_RUN, " ")
    return F.array_distinct(F.concat(quoted, titles, identifier_tokens(rest, True)))


def lexical_tokens(query: Column, kind_of: Column) -> Column:
    """What the lexical lane looks for if the first lane has nothing: explicit tokens, else words of three letters or more of a phrase."""
    explicit = explicit_code_tokens(query)
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: F.length(w) >= 3)
    return F.when(~kind_of.isin("natural_language", "regex"), identifier_tokens(query, kind_of == "mixed")).when(F.size(explicit) > 0, explicit).when(kind_of == "natural_language", words).otherwise(identifier_tokens(query))


def mode(kind_of: Column, lexical_ready: bool = True) -> Column:
    """regex, literal, hybrid or semantic."""
    return F.when(kind_of == "regex", "regex").when(kind_of == "error_code", "literal").when(F.lit(lexical_ready), "hybrid").otherwise("semantic")
