"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quotes, dashes and spaces that count as their ASCII forms.
QUOTES = "‘’‚‛“”„‟"
DASHES = "‐‑‒–—―"
QUOTES_TO = "''''\"\"\"\""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(s: Column) -> Column:
    """Lower case of A-Z only; text that is all ASCII takes the faster lower()."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def lines(s: Column) -> Column:
    """Lines without a last empty one."""
    return F.split(F.regexp_replace(s, r"\n\z", ""), "\n", -1)


def pack_trigram(t: Column) -> Column:
    """Three ASCII characters as one number."""
    byte = lambda i: F.ascii(F.substring(t, i, 1))
    return F.shiftleft(byte(1), 16) + F.shiftleft(byte(2), 8) + byte(3)


def next_mask(c: Column) -> Column:
    """One of eight bits for the character after a trigram."""
    return F.call_function("shiftleft", F.lit(1), (F.ascii(fold_ascii(c)) * 31).bitwiseAND(7))


def strip_ansi(s: Column) -> Column:
    return F.regexp_replace(s, "\x1b(\\[[^@-~]*[@-~]?|[@-Z\\\\-_])", "")


def mask_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[0-9]+", "#")


def truncate_line(s: Column, most: int) -> Column:
    side = max(0, most - 3) // 2
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, side), F.lit("…"), F.right(s, F.lit(side)) if side else F.lit("")))


def middle_truncate(s: Column, threshold: int, head: int, tail: int) -> Column:
    """Head, a marker with the number of characters left out, tail."""
    first = F.substring(s, 1, head)
    gone = F.length(s) - head - tail
    return F.when((F.length(s) <= threshold) | (gone <= 0), s).otherwise(F.concat(first, F.when(first.endswith("\n"), "").otherwise("\n"), F.lit("...<truncated "), gone.cast("string"), F.lit(" bytes>...\n"), F.right(s, F.lit(tail))))


def head_tail(s: Column, most: int, head: int, tail: int, marker: str = "\n[...]\n") -> Column:
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, head), F.lit(marker), F.right(s, F.lit(tail))))


def normalize_unicode(s: Column) -> Column:
    plain = F.translate(s, QUOTES + DASHES + " ", QUOTES_TO + "-" * len(DASHES) + " ")
    return F.replace(plain, F.lit("…"), F.lit("..."))


def normalize_indent(s: Column) -> Column:
    """Each leading tab or space becomes one space."""
    indent = F.length(F.regexp_extract(s, r"^[ \t]*", 0))
    return F.concat(F.call_function("repeat", F.lit(" "), indent), F.substring(s, indent + 1, F.length(s)))


def reflow(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[ \t\n\r\f]+", " "))


def slugify(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def split_camel(s: Column) -> Column:
    """Words at separators and at case and digit boundaries, lower-cased; words of one character go."""
    parted = F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2")
    parted = F.regexp_replace(parted, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parted = F.regexp_replace(parted, "([A-Za-z])([0-9])", "$1 $2")
    parted = F.regexp_replace(parted, "([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.transform(F.split(parted, "[^A-Za-z0-9]+"), lambda x: F.lower(x)), lambda x: F.length(x) > 1)


def looks_json(s: Column) -> Column:
    return F.ltrim(s).rlike(r"^[{\[]") & F.try_parse_json(s).isNotNull()


def context_snippet(s: Column, start: Column, end: Column, before: int = 100, after: int = 500) -> Column:
    """The text around characters start to end (from 0)."""
    lo = F.greatest(start - before, F.lit(0))
    return F.substring(s, (lo + 1).cast("int"), (end + after - lo).cast("int"))


def count_pretokens(s: Column) -> Column:
    """Pieces of the usual byte-pair pre-split: words, numbers, other signs, white space."""
    return F.regexp_count(s, F.lit(r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+")).cast("long")


def specifier_local_name(spec: Column) -> Column:
    """The name that an import specifier binds: what follows 'as', else the name itself."""
    alias = F.regexp_extract(spec, r"\s+as\s+([A-Za-z_$][\w$]*)\s*$", 1)
    return F.when(alias != "", alias).otherwise(F.trim(F.regexp_replace(spec, r"^\s*type\s+", "")))


def program_name(command: Column) -> Column:
    """The first word that assigns no variable, without its folders."""
    bare = F.regexp_replace(F.trim(command), r"^(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s+)+", "")
    return F.regexp_extract(bare, r"^(?:\S*/)?([^/\s]+)", 1)


def line_of_offset(s: Column, offset: Column) -> Column:
    """Line, from 1, of a character offset, from 0."""
    head = F.substring(s, F.lit(1), offset.cast("int"))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("long")


def column_of_offset(s: Column, offset: Column) -> Column:
    """Column, from 1 and in characters, of a character offset, from 0."""
    return (F.length(F.substring_index(F.substring(s, F.lit(1), offset.cast("int")), "\n", -1)) + 1).cast("long")
