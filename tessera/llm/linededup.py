"""Line dedup by pairwise alignment.

1. Lines that two documents share are found by hash. A rare line (in at most rare_holders
   documents) nominates every earlier holder for every later one; a line that more
   documents have nominates its first holder for each of the others, so a line in a third
   of all documents gives one pair per document. Runs of consecutive lines nominate in the
   same way: from and to each line the shortest run that reaches min_block_bytes, however
   short its lines.
2. Each pair is aligned by patience diff over line hashes: lines unique in both texts, the
   longest increasing chain of them, growth over equal neighbours, again between anchors;
   a range without such a line by longest common blocks. Then blocks that stand in another
   order in the two texts, which no alignment has together, are looked up by their runs.
3. Aligned blocks of at least min_block_bytes are deleted from the later document.

So a line goes exactly if it lies in a run of lines of at least min_block_bytes that a
document with a smaller doc_id has as well: every line of such a run lies in a shortest
run inside it, whose first holder is nominated. Empty lines are no part of a run (lines
before and after them are neighbours); those between two deleted lines go with them.

Only hashes and lengths of lines travel for steps 1 and 2; texts are joined once, with the
spans to delete. A line or a document with many pairs is dealt to many tasks.

Defined cases: null text has no lines, empty text one; a null doc_id takes no part and is
kept whole; equal rows are treated alike; texts with one doc_id are not compared with each
other, but each with those of other ids; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _frame, _text

LINE = np.ones(256, bool)
LINE[0x0A] = False
SPANS = "array<struct<start: long, end: long>>"


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of (a, b), given by rising a, whose b rises too."""
    tails: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        back[i] = last[at - 1] if at else -1
        tails[at : at + 1] = [b]
        last[at : at + 1] = [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _plain(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned runs without anchors, in linear memory: common ends, then the longest common block and again beside it."""
    n, lo, hi = min(len(a), len(b)), 0, 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    inner = SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if not set(x).isdisjoint(y) else []
    runs = [(0, 0, lo), *((lo + i, lo + j, k) for i, j, k in inner), (len(a) - hi, len(b) - hi, hi)]
    return [r for r in runs if r[2]]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned runs (start in a, start in b, length) of two sequences of hashes."""
    runs: list[tuple[int, int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if count_b[x] == 1}
        chain = _chain([(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if count_a[x] == 1 and x in where])
        if not chain:
            if not count_a.keys().isdisjoint(count_b):
                runs += [(a0 + i, b0 + j, n) for i, j, n in _plain(a[a0:a1], b[b0:b1])]
            continue
        at, found = (a0, b0), []
        for n, (i, j) in enumerate(chain):
            if i < at[0] or j < at[1]:
                continue  # inside the run before
            stop = chain[n + 1] if n + 1 < len(chain) else (a1, b1)
            s = 0
            while i - s > at[0] and j - s > at[1] and a[i - s - 1] == b[j - s - 1]:
                s += 1
            e = 1
            while i + e < a1 and j + e < b1 and a[i + e] == b[j + e] and (i + e < stop[0] or (i + e, j + e) == stop or stop[0] - i == stop[1] - j):
                e += 1
            found.append((i - s, j - s, s + e))
            at = (i + e, j + e)
        at = (a0, b0)
        for i, j, n in found:
            todo.append((at[0], i, at[1], j))
            at = (i + n, j + n)
        todo.append((at[0], a1, at[1], b1))
        runs += found
    runs.sort(key=lambda r: r[1])
    joined: list[tuple[int, int, int]] = []
    for i, j, n in runs:
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            joined[-1] = (joined[-1][0], joined[-1][1], joined[-1][2] + n)
        else:
            joined.append((i, j, n))
    return joined


def _runs(w: _text.Words, min_line_bytes: int, min_block_bytes: int) -> pa.ListArray:
    """For each document the hashes of the shortest runs of lines, from and to each line, of min_block_bytes (lines that nominate by themselves left out)."""
    total = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    own, n = np.repeat(np.arange(len(w.counts)), w.counts), np.arange(len(w))
    to = np.searchsorted(total, total[:-1] + min_block_bytes)
    begin = np.searchsorted(total, total[1:] - min_block_bytes, "right") - 1
    fits, back = to <= w.first[1:][own], begin >= w.first[:-1][own]
    lo, hi = np.concatenate([n[fits], begin[back]]), np.concatenate([to[fits], n[back] + 1])
    some = (hi - lo > 1) | (total[hi] - total[lo] < min_line_bytes)
    lo, hi = lo[some], hi[some]
    order = np.argsort(own[lo], kind="stable")
    lo, hi = lo[order], hi[order]
    at = np.searchsorted(own[lo], np.arange(len(w.counts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(_text._ranged(w.hashes(), lo, hi).view(np.int64)))


def _lines(min_line_bytes: int, min_block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in _text.read(b.column("text"), LINE):
                first = pa.array(w.first.astype(np.int32))
                breaks = np.concatenate([[0], np.cumsum(w.data == 0x0A)])
                number = breaks[w.starts] - np.repeat(breaks[w.offs[:-1]], w.counts)
                runs = _runs(w, min_line_bytes, min_block_bytes)
                lists = [pa.ListArray.from_arrays(first, pa.array(x)) for x in (w.hashes().view(np.int64), (w.ends - w.starts).astype(np.int32), number.astype(np.int32))]
                yield pa.record_batch({"doc_id": b.column("doc_id").slice(lo, hi - lo), "th": b.column("th").slice(lo, hi - lo), "hashes": lists[0], "sizes": lists[1], "numbers": lists[2], "runs": runs})

    return run


def _shortest(sizes: list[int | None], least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the shortest run from each element whose sizes reach least; None is in no run."""
    end = total = 0
    for start, own in enumerate(sizes):
        if own is None or end < start:
            end, total = start + (own is None), 0
        if own is None:
            continue
        while total < least and end < len(sizes) and sizes[end] is not None:
            total += sizes[end]
            end += 1
        if total >= least:
            yield start, end
        total -= own


def _moved(x: list[int], y: list[int], sizes: list[int], gone: list[bool], least: int) -> list[tuple[int, int]]:
    """Runs (start, end) of y, of at least that size and not wholly gone, that x has too."""
    size, there = dict(zip(y, sizes, strict=True)), set(x)

    def runs(seq: list[int], parts: list[int | None]) -> set[tuple[int, int]]:
        back = {(len(seq) - j, len(seq) - i) for i, j in _shortest(parts[::-1], least)}
        return back | set(_shortest(parts, least))

    mine = [r for r in runs(y, [n if h in there else None for h, n in zip(y, sizes, strict=True)]) if not all(gone[r[0] : r[1]])]
    if not mine:
        return []
    have = {tuple(x[i:j]) for i, j in runs(x, [size.get(h) for h in x])}
    return [(i, j) for i, j in mine if tuple(y[i:j]) in have]


def blocks(x: list[int], y: list[int], sizes: list[int], least: int) -> list[bool]:
    """Which lines of y (hashes, with their sizes) lie in a block of at least that size that x has."""
    gone = [False] * len(y)
    for _, j, n in patience(x, y):
        if sum(sizes[j : j + n]) >= least:
            gone[j : j + n] = [True] * n
    for i, j in _moved(x, y, sizes, gone, least):
        gone[i:j] = [True] * (j - i)
    return gone


def _aligned(min_block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y, sizes, numbers in zip(*(b.column(c) for c in ("x", "hashes", "sizes", "numbers")), strict=True):
                gone = blocks(x.as_py(), y.as_py(), sizes.as_py(), min_block_bytes)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                number = numbers.values.to_numpy()
                out.append([{"start": int(number[i]), "end": int(number[j - 1]) + 1} for i, j in edge])
            yield pa.record_batch({"doc_id": b.column("doc_id"), "th": b.column("th"), "spans": pa.array(out, pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})))})

    return run


def _cut(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, spans in parts:
        lines, removed, cut, kept = [], [], [], []
        for t, s in zip(text, spans, strict=True):
            t, s = t.as_py(), s.as_py() or ()
            lines.append(0 if t is None else t.count(b"\n") + 1)
            if not s:
                removed.append(0)
                cut.append([])
                kept.append(t)
                continue
            rows = t.split(b"\n")
            gone = bytearray(len(rows))
            for x in s:
                gone[x["start"] : x["end"]] = b"\1" * (x["end"] - x["start"])
            before = False  # empty lines between two deleted ones
            for i, r in enumerate(rows):
                if r:
                    if before and gone[i]:
                        gone[last + 1 : i] = b"\1" * (i - last - 1)  # noqa: F821
                    before, last = bool(gone[i]), i
            edge = np.flatnonzero(np.diff(np.concatenate([[0], np.frombuffer(gone, np.int8), [0]]))).reshape(-1, 2)
            removed.append(sum(gone))
            cut.append([{"start": int(i), "end": int(j)} for i, j in edge])
            kept.append(b"\n".join(r for r, g in zip(rows, gone, strict=True) if not g))
        span = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))
        yield pa.StructArray.from_arrays([pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(cut, span), pa.array(kept, pa.binary())], ["n_lines", "n_removed", "spans", "kept"])


def remove_shared_blocks(docs: DataFrame, rare_holders: int = 8, min_line_bytes: int = 16, min_block_bytes: int = 60) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_lines, n_removed, spans (of lines deleted, apart and rising), kept_text."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _frame.as_binary("text").alias("text")).withColumn("th", F.xxhash64("text"))
    lines = source.where("doc_id is not null").mapInArrow(_lines(min_line_bytes, min_block_bytes), "doc_id long, th long, hashes array<long>, sizes array<int>, numbers array<int>, runs array<long>")
    lines = _frame.stored(lines.dropDuplicates(["doc_id", "th"]))
    keys = F.expr(f"array_distinct(concat(transform(filter(arrays_zip(hashes, sizes), x -> x.sizes >= {int(min_line_bytes)}), x -> x.hashes), runs))")
    held = lines.select("doc_id", "th", F.explode(keys).alias("line"))
    shared = held.groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min_by("th", "doc_id").alias("first_th")).where("n > 1")
    shared = _frame.stored(shared)
    held = _frame.stored(_frame.look_up(held, shared, "line", _frame.hot_keys(shared, "line", "n", lines.count()), "inner"))
    rare = held.where(F.col("n") <= rare_holders).groupBy("line").agg(F.sort_array(F.collect_list(F.struct("doc_id", "th"))).alias("d"))
    rare = rare.select(F.posexplode("d").alias("i", "e"), "d").select("e", F.explode(F.expr("slice(d, i + 2, size(d))")).alias("l")).where("e.doc_id < l.doc_id")
    rare = rare.select(F.col("e.doc_id").alias("earlier"), F.col("e.th").alias("earlier_th"), "l.doc_id", "l.th")
    common = held.where((F.col("n") > rare_holders) & (F.col("doc_id") > F.col("first"))).select(F.col("first").alias("earlier"), F.col("first_th").alias("earlier_th"), "doc_id", "th")
    pairs = _frame.stored(rare.union(common).distinct())
    total, hot = pairs.count(), {}
    for side in ("earlier", "doc_id"):
        hot[side] = _frame.hot_keys(pairs.groupBy(side).agg(F.count("*").alias("n")), side, "n", total)
    pairs = _frame.dealt(_frame.dealt(pairs, "doc_id", hot["doc_id"], "s"), "earlier", hot["earlier"], "t")
    own = _frame.in_all_places(lines.select("doc_id", "th", "hashes", "sizes", "numbers"), "doc_id", hot["doc_id"], "s")
    before = lines.select(F.col("doc_id").alias("earlier"), F.col("th").alias("earlier_th"), F.col("hashes").alias("x"))
    before = _frame.in_all_places(before, "earlier", hot["earlier"], "t")
    joined = pairs.join(own, ["doc_id", "th", "s"]).join(before, ["earlier", "earlier_th", "t"])
    spans = joined.select("doc_id", "th", "x", "hashes", "sizes", "numbers").mapInArrow(_aligned(min_block_bytes), f"doc_id long, th long, spans {SPANS}").where("size(spans) > 0")
    spans = spans.groupBy("doc_id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumn("s", F.lit(0))
    # rows without an id match nothing: they are dealt
    source = _frame.dealt(source, "doc_id", [], "s")
    out = source.join(spans, ["doc_id", "th", "s"], "left").withColumn("cut", F.arrow_udf(_cut, f"struct<n_lines: long, n_removed: long, spans: {SPANS}, kept: binary>")("text", "spans"))
    return out.select("doc_id", "cut.n_lines", "cut.n_removed", "cut.spans", F.col("cut.kept").cast("string").alias("kept_text"))
