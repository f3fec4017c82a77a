"""Benchmark decontamination: find benchmark passages in documents with an FM-index per shard.

A shard is a run of documents of bounded size inside a task. Its text is the sequence of
its words as numbers. Words that no benchmark item has only separate, and a run of
benchmark words too short for any passage cannot match, so both are left out before the
index is built; that changes no result. On the rest stands an FM-index:

* suffixes sorted by prefix doubling;
* the Burrows-Wheeler transform in a wavelet matrix, which answers ranks;
* backward search of all passages at once, one word per step;
* every SAMPLE-th suffix position, from which occurrences are located by LF steps.

Occurrences are merged into removal spans. Nothing is shuffled: the benchmark goes to the
tasks in parts of a checked size (max_part_bytes of text, of which the windows are arrays
of about 12 bytes a byte), each searched in a pass of its own; an item is never cut.

Defined cases: null or empty text has no words and no hits; an item without words is
ignored; equal item_ids are one item; an item whose id is null marks words but is not
listed; repeated document rows are answered one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _frame, _text

SAMPLE = 8
SPAN = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))


class FMIndex:
    """Over integers in [0, size), of which 0, the separator, ends the text: find and locate patterns without 0."""

    def __init__(self, text: np.ndarray, size: int):
        n = self.n = len(text)
        rank = text.astype(np.int64)
        order = np.argsort(rank, kind="stable")
        length = 1
        while True:
            second = np.zeros(n, np.int64)
            second[: max(0, n - length)] = rank[length:] + 1
            key = rank * (max(int(second.max()), int(rank.max())) + 2) + second
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            length *= 2
            if new[-1] == n - 1:
                break
        # What precedes the whole text is a symbol of its own, so no step leads to the last suffix, the smallest one.
        bwt = np.where(order == 0, size, text[order - 1])
        self.before = np.concatenate([[1], np.cumsum(np.bincount(text, minlength=size))])
        self.bits = size.bit_length()
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            b = (bwt >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(b)]).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            bwt = np.concatenate([bwt[b == 0], bwt[b == 1]])
        held = order % SAMPLE == 0
        self.held = held
        self.held_before = np.concatenate([[0], np.cumsum(held)])
        self.positions = order[held]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is in the transform before each position."""
        start, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            up = ((symbol >> level) & 1).astype(bool)
            start = np.where(up, zeros + ones[start], start - ones[start])
            at = np.where(up, zeros + ones[at], at - ones[at])
        return at - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(at), np.int64), at.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            b = ones[at + 1] - ones[at]
            out = out * 2 + b
            at = np.where(b == 1, zeros + ones[at], at - ones[at])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes for the rows of patterns."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for step in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, step]
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out, steps, todo, rows = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            found = self.held[rows]
            out[todo[found]] = self.positions[self.held_before[rows[found]]] + steps
            todo, rows = todo[~found], rows[~found]
            c = self.symbol(rows)
            rows = self.before[c] + self.rank(c, rows)
            steps += 1
        return out


class Passages:
    """Windows of benchmark items: words as numbers from 1, and the items of each window."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int):
        items = [(i, t) for i, t in items if t]
        parts = [(w.hashes(), w.counts) for _, _, w in _text.read(pa.array([t for _, t in items], pa.binary()), _text.ALNUM, lower=True)]
        h = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in parts)])
        counts = np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)])
        first = np.concatenate([[0], np.cumsum(counts)])
        docs = np.repeat(np.arange(len(counts)), counts)
        room = first[1:][docs] - np.arange(len(h))
        self.words = np.unique(h)
        numbers = (np.searchsorted(self.words, h) + 1).astype(np.int32)
        ids = np.array([None if i is None else str(i) for i, _ in items], object)
        self.names = sorted({x for x in ids[counts > 0] if x is not None})
        number = {x: i for i, x in enumerate(self.names)}
        item = np.array([-1 if x is None else number.get(x, -1) for x in ids], np.int32)
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by length: patterns, first[], item numbers
        for length in sorted({min(int(n), window) for n in np.unique(counts)} - {0}):
            at = np.flatnonzero(room >= window) if length == window else first[:-1][counts == length]
            key, one, which = np.unique(_text.windows(h, at, length), return_index=True, return_inverse=True)
            patterns = numbers[at[one][:, None] + np.arange(length)]
            pairs = np.unique(np.stack([which, item[docs[at]]], axis=1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            self.groups.append((patterns, np.searchsorted(pairs[:, 0], np.arange(len(key) + 1)), pairs[:, 1].astype(np.int32)))
        self.shortest = min((g[0].shape[1] for g in self.groups), default=0)
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(self.words & np.uint64(0x3FFFF)).astype(np.int64)] = True

    def number(self, h: np.ndarray) -> np.ndarray:
        """Numbers of hashed words; 0 for words that no item has."""
        out = np.zeros(len(h), np.int64)
        at = np.flatnonzero(self.bits[(h & np.uint64(0x3FFFF)).astype(np.int64)]) if len(self.words) else np.zeros(0, np.int64)
        if len(at):
            found = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
            out[at] = np.where(self.words[found] == h[at], found + 1, 0)
        return out


class _Shard:
    """Documents of a task until there are enough for an index."""

    def __init__(self, passages: Passages):
        self.p = passages
        self.ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.texts: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: pa.Array, w: _text.Words) -> None:
        number = self.p.number(w.hashes())
        inside = number > 0
        edge = np.ones(len(w), bool)  # of runs of benchmark words within a document
        edge[1:] = inside[1:] != inside[:-1]
        edge[w.first[:-1][w.counts > 0]] = True
        at = np.flatnonzero(edge)
        length = np.diff(np.concatenate([at, [len(w)]]))
        keep = inside[at] & (length >= self.p.shortest) if len(at) else np.zeros(0, bool)
        at, length = at[keep], length[keep]
        out = np.zeros(int(length.sum()) + len(length), np.int64)
        place = np.zeros(len(out), np.int64)
        to = np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)
        source = np.repeat(at - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
        out[to], place[to] = number[source], source + self.size
        self.texts.append(out)
        self.places.append(place)
        self.ids.append(ids)
        self.counts.append(w.counts)
        self.size += len(w)

    def answer(self) -> pa.RecordBatch:
        counts = np.concatenate(self.counts)
        text, place = np.concatenate(self.texts), np.concatenate(self.places)
        first = np.concatenate([[0], np.cumsum(counts)])
        cover = np.zeros(self.size + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        if len(text):
            index = FMIndex(text, len(self.p.words) + 1)
            for patterns, item_first, item in self.p.groups:
                lo, hi = index.search(patterns)
                n = hi - lo
                which = np.repeat(np.arange(len(n)), n)
                rows = np.arange(len(which)) + np.repeat(lo - np.cumsum(n) + n, n)
                at = place[index.locate(rows)]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + patterns.shape[1], -1)
                # a document and a window once, however often it occurs there, before its items are listed
                doc, which = np.unique(np.stack([np.searchsorted(first, at, "right") - 1, which], axis=1), axis=0).T
                per = item_first[which + 1] - item_first[which]
                name = item[np.arange(int(per.sum())) + np.repeat(item_first[which] - np.cumsum(per) + per, per)]
                pairs.append(np.unique(np.stack([np.repeat(doc, per), name], axis=1), axis=0))
        hit = np.cumsum(cover)[:-1] > 0
        edge = np.zeros(self.size + 1, bool)
        edge[:-1][1:] = hit[1:] != hit[:-1]
        edge[first] = True
        at = np.flatnonzero(edge[:-1])
        end = np.append(at[1:], self.size)
        at, end = at[hit[at]], end[hit[at]] if len(at) else end
        doc = np.searchsorted(first, at, "right") - 1
        span_first = np.searchsorted(doc, np.arange(len(counts) + 1)).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(span_first), pa.StructArray.from_arrays([pa.array(at - first[doc]), pa.array(end - first[doc])], ["start", "end"]))
        found = np.unique(np.concatenate(pairs), axis=0)
        item_first = np.searchsorted(found[:, 0], np.arange(len(counts) + 1)).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(item_first), pa.array([self.p.names[i] for i in found[:, 1]], pa.string()))
        return pa.record_batch({"doc_id": pa.concat_arrays(self.ids), "n_words": pa.array(counts.astype(np.int64)), "spans": spans.cast(SPAN), "items": items})


def _searched(passages: Passages, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(passages)
        for b in batches:
            for lo, hi, w in _text.read(b.column("text"), _text.ALNUM, lower=True):
                shard.add(b.column("doc_id").slice(lo, hi - lo), w)
                if shard.size >= shard_words:
                    yield shard.answer()
                    shard = _Shard(passages)
        if shard.ids:
            yield shard.answer()

    return run


def _parts(benchmark: DataFrame, window: int, max_part_bytes: int) -> list[Callable[[], Passages]]:
    """Makers of the passages of the benchmark's parts, each of a bounded size."""
    items = benchmark.select("item_id", _frame.as_binary("text").alias("text"))
    parts = 1 + (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // max_part_bytes
    own = lambda i: items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
    return [lambda i=i: Passages([(r[0], None if r[1] is None else bytes(r[1])) for r in own(i).collect()], window) for i in range(parts)]


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 1 << 20, max_part_bytes: int = 8 << 20) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, spans (merged, in words), items (ids as sorted strings)."""
    parts = _parts(benchmark, window, max_part_bytes)
    schema = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _frame.as_binary("text").alias("text"))
    if len(parts) == 1:
        return source.mapInArrow(_searched(parts[0](), shard_words), schema)
    source = _frame.stored(source.withColumn("row", F.monotonically_increasing_id()))
    ids = source.select("row", "doc_id")
    rows = source.select(F.col("row").alias("doc_id"), "text")
    each = _frame.stored(rows.mapInArrow(_searched(parts[0](), shard_words), schema))
    for part in parts[1:]:
        each = each.union(_frame.stored(rows.mapInArrow(_searched(part(), shard_words), schema).where("size(spans) > 0")))
    each = each.groupBy(F.col("doc_id").alias("row")).agg(F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # a span that begins inside or at the end of the one before it continues that one
    last = "element_at(acc, -1)"
    merged = F.expr(f"""aggregate(s, cast(array() as array<struct<start: bigint, end: bigint>>), (acc, x) -> if(size(acc) > 0 and x.start <= {last}.end,
        concat(slice(acc, 1, size(acc) - 1), array(struct({last}.start as start, greatest({last}.end, x.end) as end))), concat(acc, array(x))))""")
    return each.withColumn("spans", merged).join(ids, "row").select("doc_id", "n_words", "spans", "items")


def _flagged(passages: Passages, shard_words: int):
    """As _searched, for a column of texts: does a passage occur?"""

    @F.arrow_udf("boolean")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in parts:
            out, shard = [], _Shard(passages)
            for lo, hi, w in _text.read(text, _text.ALNUM, lower=True):
                shard.add(pa.array(np.arange(lo, hi)), w)
                if shard.size >= shard_words:
                    out.append(shard.answer().column("spans"))
                    shard = _Shard(passages)
            if shard.ids:
                out.append(shard.answer().column("spans"))
            yield pa.array(np.concatenate([np.asarray(x.value_lengths()) for x in out]) > 0 if out else np.zeros(0, bool))

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_words: int = 1 << 20, max_part_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, with their own columns, in which no benchmark passage occurs."""
    for part in _parts(benchmark, window, max_part_bytes):
        docs = docs.where(~_flagged(part(), shard_words)(_frame.as_binary("text")))
    return docs
