"""Near-duplicate classes by DartMinHash.

A document is a weighted set of word shingles. Darts are thrown, by hashing, at the
plane of each element: weight on one axis, rank on the other. The element's region is
everything below its weight, so two documents share exactly the darts below the smaller
of their weights. For each of k coordinates the dart of the smallest rank is kept; two
documents keep the same one with the probability of their weighted Jaccard similarity.
Ranks are visited in doubling cells until every coordinate of a document has a dart, so
the work is about (elements + k log k) for a document instead of elements times k.

Signatures are cut into bands. Candidates are documents that share a band: all of a
bucket if it is small, else each member with three pivots (the member that shares most
buckets with others, the smallest and a random one). Links are joined to components by
alternating large and small stars, all in DataFrames. The members of large buckets that
are then still in several components are joined exactly: sets of similarity t or more
share one of their first n - ceil(t n) + 1 shingles, rarest first, so only members of
different components that share one of those (and leave room for enough common ones
after it) are candidates. Every candidate is verified by the exact Jaccard similarity of
the shingle sets (of 32-bit hashes), or of the multisets if shingles are counted.

Texts with equal shingle sets count as one node, so copies cost one row each. Nodes,
buckets, labels and shingles with many rows are dealt to many tasks (_frame.look_up).

Defined cases: null and empty texts have no shingle and are alone; a text of fewer words
than a shingle is one shingle; a null doc_id never names a class of several ids; repeated
rows share a class; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _frame, _text

#: The first rank cell is [0, 1 / 2**FIRST); each further one is as long as all before it.
FIRST = 6
#: Buckets up to this size are compared in full, larger ones by pivots.
SMALL_BUCKET = 8


def _poisson(mean: float) -> np.ndarray:
    """Cumulative distribution, long enough that the rest is below 1e-15."""
    k = np.arange(1, int(mean + 12 * mean**0.5) + 24)
    return np.cumsum(np.exp(np.concatenate([[0.0], np.cumsum(np.log(mean / k))]) - mean))


def darts(keys: np.ndarray, weights: np.ndarray, docs: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures (n_docs, k) as uint64; documents without positive weight keep the largest value."""
    best = np.full(n_docs * k, np.iinfo(np.uint64).max)
    if not len(keys):
        return best.reshape(n_docs, k)
    cells = np.ceil(weights).astype(np.int64)  # unit cells on the weight axis
    nth = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    room = np.repeat(weights, cells) - nth  # below 1 only in the last cell of a fractional weight
    base = _text.mix(np.repeat(keys, cells) + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    owner = np.repeat(docs, cells)
    top = 64 - 53
    level = 0
    while len(base):
        mean = 2.0 ** (max(level, 1) - 1 - FIRST)
        cdf = _poisson(mean)
        u = _text.mix(base + np.uint64((level * 2 + 1) * 0x9FB21C651E98DF25 & (1 << 64) - 1))
        hit = np.flatnonzero(u >= np.uint64(min(int(cdf[0] * 2.0**64), (1 << 64) - 1)))
        count = np.searchsorted(cdf, (u[hit] >> np.uint64(top)).astype(np.float64) * 2.0**-53, "right")
        hit = np.repeat(hit, count)
        nth = (np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
        e = _text.mix(u[hit] + (nth + np.uint64(1)) * np.uint64(0xA24BAED4963EE407))
        f = _text.mix(e ^ np.uint64(0x589965CC75374CC3))
        height = (f >> np.uint64(32)).astype(np.float64) * 2.0**-32
        inside = height < room[hit]
        e, f, hit = e[inside], f[inside], hit[inside]
        value = np.uint64(level << 58) | (f & np.uint64(0x3FFFFFF)) << np.uint64(32) | e & np.uint64(0xFFFFFFFF)
        slot = owner[hit] * k + ((e >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(best, slot, value)
        level += 1
        open_ = (best.reshape(n_docs, k) == np.iinfo(np.uint64).max).any(axis=1)
        stay = open_[owner]
        base, owner, room = base[stay], owner[stay], room[stay]
    return best.reshape(n_docs, k)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    n, k = signatures.shape
    bands = k // rows
    parts = signatures[:, : bands * rows].reshape(n, bands, rows).copy()
    parts ^= np.arange(bands, dtype=np.uint64)[None, :, None] * np.uint64(0xC2B2AE3D27D4EB4F)
    out = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        out = _text.mix(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out.view(np.int64)


def shingles(w: _text.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a slice, sorted by document and hash: hash, count, document."""
    h = w.hashes()
    at = np.flatnonzero(w.room(size))
    keys, docs = _text.windows(h, at, size), w.docs[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        keys = np.concatenate([keys, _text._ranged(h, w.first[short], w.first[short + 1])])
        docs = np.concatenate([docs, short])
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.concatenate([at, [len(keys)]])), docs[at]


def _digest(*arrays: np.ndarray) -> bytes:
    return hashlib.blake2b(b"".join(x.tobytes() for x in arrays), digest_size=16).digest()


def _signed(size: int, bands: int, rows: int, counted: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in _text.read(b.column("text")):
                keys, counts, docs = shingles(w, size)
                counts = counts if counted else np.ones_like(counts)
                first = np.searchsorted(docs, np.arange(hi - lo + 1))
                has = np.diff(first) > 0
                total = np.bincount(docs, weights=counts, minlength=hi - lo).astype(np.int32)
                found = band_keys(darts(keys, counts.astype(np.float64), docs, hi - lo, bands * rows), rows)
                ids = [_digest(keys[first[d] : first[d + 1]], counts[first[d] : first[d + 1]]) if has[d] else None for d in range(hi - lo)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(found.ravel()))
                part = slice(lo, hi)
                yield pa.record_batch({"doc_id": b.column("doc_id")[part], "th": b.column("th")[part], "node": pa.array(ids, pa.binary()), "n": pa.array(total), "bands": lists})

    return run


def _sets(size: int, counted: bool) -> Callable:
    """Each text's shingles as 32-bit hashes; if counted, the nth time of a shingle is an element of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in _text.read(b.column("text")):
                keys, counts, docs = shingles(w, size)
                counts = counts if counted else np.ones_like(counts)
                first = np.searchsorted(docs, np.arange(hi - lo + 1))
                ids = [_digest(keys[a:z], counts[a:z]) for a, z in zip(first[:-1], first[1:], strict=True)]
                if counted:
                    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                    keys, docs = _text.mix(np.repeat(keys, counts) + nth.astype(np.uint64)), np.repeat(docs, counts)
                    first = np.searchsorted(docs, np.arange(hi - lo + 1))
                low = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(keys.astype(np.uint32).view(np.int32)))
                yield pa.record_batch({"node": pa.array(ids, pa.binary()), "items": low})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) is connected with."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = _frame.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        mark = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or not mark[0]:
            return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).union(current.select("b", "b").distinct().join(current.select("a").distinct(), F.col("b") == F.col("a"), "left_anti").toDF("node", "label"))
        before = mark
        n = both(current)
        hot = _frame.hot_keys(n.groupBy("a").agg(F.count("*").alias("n")), "a", "n", 2 * mark[0])
        least = n.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _frame.look_up(n.where("b > a"), least, "a", hot, "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = _frame.stored(large)
        hot = _frame.hot_keys(large.groupBy("a").agg(F.count("*").alias("n")), "a", "n", mark[0])
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        out = _frame.look_up(large, small, "a", hot, "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = _frame.stored(out)
        _frame.forget(current)
        _frame.forget(large)
        current = new


def _prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a superset of the pairs of sets (node, label, items) of different labels whose similarity is threshold or more."""
    items = _frame.stored(sets.select("node", "label", F.explode(F.array_distinct("items")).alias("item")))
    rarity = _frame.stored(items.groupBy("item").agg(F.count("*").alias("holders")))
    hot = _frame.hot_keys(rarity, "item", "holders", items.count())
    ranked = _frame.look_up(items, rarity, "item", hot, "inner").groupBy("node", "label").agg(F.sort_array(F.collect_list(F.struct("holders", "item"))).alias("s"))
    first = F.expr(f"slice(s, 1, cast(size(s) - ceil({threshold!r} * size(s) - 1e-9) + 1 as int))")
    heads = ranked.select("node", "label", F.size("s").alias("n"), F.posexplode(first).alias("at", "x")).select("node", "label", "n", "at", F.col("x.item").alias("item"))
    heads = _frame.stored(heads)
    mixed = heads.groupBy("item").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("holders")).where("l <> m")
    mixed = _frame.stored(mixed.select("item", "holders"))
    hot = _frame.hot_keys(mixed, "item", "holders", heads.count())
    heads = _frame.stored(_frame.look_up(heads, mixed.select("item"), "item", hot, "inner"))
    # one side of an item with many holders is dealt, the other is in each place
    other = heads.select("item", *(F.col(c).alias(f"o_{c}") for c in ("node", "label", "n", "at")))
    room = F.least(F.col("n") - F.col("at"), F.col("o_n") - F.col("o_at"))  # common ones at most, if this is the first
    fits = room >= threshold / (1 + threshold) * (F.col("n") + F.col("o_n")) - 1e-6
    pairs = _frame.dealt(heads, "item", hot, "salt").join(_frame.in_all_places(other, "item", hot, "salt"), ["item", "salt"]).where((F.col("node") < F.col("o_node")) & (F.col("label") != F.col("o_label")) & fits)
    return pairs.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct()


def _labelled(docs: DataFrame, threshold: float, size: int, bands: int, rows: int, counted: bool) -> DataFrame:
    """(doc_id, th, label, class_id) of each row: th is the text's hash, label the class's node (null: no shingle)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _frame.as_binary("text").alias("text"), F.xxhash64("text").alias("th"))
    signed = _frame.stored(source.mapInArrow(_signed(size, bands, rows, counted), "doc_id long, th long, node binary, n int, bands array<long>"))
    total = signed.count()
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    nodes = _frame.stored(nodes)
    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    crowded = _frame.stored(banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    hot = _frame.hot_keys(crowded, "key", "members", total)
    members = _frame.stored(_frame.look_up(banded, crowded, "key", hot, "inner"))
    little = members.where(F.col("members") <= SMALL_BUCKET).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    little = little.select(F.posexplode("m").alias("i", "x"), "m").select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
    big = members.where(F.col("members") > SMALL_BUCKET)
    central = big.groupBy("node").agg(F.sum("members").alias("central"))
    pivots = big.join(central, "node").groupBy("key").agg(F.max(F.struct("central", "node", "n")).alias("p"), F.min(F.struct("node", "n")).alias("q"), F.min(F.struct(F.xxhash64("node", "key"), "node", "n")).alias("r"))
    pivots = pivots.select("key", F.array_distinct(F.array(F.struct("p.node", "p.n"), F.struct("q.node", "q.n"), F.struct("r.node", "r.n"))).alias("y"))
    starred = _frame.look_up(big, pivots, "key", hot, "inner").select(F.struct("node", "n").alias("x"), F.explode("y").alias("y")).where("x.node <> y.node")
    like = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * threshold
    pairs = little.union(starred).where(like).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    pairs = _frame.stored(pairs)
    wanted = nodes.select("node", "doc_id").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).union(big.select("node")).distinct(), "node", "left_semi").select("doc_id").distinct()
    sets = source.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(_sets(size, counted), "node binary, items array<int>")
    sets = _frame.stored(sets.dropDuplicates(["node"]))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), read from files, whose sets are similar; a pivot may be in many."""
        ends, hot = pairs.count(), {}
        for side in ("a", "b"):
            hot[side] = _frame.hot_keys(pairs.groupBy(side).agg(F.count("*").alias("n")), side, "n", ends)
        both = _frame.dealt(_frame.dealt(pairs, "a", hot["a"], "s"), "b", hot["b"], "t")
        both = both.join(_frame.in_all_places(sets.toDF("a", "x"), "a", hot["a"], "s"), ["a", "s"])
        both = both.join(_frame.in_all_places(sets.toDF("b", "y"), "b", hot["b"], "t"), ["b", "t"])
        both = both.withColumn("common", F.size(F.array_intersect("x", "y")))
        return both.where(F.col("common") >= threshold * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")

    labels = _frame.stored(components(linked(pairs)))
    apart = big.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    several = apart.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m")
    apart = apart.join(big.select("key", "node").join(several, "key", "left_semi").select("node").distinct(), "node", "left_semi")
    apart = _frame.stored(apart.select("node", "label").distinct())
    if not apart.isEmpty():
        more = linked(_frame.stored(_prefix_pairs(apart.join(sets, "node"), threshold)))
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))
    # labels and classes are settled by nodes; only the last join has a row for each document
    named = _frame.stored(nodes.select("node", "doc_id", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    least = _frame.stored(named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("nodes")))
    known = _frame.look_up(named, least.drop("nodes"), "label", _frame.hot_keys(least, "label", "nodes", total), "inner").select("node", "label", "class_id")
    out = _frame.look_up(signed.select("doc_id", "th", "node"), known, "node", _frame.hot_keys(named, "node", "copies", total))
    return out.select("doc_id", "th", "label", F.coalesce("class_id", "doc_id").alias("class_id"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 24, rows: int = 4, counted: bool = False) -> DataFrame:
    """(doc_id, class_id): class_id is the smallest doc_id of the near-duplicate class.

    counted: a shingle weighs as often as it occurs, and similar is what has a weighted
    Jaccard similarity of threshold; else each weighs 1, which is that of the shingle sets.
    """
    return _labelled(docs, threshold, size, bands, rows, counted).select("doc_id", "class_id")


def keep_first(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 24, rows: int = 4, counted: bool = False) -> DataFrame:
    """The rows of docs, with their own columns, that are the first of their class.

    Of rows that share a doc_id but not a class each class keeps its own; of those that share
    both one text stays, and of equal texts the row with the smallest hash of all columns (but maps).
    Rows with a null doc_id stay: they name nothing.
    """
    first = _labelled(docs, threshold, size, bands, rows, counted).where("doc_id = class_id")
    keep = first.groupBy(F.col("doc_id").alias("__id"), F.coalesce("label", F.col("th").cast("string").cast("binary"))).agg(F.min("th").alias("__th")).select("__id", "__th").distinct()
    rows_ = docs.withColumn("__own", F.xxhash64(F.col("text").cast("binary")))
    rows_ = rows_.join(keep, (rows_["doc_id"] == F.col("__id")) & (rows_["__own"] == F.col("__th")), "left_semi")
    turn = F.row_number().over(Window.partitionBy("doc_id", "__own").orderBy(F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))))
    rows_ = rows_.withColumn("__turn", turn).where("__turn = 1").drop("__turn", "__own")
    return rows_.unionByName(docs.where("doc_id is null"))
