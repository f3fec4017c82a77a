"""Substring dedup: remove every passage of `window` words that an earlier document has too.

Method: difference-cover anchors. With a perfect difference cover D of a period v,
any two positions i, j have a shift d < v for which (i + d) mod v and (j + d) mod v
are both in D. Two equal passages of `window` words so share an aligned anchor, the
hash of `window - v + 1` words at cover positions, wherever they stand in their
documents. Hence only |D| of v positions (3 of 7) are hashed and exchanged:

1. per chunk of documents: the distinct anchors, packed by bucket of the hash;
2. per bucket: the anchors that two documents have, sent back to their chunks;
3. per chunk: extend, i.e. hash the whole windows around shared anchors;
4. per bucket: the smallest doc_id of each such window, sent back to its chunks;
5. per chunk: windows that also start in a smaller doc_id cover the words to remove.

A key is sent once per chunk however often it occurs there, so a passage that a third
of all documents have costs a bucket one entry per chunk, never one per document.
Chunks (by a hash of id and text, so rows without an id are dealt like others) and
buckets hold bounded bytes; their number grows with the corpus.
Anchors are compared by bucket and 32 bits (they only nominate), windows by 64 bits.

Defined cases: null or empty text has no words; a null doc_id counts as larger than
any other; rows that share a doc_id are not compared with each other; texts shorter
than the window are kept whole; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _frame, _text

NO_ID = np.iinfo(np.int64).max


def is_cover(period: int, cover: tuple[int, ...]) -> bool:
    """Does every difference modulo the period occur between two members?"""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Member:
    """Fast membership of uint64 values in a sorted table, by a bitmap first."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(table & np.uint64(0x3FFFF)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in values and in the table of the equal ones."""
        at = np.flatnonzero(self.bits[(values & np.uint64(0x3FFFF)).astype(np.int64)])
        if not len(at) or not len(self.table):
            return at[:0], at[:0]
        found = np.minimum(np.searchsorted(self.table, values[at]), len(self.table) - 1)
        same = self.table[found] == values[at]
        return at[same], found[same]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("doc_id").fill_null(NO_ID).to_numpy()


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order, and start and end of each run of equal keys in it."""
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.diff(keys[order])) + 1
    return order, np.concatenate([[0], new]), np.concatenate([new, [len(keys)]])


def _packed(bucket: np.ndarray, chunk: int, *arrays: np.ndarray) -> dict[str, list]:
    rows: dict[str, list] = {"bucket": [], "chunk": []} | {f"v{i}": [] for i in range(len(arrays))}
    for b, parts in _frame.split_by(bucket, *arrays):
        rows["bucket"].append(b)
        rows["chunk"].append(chunk)
        for i, p in enumerate(parts):
            rows[f"v{i}"].append(p.tobytes())
    return rows


_WIRE = {"bucket": pa.int32(), "chunk": pa.int32(), "v0": pa.binary(), "v1": pa.binary(), "v2": pa.binary()}


def _wire(rows: dict[str, list], *names: str) -> pa.Table:
    return pa.table({n: pa.array(rows.get(n, []), _WIRE[n]) for n in names})


def _join(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def remove_repeats(docs: DataFrame, window: int = 13, period: int = 7, cover: tuple[int, ...] = (0, 1, 3), chunk_bytes: int = 8 << 20, bucket_bytes: int = 4 << 20) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, spans (word ranges removed), kept_text."""
    width = window - period + 1
    if width < 1 or not is_cover(period, cover):
        raise ValueError("the cover must have every difference of a period that is shorter than the window")
    total = _frame.text_bytes(docs)
    chunks = 1 + total // chunk_bytes
    buckets = 1 + total // 14 * 2 * len(cover) // period * 8 // bucket_bytes
    wide, in_cover = np.uint64(buckets), np.isin(np.arange(period), cover)

    def anchors(w: _text.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and keys of a slice's anchors."""
        at = np.arange(len(w)) - np.repeat(w.first[:-1], w.counts)
        at = np.flatnonzero(in_cover[at % period] & w.room(width))
        k = _text.windows(h, at, width)
        return at, ((k >> np.uint64(32)) % wide) << np.uint64(32) | k & np.uint64(0xFFFFFFFF)

    def anchored(key: tuple, table: pa.Table) -> pa.Table:
        keys, owner = [], []
        for lo, _, w in _text.read(table.column("text")):
            at, k = anchors(w, w.hashes())
            keys.append(k)
            owner.append(w.docs[at] + lo)
        keys, owner = np.concatenate(keys), _ids(table)[np.concatenate(owner)]
        if not len(keys):
            return _wire({}, "bucket", "chunk", "v0", "v1")
        order, start, end = _grouped(keys)
        owner = owner[order]
        multi = np.maximum.reduceat(owner, start) != np.minimum.reduceat(owner, start)
        keys = keys[order[start]]
        return _wire(_packed((keys >> np.uint64(32)).astype(np.int64), key[0].as_py(), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), multi.astype(np.uint8)), "bucket", "chunk", "v0", "v1")

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        keys, multi = _join(table, "v0", np.uint32), _join(table, "v1", np.uint8)
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(x) // 4 for x in table.column("v0").to_pylist()])
        order, start, end = _grouped(keys)
        keep = np.repeat((end - start > 1) | (np.maximum.reduceat(multi[order], start) > 0), end - start)
        order = order[keep]
        rows = _packed(chunk[order], 0, keys[order].astype(np.uint64) | np.uint64(key[0].as_py() << 32))
        return _wire({"chunk": rows["bucket"], "v0": rows["v0"]}, "chunk", "v0")

    def extended(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        member = _Member(np.sort(_join(found, "v0", np.uint64)))
        ids, keys, owner = _ids(table), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, _, w in _text.read(table.column("text")) if len(member.table) else ():
            h = w.hashes()
            at, k = anchors(w, h)
            hit = at[member.find(k)[0]]
            if not len(hit):
                continue
            covered = np.zeros(len(w) + 1, np.int64)
            docs_of = w.docs
            np.add.at(covered, np.maximum(hit - (period - 1), w.first[docs_of[hit]]), 1)
            np.add.at(covered, hit + 1, -1)
            start = np.flatnonzero((np.cumsum(covered)[:-1] > 0) & w.room(window))
            keys.append(_text.windows(h, start, window))
            owner.append(ids[docs_of[start] + lo])
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        if not len(keys):
            return _wire({}, "bucket", "chunk", "v0", "v1", "v2")
        order, start, _ = _grouped(keys)
        owner = owner[order]
        least = np.minimum.reduceat(owner, start)
        multi = np.maximum.reduceat(owner, start) != least
        keys = keys[order[start]]
        return _wire(_packed((keys % wide).astype(np.int64), key[0].as_py(), keys, least, multi.astype(np.uint8)), "bucket", "chunk", "v0", "v1", "v2")

    def first(key: tuple, table: pa.Table) -> pa.Table:
        keys, owner, multi = _join(table, "v0", np.uint64), _join(table, "v1", np.int64), _join(table, "v2", np.uint8)
        chunk = np.repeat(table.column("chunk").to_numpy(), [len(x) // 8 for x in table.column("v0").to_pylist()])
        order, start, end = _grouped(keys)
        least = np.repeat(np.minimum.reduceat(owner[order], start), end - start)
        keep = np.repeat((end - start > 1) | (np.maximum.reduceat(multi[order], start) > 0), end - start)
        order, least = order[keep], least[keep]
        rows = _packed(chunk[order], 0, keys[order], least)
        return _wire({"chunk": rows["bucket"], "v0": rows["v0"], "v1": rows["v1"]}, "chunk", "v0", "v1")

    def cut(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        keys, least = _join(found, "v0", np.uint64), _join(found, "v1", np.int64)
        order = np.argsort(keys)
        member, least, ids = _Member(keys[order]), least[order], _ids(table)
        offs, data = _text.column(table.column("text"))
        n_words, n_removed, spans, kept = [], [], [], []
        for lo, hi in _text.slices(offs):
            w = _text.Words(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], _text.SPACED)
            start = np.flatnonzero(w.room(window)) if len(keys) else np.zeros(0, np.int64)
            if len(start):
                at, row = member.find(_text.windows(w.hashes(), start, window))
                start = start[at[least[row] < ids[lo + w.docs[start[at]]]]]
            gone = np.zeros(len(w) + 1, np.int64)
            np.add.at(gone, start, 1)
            np.add.at(gone, np.minimum(start + window, len(w)), -1)
            gone = np.cumsum(gone)[:-1] > 0
            lost = np.concatenate([[0], np.cumsum(gone)])
            for d in range(hi - lo):
                a, b = w.first[d], w.first[d + 1]
                n = int(lost[b] - lost[a])
                words = data[offs[lo + d] : offs[lo + d + 1]].tobytes().split()
                n_words.append(len(words))
                n_removed.append(n)
                if n:
                    mask = gone[a:b]
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
                    words = [x for x, g in zip(words, mask.tolist(), strict=True) if not g]
                else:
                    spans.append([])
                kept.append(b" ".join(words))
        span = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, span), "kept_text": pa.array(kept, pa.binary())})

    def wire(*names: str) -> str:
        return ", ".join(f"{n} {'int' if n in ('bucket', 'chunk') else 'binary'}" for n in names)

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _frame.as_binary("text").alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))
    by_chunk = lambda df: _frame.numbered(df, "chunk", chunks).groupBy("chunk")
    by_bucket = lambda df: _frame.numbered(df, "bucket", buckets).groupBy("bucket")
    texts = by_chunk(dealt)
    back = by_bucket(texts.applyInArrow(anchored, wire("bucket", "chunk", "v0", "v1"))).applyInArrow(shared, wire("chunk", "v0"))
    ends = by_bucket(texts.cogroup(by_chunk(back)).applyInArrow(extended, wire("bucket", "chunk", "v0", "v1", "v2"))).applyInArrow(first, wire("chunk", "v0", "v1"))
    out = texts.cogroup(by_chunk(ends)).applyInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept_text binary")
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))
