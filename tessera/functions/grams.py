"""Character trigrams of whole texts, an Arrow batch at a time in numpy.

Expressions over an array of characters evaluate a lambda per character; packing three
code points into a long and sorting them is some fifty times faster, so this is one of
the few places where Python is on the main path.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded(text: str | None) -> np.ndarray:
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((points >= 65) & (points <= 90), points + 32, points)


def codes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text as longs, and for each the bits of the characters that follow it."""
    p = _folded(text)
    if len(p) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = (p[:-2] << 42) | (p[1:-1] << 21) | p[2:]
    bit = np.zeros(len(key), np.int64)
    bit[:-1] = 1 << ((p[3:] * 31) & 7)
    order = np.argsort(key, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
    return key[order][at], np.bitwise_or.reduceat(bit[order], at)


def strings(key: np.ndarray) -> list[str]:
    parts = np.stack([key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF], axis=1).astype(np.uint32)
    return np.ascontiguousarray(parts).view("U3").ravel().tolist() if len(key) else []


def _posted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in parts:
        found = [codes(t) for t in texts.to_pylist()]
        first = np.concatenate([[0], np.cumsum([len(k) for k, _ in found])]).astype(np.int32)
        keys = np.concatenate([k for k, _ in found]) if found else np.zeros(0, np.int64)
        masks = np.concatenate([m for _, m in found]) if found else np.zeros(0, np.int64)
        yield pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays([pa.array(keys), pa.array(masks.astype(np.int32))], ["trigram", "next_mask"]))


def posted(text: Column) -> Column:
    """array<struct<trigram, next_mask>> of the distinct trigrams of a text; trigrams are packed longs."""
    return F.arrow_udf(_posted, "array<struct<trigram: long, next_mask: int>>")(text)


def packed(trigram: str) -> int:
    return (ord(trigram[0]) << 42) | (ord(trigram[1]) << 21) | ord(trigram[2])


def _shown(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for keys in parts:
        yield pa.array(strings(keys.to_numpy()), pa.string())


def shown(trigram: Column) -> Column:
    """A packed trigram as text (a zero character at its end is dropped)."""
    return F.arrow_udf(_shown, "string")(trigram)


def stats(text: Column, query: Sequence[str]) -> Column:
    """struct<n, hits>: how many distinct trigrams a text has, and which of the query's."""
    wanted = np.array([packed(t) for t in query], np.int64)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            n, hits = [], []
            for t in texts.to_pylist():
                key, _ = codes(t)
                n.append(len(key))
                hits.append([q for q, x in zip(query, np.isin(wanted, key), strict=True) if x])
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.string()))], ["n", "hits"])

    return F.arrow_udf(run, "struct<n: long, hits: array<string>>")(text)
