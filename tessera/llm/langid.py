"""Language ID by nearest centroid.

A text becomes a TF-IDF vector of hashed byte n-grams (orders 1 to 3 of the lower-cased
text, everything but letters folded to one space), with sublinear counts and unit length.
Document frequencies come from every labelled training row. Each language gets several
centroids by spherical k-means over a bounded sample of its training rows
(sample_per_lang, the smallest hashes of doc_id). A text takes the language of the
centroid with the largest cosine. A text is rejected if its cosine is below min_cosine or
below the distance learned for its language and length: SLACK times the QUANTILE of the
cosines that beginnings of the sample's texts, cut to each of LENGTHS, have to the
centroids of their own language (texts shorter than all of them: min_cosine alone).

Defined cases: null text and text without a letter are `und` with score 0 and rejected;
rows whose lang is null are not learned from; a null doc_id counts as the empty text for
the fold; without any training row every text is `und`; ties go to the smaller language
name; repeated rows and other columns change nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _frame, _text

#: Documents of a dense block of vectors.
BLOCK = 192
#: Bytes of the beginnings that rejection is learned from, and the share of their lowest cosine that a text must reach.
LENGTHS = (32, 128, 512, 2048)
QUANTILE, SLACK = 0.01, 0.9
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def vectors(col: pa.Array, dims: int) -> Iterator[np.ndarray]:
    """Blocks (documents, dims) of n-gram counts."""
    offs, data = _text.column(col)
    for low, high in _text.slices(offs):
        for lo in range(low, high, BLOCK):
            hi = min(high, lo + BLOCK)
            ends = offs[lo : hi + 1] - offs[lo]
            b = _FOLD[data[offs[lo] : offs[hi]]]
            keep = np.ones(len(b), bool)
            keep[1:] = (b[1:] != 0x20) | (b[:-1] != 0x20)
            first = np.concatenate([[0], np.cumsum(keep)])[ends]
            b = b[keep].astype(np.uint32)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            out = np.zeros((hi - lo) * dims)
            code = np.zeros(len(b), np.uint32)
            for n in (1, 2, 3):
                if len(b) < n:
                    break
                code = code[: len(b) - n + 1] * np.uint32(256) + b[n - 1 :]
                inside = doc[: len(code)] == doc[n - 1 :]
                hashed = ((code + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(7)
                out += np.bincount(doc[: len(code)][inside] * dims + (hashed[inside] % np.uint32(dims)).astype(np.int64), minlength=len(out))
            yield out.reshape(hi - lo, dims).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * idf)


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds, without chance."""
    centre = [_unit(x.mean(axis=0, keepdims=True))[0]]
    seeds = []
    nearest = x @ centre[0]
    for _ in range(min(k, len(x))):
        at = int(np.argmin(nearest))
        seeds.append(x[at])
        nearest = np.maximum(nearest, x @ x[at]) if len(seeds) > 1 else x @ x[at]
    c = np.stack(seeds)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = _unit(np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
        if np.allclose(new, c, atol=1e-5):
            break
        c = new
    return c


def floors(text: pa.Array, centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """For each of LENGTHS the least cosine of a text of that many bytes; where no text of the sample is as long, that of the length before."""
    out, rows = np.zeros(len(LENGTHS)), text.to_pylist()
    for i, n in enumerate(LENGTHS):
        cut = [t[:n] for t in rows if len(t) >= n]
        cos = np.concatenate([(weighted(v, idf) @ centroids.T).max(axis=1) for v in vectors(pa.array(cut, pa.binary()), len(idf))]) if cut and len(centroids) else np.zeros(0)
        out[i] = SLACK * np.quantile(cos, QUANTILE) if len(cos) else out[i - 1] if i else 0.0
    return out


def held_out(fold: int = 3) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % fold == 1


class Model:
    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray, min_cosine: float, floor: np.ndarray | None = None):
        self.langs, self.centroids, self.idf, self.min_cosine = langs, centroids, idf, min_cosine
        self.floor = np.zeros((len(langs), len(LENGTHS))) if floor is None else floor  # by centroid

    def predictor(self):
        """A column function (text as binary, has a letter) → struct<lang, score, rejected>."""
        langs, centroids, idf, least = np.array([*self.langs, "und"]), self.centroids.T.astype(np.float32).copy(), self.idf, self.min_cosine
        floor = np.pad(np.maximum(self.floor, least), ((0, 1), (1, 0)), constant_values=least)  # a text shorter than all lengths; und

        @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
        def predict(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            _frame.one_blas_thread()
            for text, letter in parts:
                has = letter.fill_null(False).to_numpy(zero_copy_only=False)
                best, score = np.full(len(text), len(langs) - 1), np.zeros(len(text))
                if centroids.shape[1]:
                    at = 0
                    for counts in vectors(text, len(idf)):
                        cos = weighted(counts, idf) @ centroids
                        best[at : at + len(cos)] = np.argmax(cos, axis=1)
                        score[at : at + len(cos)] = cos.max(axis=1)
                        at += len(cos)
                best[~has] = len(langs) - 1
                score = np.where(has, np.clip(score, 0, 1), 0.0)
                size = np.searchsorted(LENGTHS, np.diff(_text.column(text)[0]), "right")
                yield pa.StructArray.from_arrays([pa.array(langs[best].tolist(), pa.string()), pa.array(score), pa.array((best == len(langs) - 1) | (score < floor[best, size]))], ["lang", "score", "rejected"])

        return lambda text: predict(text.cast("binary"), text.rlike(r"\p{L}"))


def train(docs: DataFrame, dims: int = 4096, centroids: int = 4, sample_per_lang: int = 800, min_cosine: float = 0.05, fold: int = 3) -> Model:
    """Learn from the rows of docs (doc_id, text, lang) that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(fold)).select("doc_id", F.col("text").cast("binary").alias("text"), "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        langs: dict[str, int] = {}
        for b in batches:
            for counts in vectors(b.column("text"), dims):
                total += (counts > 0).sum(axis=0)
                n += len(counts)
            for x in b.column("lang").value_counts().to_pylist():
                langs[x["values"]] = langs.get(x["values"], 0) + x["counts"]
        yield pa.record_batch({"feature": pa.array(np.arange(-1, dims), pa.int32()), "lang": pa.nulls(dims + 1, pa.string()), "n": pa.array(np.concatenate([[n], total]))})
        yield pa.record_batch({"feature": pa.nulls(len(langs), pa.int32()), "lang": pa.array(list(langs), pa.string()), "n": pa.array(list(langs.values()), pa.int64())})

    sums = rows.select("text", "lang").mapInArrow(frequencies, "feature int, lang string, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(dims + 1)
    for r in sums:
        if r.feature is not None:
            df[r.feature + 1] = r.n
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)
    sizes = {r.lang: r.n for r in sums if r.lang is not None}
    if not sizes:
        return Model([], np.zeros((0, dims), np.float32), idf, min_cosine)
    # Twice the wanted sample by hash, then exactly the smallest hashes of it: no task sorts a language.
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, 2 * sample_per_lang / n))])
    order = F.xxhash64("doc_id")
    near = rows.where(F.pmod(order, F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).withColumn("order", order)

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        _frame.one_blas_thread()
        pick = np.argsort(table.column("order").to_numpy(), kind="stable")[:sample_per_lang]
        text = table.column("text").take(pa.array(np.sort(pick))).combine_chunks()
        x = np.concatenate([weighted(v, idf) for v in vectors(text, dims)])
        c = clustered(x[np.linalg.norm(x, axis=1) > 0], centroids) if x.any() else x[:0]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(c), pa.string()), "centroid": pa.array([v.tobytes() for v in c.astype(np.float32)], pa.binary()), "floor": pa.array([floors(text, c, idf).tolist()] * len(c), pa.list_(pa.float64()))})

    found = sorted(near.groupBy("lang").applyInArrow(fit, "lang string, centroid binary, floor array<double>").collect(), key=lambda r: (r.lang, r.centroid))
    return Model([r.lang for r in found], np.array([np.frombuffer(r.centroid, np.float32) for r in found]).reshape(len(found), dims), idf, min_cosine, np.array([r.floor for r in found]).reshape(len(found), len(LENGTHS)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of docs."""
    out = docs.select("doc_id", held_out().alias("held_out"), model.predictor()(F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is identified, with their own columns."""
    return docs.withColumn("__langid", model.predictor()(F.col("text"))).where("not __langid.rejected").drop("__langid")
