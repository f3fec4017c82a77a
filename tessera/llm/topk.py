"""Exact top-k inner products by columnar branch-and-bound.

Vectors of integers are kept in blocks in vertical layout: dimension by dimension, the
values of all candidates. For each query the scores are accumulated a few dimensions at a
time, the heaviest first. What the rest can still add is at most the product of the two
remaining norms (Cauchy-Schwarz), so a candidate whose score plus that bound is below the
k-th best score minus its bound cannot be among the best: it goes, and the survivors are
compacted before the next dimensions are read.

Queries are cut into blocks as well; blocks hold bounded bytes, so each pair of blocks is
a task of bounded memory, however long the vectors are. The
best of each pair are merged by a window with a limit per group. Neither side is
broadcast, no pair of vectors leaves a task unless it is among its k best.

Defined cases: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as padded with zeros; a null vec_id is never a query and is last
among ties; rows that share a vec_id are different candidates, and each is a query of its
own; fewer than k others give them all; scores are exact (pairs whose norms allow a sum
beyond double's 53 bits are computed in limbs of 20 bits, and a sum beyond 64 bits is cut
to the nearest long, where such ones tie).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _frame

#: Dimensions added between two rounds of compaction.
STEP = 16
NO_ID = np.iinfo(np.int64).max


#: Sums of products below this are exact in double.
EXACT = 2.0**53
LIMB, LIMBS = 20, 4


def best(queries: np.ndarray, own: np.ndarray, columns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For queries (n, dims) and candidates (dims, m) of whole numbers: query, candidate and score of the k best of each.

    own[i] is the candidate that query i is itself, or -1; ties go to the smaller candidate."""
    order = np.argsort(-(columns.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    c, q = columns[order].astype(np.float64), queries[:, order].astype(np.float64)
    cuts = list(range(0, len(c), STEP))
    rest = lambda x: np.sqrt(np.cumsum((x**2)[::-1], axis=0)[::-1])
    c_rest, q_rest = rest(c), rest(q.T)
    # by Cauchy-Schwarz every partial sum of a pair stays below the product of its norms
    wide = (q_rest[0] * c_rest[0].max() * (1 + 1e-9) >= EXACT) if c.size and len(q) else np.zeros(len(q), bool)
    limbs = _limbs(columns) if wide.any() else None
    found = []
    head = q[:, :STEP] @ c[:STEP]
    for i in range(len(q)):
        alive, score = np.arange(c.shape[1]), head[i]
        if own[i] >= 0:
            alive = np.delete(alive, own[i])
            score = score[alive]
        far = alive[:0]
        if wide[i]:
            large = q_rest[0, i] * c_rest[0, alive] * (1 + 1e-9) >= EXACT
            far, alive, score = alive[large], alive[~large], score[~large]
        for lo in cuts[1:]:
            if len(alive) > k:
                bound = q_rest[lo, i] * c_rest[lo, alive] * (1 + 1e-9) + 1e-6
                least = np.partition(score - bound, len(alive) - k)[len(alive) - k]
                keep = np.flatnonzero(score + bound >= least)
                alive, score = alive[keep], score[keep]
            score = score + q[i, lo : lo + STEP] @ c[lo : lo + STEP, alive]
        if len(alive) > k:
            least = np.partition(score, len(alive) - k)[len(alive) - k]
            keep = np.flatnonzero(score >= least)
            alive, score = alive[keep], score[keep]
        pick = np.lexsort((alive, -score))[:k]
        alive, score = alive[pick], score[pick].astype(np.int64)
        if len(far):
            low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
            both = score.tolist() + [max(low, min(high, x)) for x in _limb_dots(queries[i], limbs[:, :, far])]
            both = sorted(zip(both, [*alive.tolist(), *far.tolist()], strict=True), key=lambda x: (-x[0], x[1]))[:k]
            score, alive = (np.array(x, np.int64) for x in zip(*both, strict=True))
        found.append((np.full(len(alive), i), alive, score))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _limbs(x: np.ndarray) -> np.ndarray:
    """(limbs, *x.shape): x is the sum of the limbs times 2**(LIMB * n); all but the last are in [0, 2**LIMB)."""
    return np.stack([(x >> (LIMB * n)) & ((1 << LIMB) - 1) if n < LIMBS - 1 else x >> (LIMB * n) for n in range(LIMBS)])


def _limb_dots(query: np.ndarray, limbs: np.ndarray) -> list[int]:
    """Exact products of a query with candidates, as Python integers: limb products fit a long for any 2**23 dimensions."""
    q, total = _limbs(query), 0
    for shift in range(2 * LIMBS - 1):
        part = sum(q[n] @ limbs[shift - n] for n in range(LIMBS) if 0 <= shift - n < LIMBS)
        total = total + part.astype(object) * (1 << LIMB * shift)
    return list(total)


def quantised(vector: Column, scale: float) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """(dims, rows), padded with zeros."""
    flat = lists.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    size = flat.value_lengths().to_numpy()
    dims = int(size.max()) if len(size) else 0
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims)[None, :] < size[:, None]] = flat.flatten().to_numpy()
    return np.ascontiguousarray(out.T)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, candidate_block: int = 8192, query_block: int = 2048, block_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k best others of every row of vectors (vec_id, embedding) for which is_query holds.

    Blocks have candidate_block and query_block rows, or fewer if those of the longest vectors are above block_bytes."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = _frame.stored(rows.withColumn("row", F.monotonically_increasing_id()))
    n, asking, dims = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    fit = max(1, block_bytes // (8 * max(1, dims or 0)))
    candidate_block, query_block = min(candidate_block, fit), min(query_block, fit)
    candidate_blocks, query_blocks = 1 + n // candidate_block, 1 + (asking or 0) // query_block
    hashed = F.xxhash64("row")
    base = rows.withColumn("c", F.pmod(hashed, F.lit(candidate_blocks)).cast("int")).withColumn("q", F.pmod(F.xxhash64(hashed), F.lit(query_blocks)).cast("int"))

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("row").to_numpy(), table.column("vec_id").fill_null(NO_ID).to_numpy()))
        table = table.take(pa.array(order))
        m = _matrix(table.column("v"))
        ids = table.column("vec_id").fill_null(NO_ID).to_numpy()
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "dims": pa.array([len(m)], pa.int32()), "rows": [table.column("row").to_numpy().astype(np.int64).tobytes()], "ids": [ids.astype(np.int64).tobytes()], "m": [m.tobytes()]})

    wire = "k int, dims int, rows binary, ids binary, m binary"
    candidates = base.groupBy("c").applyInArrow(packed, wire)
    queries = base.where("asks").groupBy("q").applyInArrow(packed, wire)
    # each block meets each block of the other side under a key of its own
    candidates = candidates.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumnRenamed("k", "c")
    queries = queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(candidate_blocks - 1)))).withColumnRenamed("k", "q")

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        _frame.one_blas_thread()
        out = {"query_row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "row": pa.int64(), "score": pa.int64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in out.items()})
        side = lambda t: (np.frombuffer(t.column("rows")[0].as_py(), np.int64), np.frombuffer(t.column("ids")[0].as_py(), np.int64), np.frombuffer(t.column("m")[0].as_py(), np.int64).reshape(t.column("dims")[0].as_py(), len(t.column("rows")[0].as_py()) // 8))
        (c_rows, c_ids, c), (q_rows, q_ids, q) = side(left), side(right)
        dims = max(len(c), len(q), 1)
        c, q = (np.concatenate([x, np.zeros((dims - len(x), x.shape[1]), np.int64)]) for x in (c, q))
        place = np.argsort(c_rows)
        at = np.minimum(np.searchsorted(c_rows, q_rows, sorter=place), len(c_rows) - 1)
        own = np.where(c_rows[place[at]] == q_rows, place[at], -1)
        i, j, score = best(q.T, own, c, k)
        return pa.table({"query_row": q_rows[i], "query_id": q_ids[i], "vec_id": pa.array(c_ids[j], mask=c_ids[j] == NO_ID), "row": c_rows[j], "score": score})

    merged = candidates.groupBy("c", "q").cogroup(queries.groupBy("c", "q")).applyInArrow(met, "query_row long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
