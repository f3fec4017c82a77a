"""Resharding by minimum-cost flow.

Old shards supply bytes, new shards have capacities, and a byte that leaves its shard
costs 1. The flow of least cost says how many bytes go from which old shard to which new
one. Documents move in blocks, largest first, each to the destination that still lacks
most bytes. A block is an old shard's share of a text-hash bucket, so equal texts stay
together; one above block_share of a shard is split by further bits of the text's hash,
and only a text whose copies fill more than 1 / WHOLE of all bytes is split by document.
Sums by block, a number of rows that the parameters bound, reach the driver; the documents
are placed by a broadcast join with that table.

reshard() then writes the shards: each row, with its text, goes to the task of its block
and from there to a file of its shard, so the texts are shuffled once. Of a folder that
holds the old shards rewrite() replaces only those that lose or gain rows.

Defined cases: null text has size 1 and crc32 0, like empty text; a null doc_id is placed
like any row; repeated rows take slots one after the other; an empty table gives no rows;
other columns are kept in the files, but for own ones named shard and slot.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from . import _frame

#: Copies of one text stay together up to this part of all bytes.
WHOLE = 64


def _size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def _bytes() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).cast("binary")


def min_cost_flow(nodes: int, edges: Sequence[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each edge (from, to, capacity, cost >= 0) of the largest flow of least cost: shortest augmenting paths with potentials."""
    to, room, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, capacity, price in edges:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(p)
    potential = [0] * nodes
    while True:
        far: list[float] = [float("inf")] * nodes
        via, far[source], heap = [-1] * nodes, 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                new = d + cost[e] + potential[a] - potential[to[e]]
                if room[e] and new < far[to[e]]:
                    far[to[e]], via[to[e]] = new, e
                    heapq.heappush(heap, (new, to[e]))
        if far[sink] == float("inf"):
            return [room[2 * i + 1] for i in range(len(edges))]
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, far, strict=True)]
        path, a = [], sink
        while a != source:
            path.append(via[a])
            a = to[via[a] ^ 1]
        least = min(room[e] for e in path)
        for e in path:
            room[e] -= least
            room[e ^ 1] += least


def transfers(old: Sequence[int], capacities: Sequence[int]) -> list[list[int]]:
    """Bytes from each old shard to each new one, moving the fewest; shard i stays shard i."""
    n, m = len(old), len(capacities)
    edges = [(0, 1 + i, b, 0) for i, b in enumerate(old)]
    edges += [(1 + i, 1 + n + j, b, int(i != j)) for i, b in enumerate(old) for j in range(m)]
    edges += [(1 + n + j, 1 + n + m, c, 0) for j, c in enumerate(capacities)]
    flow = min_cost_flow(n + m + 2, edges, 0, n + m + 1)[n : n + n * m]
    return [flow[i * m : (i + 1) * m] for i in range(n)]


def dealt(blocks: Sequence[tuple], quotas: list[list[int]]) -> dict[tuple, int]:
    """The new shard of each block (key, whose first is the old shard, and bytes)."""
    left, out = [list(q) for q in quotas], {}
    for key, size in sorted(blocks, key=lambda b: (-b[1], b[0])):
        own = left[key[0]]
        j = max(range(len(own)), key=lambda j: (own[j], j == key[0], -j))
        own[j] -= size
        out[key] = j
    return out


def _keyed(docs: DataFrame, old: Column, blocks: int) -> DataFrame:
    """The rows of docs as a struct beside what places them."""
    text = _bytes()
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), _size().alias("size"), F.crc32(text).alias("crc"), old.cast("int").alias("old_shard"), F.xxhash64(text).alias("hash")).withColumn("block", F.pmod("hash", F.lit(blocks)).cast("int"))


class Plan:
    """Where the rows of docs go: the table of blocks, and the columns by which a row finds its block."""

    def __init__(self, docs: DataFrame, shards: int = 8, old_shards: int = 5, old: Column | None = None, capacities: Sequence[int] | None = None, blocks: int = 1024, block_share: float = 1 / 256):
        """old: the shard a row is in (0 to old_shards - 1; default: by the text's crc32); capacities: bytes of the new shards (default: equal)."""
        old = F.pmod(F.crc32(_bytes()), F.lit(old_shards)) if old is None else old
        self.spark, self.rows = docs.sparkSession, _keyed(docs, old, blocks)
        light = _frame.stored(self.rows.drop("row"))
        sums = light.groupBy("old_shard", "block").agg(F.sum("size").alias("n")).collect()
        total = sum(r.n for r in sums)
        capacities = capacities or [total // shards + (j < total % shards) for j in range(shards)]
        if sum(capacities) < total:
            raise ValueError("the new shards have less room than the old ones hold")
        self.shards = max(len(capacities), old_shards)
        limit = max(1, int(total * block_share / len(capacities)))
        self.split = [(r.old_shard, r.block, -(-r.n // limit)) for r in sums if r.n > limit]
        self.hot: list[tuple[int, int]] = []
        whole = max(limit, total // WHOLE)
        if any(r.n > whole for r in sums):  # fewer than WHOLE texts can be that large
            found = self._subbed(light, []).groupBy("old_shard", "block", "sub", "hash").agg(F.sum("size").alias("n")).where(F.col("n") > whole).select("hash", "n").collect()
            self.hot = sorted((r.hash, -(-r.n // limit)) for r in found)
        units = self._subbed(light, self.hot).groupBy("old_shard", "block", "sub", "part").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect()
        held = [0] * old_shards
        for r in units:
            held[r.old_shard] += r.n
        key = lambda r: (r.old_shard, r.block, r.sub, r.part)
        self.transfers = transfers(held, capacities)
        to = dealt([(key(r), r.n) for r in units], self.transfers)
        at, self.placed = [0] * len(capacities), []
        self.moved = sum(r.n for r in units if to[key(r)] != r.old_shard)
        for r in sorted(units, key=key):
            self.placed.append((*key(r), to[key(r)], at[to[key(r)]]))
            at[to[key(r)]] += r.rows
        self.affected = sorted({s for r in units if to[key(r)] != r.old_shard for s in (r.old_shard, to[key(r)])})

    def _subbed(self, rows: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
        """rows with the part of a split block (sub) and that of a text too large for one (part)."""
        if self.split:
            parts = self.spark.createDataFrame(self.split, "old_shard int, block int, parts long")
            rows = rows.join(F.broadcast(parts), ["old_shard", "block"], "left")
            rows = rows.withColumn("sub", F.coalesce(F.pmod(F.xxhash64("hash"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        else:
            rows = rows.withColumn("sub", F.lit(0))
        part = F.lit(0)
        for h, n in hot:
            part = F.when(F.col("hash") == F.lit(h), F.pmod(F.xxhash64("id", "crc"), F.lit(n))).otherwise(part)
        return rows.withColumn("part", part.cast("int"))

    def apply(self) -> DataFrame:
        """Per row: row (all of its columns), size, crc, old_shard, shard, slot."""
        table = self.spark.createDataFrame(self.placed, "old_shard int, block int, sub int, part int, shard int, first long")
        unit = ["old_shard", "block", "sub", "part"]
        rows = self._subbed(self.rows, self.hot).withColumn("nth", F.row_number().over(Window.partitionBy(*unit).orderBy("id", "crc", "size")) - 1)
        return rows.join(F.broadcast(table), unit).select("row", "id", "size", "crc", "old_shard", "shard", (F.col("first") + F.col("nth")).alias("slot"))


def plan(docs: DataFrame, **kwargs) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, size, text_crc32, old_shard, shard, slot; for kwargs see Plan."""
    return Plan(docs, **kwargs).apply().select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "old_shard", "shard", "slot")


def _written(plan: Plan, folder: str, only: Sequence[int] | None = None) -> None:
    """The rows of (only these) shards, with their slots, under folder, as shard=<n>; the folders of other shards stay as they are."""
    rows = plan.apply() if only is None else plan.apply().where(F.col("shard").isin(list(only)))
    own = [F.col(f"row.`{c}`") for c in plan.rows.schema["row"].dataType.names if c not in ("shard", "slot")]
    rows.select(*own, "slot", "shard").write.partitionBy("shard").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def _read(plan: Plan, folder: str) -> DataFrame:
    """The written rows; without any there is no schema to find."""
    own = [f for f in plan.rows.schema["row"].dataType.fields if f.name not in ("shard", "slot")]
    schema = StructType([*own, StructField("slot", LongType()), StructField("shard", IntegerType())])
    return plan.spark.read.schema(schema).parquet(folder)


def reshard(docs: DataFrame, folder: str, **kwargs) -> DataFrame:
    """Write docs (doc_id, text) to their new shards under folder and read them back: all columns of docs, slot and shard."""
    plan = Plan(docs, **kwargs)
    _written(plan, folder)
    return _read(plan, folder)


def listing(rows: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of rows in shards."""
    return rows.select("doc_id", _size().alias("size"), F.crc32(_bytes()).alias("text_crc32"), F.col("shard").cast("int").alias("shard"), "slot")


def rewrite(docs: DataFrame, folder: str, **kwargs) -> list[int]:
    """docs are the rows of the shards under folder (shard=<n>, old=F.col("shard") in kwargs): write those that lose or gain rows anew.

    Returns their numbers. The files of other shards stay, with the slots they have there."""
    plan = Plan(docs, **kwargs)
    beside = f"{folder.rstrip('/')}-{uuid.uuid4().hex}"
    _written(plan, beside, plan.affected)  # whole before anything of folder is replaced, as docs may be read from there
    spark, path = plan.spark, plan.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in plan.affected:
        files.delete(path(f"{folder}/shard={s}"), True)
        if files.exists(path(f"{beside}/shard={s}")):
            files.rename(path(f"{beside}/shard={s}"), path(f"{folder}/shard={s}"))
    files.delete(path(beside), True)
    return plan.affected
