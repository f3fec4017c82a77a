"""Streams: windows, sessions, stateful pattern watches, incremental maintenance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERLAP = 8 << 10
MAX_WATCHES = 8


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by event time; the watermark matters on streams only."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, quiet: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): activity that ends with a quiet spell."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.session_window("ts", quiet).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def scan(tail: str, cursor: int, new: str, pattern: str, literal: bool = False) -> tuple[list[tuple[int, str]], str]:
    """Matches that end in the new text, as (offset, text), and the tail to keep. tail ends at cursor."""
    whole, base = tail + new, cursor - len(tail)
    found = [(base + m.start(), m.group()) for m in re.finditer(re.escape(pattern) if literal else pattern, whole) if base + m.end() > cursor]
    return found, whole[-OVERLAP:]


def watch(stream: DataFrame, watches: list[tuple[str, str, bool, bool]]) -> DataFrame:
    """(task_id, watch_id, offset, match) of a stream (task_id, seq, chunk).

    watches: (watch_id, pattern, is literal, once), at most eight. State per task: its tail,
    the cursor and which once-watches have fired, so a match may straddle micro-batches, what
    lies in old text only never fires, and a restart goes on from the checkpoint."""
    if len(watches) > MAX_WATCHES:
        raise ValueError(f"at most {MAX_WATCHES} watches")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tail, cursor, fired = state.get if state.exists else ("", 0, "")
        done = set(fired.split(",")) - {""}
        rows = []
        chunks = pd.concat(list(batches)).sort_values("seq")
        for new in chunks["chunk"]:
            kept = tail
            for name, pattern, literal, once in watches:
                if name in done:
                    continue
                found, kept = scan(tail, cursor, new, pattern, literal)
                for offset, match in found[:1] if once else found:
                    rows.append((key[0], name, offset, match))
                if once and found:
                    done.add(name)
            tail, cursor = (tail + new)[-OVERLAP:] if kept is tail else kept, cursor + len(new)
        state.update((tail, cursor, ",".join(sorted(done))))
        yield pd.DataFrame(rows, columns=["task_id", "watch_id", "offset", "match"])

    return stream.groupBy("task_id").applyInPandasWithState(step, "task_id string, watch_id string, offset long, match string", "tail string, cursor long, fired string", "append", "NoTimeout")


def completions(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each completion once, however often it is delivered."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["task_id"])


def refresh_graph(edges: DataFrame, dependencies: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """edges (file, …) after changed files (file, surface_changed): their edges, and those of dependents of a changed surface, come from fresh."""
    users = dependencies.join(changed.where("surface_changed").select(F.col("file").alias("dep_file")), "dep_file", "left_semi").select("file")
    stale = changed.select("file").union(users).distinct()
    return edges.join(stale, "file", "left_anti").unionByName(fresh.join(stale, "file", "left_semi"))


def retry_delay(attempt: int) -> int | None:
    """Seconds before a further attempt; none after the third failure."""
    return {1: 15, 2: 30, 3: 60}.get(attempt)


def run_all(stream: DataFrame, folder: str) -> DataFrame:
    """Drive an appending stream over what is there now into files under folder, beside its checkpoint: for batch catch-up. A second call adds what is new."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def overdue(starts: DataFrame, ends: DataFrame, now: Column, after: str = "30 seconds") -> DataFrame:
    """(task_id, ts, seconds): tasks that started (task_id, ts) longer ago than after and have not ended: one notice each."""
    running = starts.groupBy("task_id").agg(F.min("ts").alias("ts")).join(ends.select("task_id"), "task_id", "left_anti")
    return running.where(F.col("ts") <= now - F.expr(f"INTERVAL {after}")).withColumn("seconds", F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")))
