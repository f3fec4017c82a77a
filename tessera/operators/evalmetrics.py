"""Retrieval metrics from ranked predictions and truths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def at_k(predictions: DataFrame, truths: DataFrame, k: int) -> DataFrame:
    """Per query of truths (query_id, item, relevance): recall, precision, mrr and ndcg at k of predictions (query_id, rank from 1, item).

    A truth counts once, for its best rank; precision divides by k even if fewer are predicted."""
    first = predictions.where(F.col("rank") <= k).groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    found = truths.join(first, ["query_id", "item"], "left")
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance"), "item"))
    gain = lambda rank: F.col("relevance") / F.log2(rank + 1)
    sums = found.withColumn("ideal", ideal).groupBy("query_id").agg(
        F.count("rank").alias("hits"), F.count("*").alias("n"), F.min("rank").alias("best"), F.sum(F.when(F.col("rank").isNotNull(), gain(F.col("rank"))).otherwise(0.0)).alias("dcg"), F.sum(F.when(F.col("ideal") <= k, gain(F.col("ideal"))).otherwise(0.0)).alias("idcg")
    )
    return sums.select("query_id", (F.col("hits") / F.col("n")).alias("recall"), (F.col("hits") / k).alias("precision"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"), F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))
