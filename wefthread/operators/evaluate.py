"""Retrieval evaluation: recall, reciprocal rank, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, rr) for results(query_id, rank from 1, key) and relevant(query_id, key); 0 without relevant keys or hits."""
    want = relevant.distinct()
    hits = results.where(F.col("rank") <= k).join(want, ["query_id", "key"]).groupBy("query_id").agg(F.countDistinct("key").alias("hits"), F.min("rank").alias("first"))
    sizes = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    every = results.select("query_id").union(want.select("query_id")).distinct()
    out = every.join(sizes, "query_id", "left").join(hits, "query_id", "left")
    return out.select("query_id", F.coalesce(F.col("hits") / F.col("size"), F.lit(0.0)).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def by_category(scores: DataFrame, categories: DataFrame) -> DataFrame:
    return scores.join(categories, "query_id").groupBy("category").agg(F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.count(F.lit(1)).alias("queries"))


def routing(expected: DataFrame, placed: DataFrame) -> DataFrame:
    """(query_id, accuracy): expected(query_id, key, in_process) against placed(query_id, key, in_process); absent is wrong, unannotated isn't counted."""
    e = expected.where("in_process is not null").distinct()
    ok = e.join(placed.select("query_id", "key", F.col("in_process").alias("got")), ["query_id", "key"], "left").withColumn("right", F.coalesce(F.col("got") == F.col("in_process"), F.lit(False)))
    return ok.groupBy("query_id").agg((F.count_if("right") / F.count(F.lit(1))).alias("accuracy"))
