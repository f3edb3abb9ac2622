"""Resumable import of material: what is left, what a batch is, and the candidates that batches bring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import constants as C
from cardloom.functions.text import dedupe_key
from cardloom.operators import budgets


def plan(documents: DataFrame, size: int = C.BATCH_CHARS) -> DataFrame:
    """documents: doc_id, text. Batches (scope = doc_id, place, start, text, batch_key) in the order of the text.

    A key holds offset and content: changed material has new keys, unchanged material its old ones.
    """
    parts = budgets.chunks(documents, size).select(F.col("doc_id").alias("scope"), F.col("part").alias("place"), F.col("chunk").alias("text"))
    return budgets.offsets(parts)


def remaining(batches: DataFrame, done: DataFrame) -> DataFrame:
    """The batches whose key has no receipt yet (done: batch_key)."""
    return batches.join(done.select("batch_key").distinct(), "batch_key", "left_anti")


def next_batch(batches: DataFrame, done: DataFrame) -> DataFrame:
    """Per document the first batch that is not done: batches of one document go in order, those of different documents do not wait."""
    left = remaining(batches, done)
    first = left.groupBy("scope").agg(F.min_by(F.struct("place", "start", "text", "batch_key"), "place").alias("b"))
    return first.select("scope", "b.*")


def estimate(batches: DataFrame, done: DataFrame) -> DataFrame:
    """Per document: batches and characters that are left, and percent done."""
    flagged = batches.join(done.select("batch_key").distinct().withColumn("is_done", F.lit(True)), "batch_key", "left")
    is_done = F.coalesce("is_done", F.lit(False))
    return flagged.groupBy("scope").agg(
        F.count_if(~is_done).alias("batches_left"), F.coalesce(F.sum(F.when(~is_done, F.length("text"))), F.lit(0)).alias("chars_left"), F.floor(F.count_if(is_done) * 100 / F.count("*")).cast("int").alias("percent")
    )


def candidates(found: DataFrame, most: int = C.MOST_CANDIDATES) -> DataFrame:
    """found: scope, batch, place, summary. The first of each summary (letter case and signs aside) per scope, at most `most`."""
    return budgets.first_wins(found.withColumn("key", dedupe_key(F.col("summary"))).filter("key <> ''"), "key", ["batch", "place"], "scope", most)


def index_pick(ranked: DataFrame, important: DataFrame, limit: int) -> DataFrame:
    """(qid, id, place): three quarters of an index by relevance, the rest by importance, gaps filled by whichever is left.

    ranked: qid, id, rank; important: qid, id, w, the `limit` weightiest candidates of each query (all, if there are fewer): with these
    there is enough for every place, so that no query meets the rest of its candidates.
    """
    share = max(1, limit * 3 // 4)
    both = ranked.select("qid", "id", "rank").join(important.select("qid", "id", "w"), ["qid", "id"], "full")
    step: Column = F.when(F.col("rank") <= share, 0).when(F.col("w").isNotNull(), 1).otherwise(2)
    order = F.row_number().over(Window.partitionBy("qid").orderBy(step, F.when(step == 1, F.col("w")).otherwise(F.col("rank")), "id"))
    return both.withColumn("place", order.cast("long")).filter(F.col("place") <= limit).select("qid", "id", "place")
