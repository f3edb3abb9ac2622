"""Neighbours one hop away: anchors, superseded cards, cards on the same thread."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import constants as C
from cardloom.functions.text import collapse


def links(values: Column) -> Column:
    """Distinct non-empty links of at most 160 characters (longer ones dropped, not cut), the first 20."""
    kept = F.filter(F.coalesce(values, F.expr("cast(array() as array<string>)")), lambda v: v.isNotNull() & (F.length(v).between(1, C.LINK_CHARS)))
    return F.slice(F.array_distinct(kept), 1, C.LINKS_PER_FIELD)


def one_hop(sources: DataFrame, candidates: DataFrame, cap: int = C.RELATED_CAP) -> DataFrame:
    """(set_id, id, source_id, relation, summary, rank) for each set of sources.

    sources: set_id, scope, and a card's columns; candidates: scope and a card's columns, of the same scopes. Per source and candidate
    an anchor counts before supersedes before a shared thread; per candidate, an explicit link before a thread, then the smaller
    source id, then the name of the relation. Retired candidates come only by an explicit link, and only if superseded. At most `cap`
    per set, explicit ones first, then by id. Sources themselves and cards without summary never come.
    """
    scope = F.col("scope")
    retired = F.coalesce(F.col("archived"), F.lit(False)) | F.lower(F.coalesce("status", F.lit(""))).isin("archived", "superseded", "deleted") | (F.trim(F.coalesce("superseded_by", F.lit(""))) != "")
    told = candidates.withColumns({"retired": retired, "line": F.substring(collapse(F.coalesce("summary", F.lit(""))), 1, C.SUMMARY_CHARS)}).filter("line <> ''")
    told = told.select(scope, "id", "retired", "line", F.coalesce("status", F.lit("active")).alias("state"), links(F.col("threads")).alias("threads"))
    s = sources.select("set_id", scope, F.col("id").alias("source_id"), links(F.col("anchor_memory_ids")).alias("a"), links(F.col("supersedes")).alias("s"), links(F.col("threads")).alias("t"))

    def explicit(column: str, relation: str, strength: int) -> DataFrame:
        ids = s.select("set_id", "scope", "source_id", F.explode(column).alias("id"))
        return ids.join(told.drop("threads"), ["scope", "id"]).withColumns({"relation": F.lit(relation), "strength": F.lit(strength)})

    by_thread = s.select("set_id", "scope", "source_id", F.explode("t").alias("thread")).join(told.withColumn("thread", F.explode("threads")).drop("threads"), ["scope", "thread"])
    thread = by_thread.drop("thread").distinct().withColumns({"relation": F.lit("thread"), "strength": F.lit(2)})
    found = reduce(DataFrame.unionByName, [explicit("a", "anchor", 0), explicit("s", "supersedes", 1), thread])
    best = found.groupBy("set_id", "scope", "source_id", "id", "line", "retired", "state").agg(F.min(F.struct("strength", "relation")).alias("x")).withColumn("relation", F.col("x.relation"))
    direct = F.col("relation") != "thread"
    best = best.filter(~F.col("retired") | (direct & (F.col("state") == "superseded")))
    best = best.join(sources.select("set_id", F.col("id")), ["set_id", "id"], "left_anti")
    first = F.min(F.struct((~direct).cast("int").alias("far"), "source_id", "relation")).alias("y")
    each = best.groupBy("set_id", "id", "line").agg(first).select("set_id", "id", "line", "y.*")
    rank = F.row_number().over(Window.partitionBy("set_id").orderBy("far", "id"))
    return each.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= cap).select("set_id", "id", "source_id", "relation", F.col("line").alias("summary"), "rank")
