"""Lifecycle, visibility, pages, exports and vocabularies of cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import constants as C
from cardloom.functions.text import strip


def status(archived: Column, stated: Column, superseded_by: Column) -> Column:
    """One lifecycle state: deleted before superseded before archived before active; a state that is none of these is unknown."""
    s = F.lower(strip(F.coalesce(stated, F.lit(""))))
    return (
        F.when(s == "deleted", "deleted")
        .when((s == "superseded") | (strip(F.coalesce(superseded_by, F.lit(""))) != ""), "superseded")
        .when((s == "archived") | F.coalesce(archived, F.lit(False)), "archived")
        .when(s.isin("", "active"), "active")
        .otherwise("unknown")
    )


def with_status(cards: DataFrame) -> DataFrame:
    return cards.withColumn("state", status(F.col("archived"), F.col("status"), F.col("superseded_by")))


def scoped(cards: DataFrame, mounts: list[str], states: list[str] = ["active"]) -> DataFrame:  # noqa: B006
    """Cards on the given mounts (a missing mount is agent-private; no mounts means that one) in the given states; unknown never."""
    return with_status(cards).filter(F.coalesce(F.col("mount"), F.lit("agent-private")).isin(*(mounts or ["agent-private"])) & F.col("state").isin(*states))


def page(cards: DataFrame, cursors: DataFrame, limit: int = C.PAGE_DEFAULT, scope: str = "owner") -> DataFrame:
    """One page per scope after its cursor (scope, cursor): ids above it, or from the first if the cursor's card is gone.

    has_more tells whether a card follows the page.
    """
    limit = max(1, min(C.PAGE_MOST, limit))
    known = cards.join(cursors.withColumnRenamed("cursor", "id"), [scope, "id"], "left_semi").select(scope, F.col("id").alias("after"))
    rows = cards.join(known, scope, "left").filter(F.col("after").isNull() | (F.col("id") > F.col("after")))
    n = F.row_number().over(Window.partitionBy(scope).orderBy("id"))
    rows = rows.withColumn("n", n).filter(F.col("n") <= limit + 1)
    more = F.max("n").over(Window.partitionBy(scope)) > limit
    return rows.withColumn("has_more", more).filter(F.col("n") <= limit).drop("after").withColumn("n", F.col("n").cast("long"))


def export_counts(cards: DataFrame, *by: str) -> DataFrame:
    c = with_status(cards)
    return c.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("state") == "archived").alias("archived"), F.count_if(F.col("state") == "superseded").alias("superseded"))


def vocabulary(names: DataFrame, limit: int, joiner: str = "、") -> DataFrame:
    """names: scope, name, place. One line of the distinct non-blank names per scope, the first seen first, at most `limit` of them."""
    first = names.withColumn("name", strip(F.col("name"))).filter("name <> ''").groupBy("scope", "name").agg(F.min("place").alias("place"))
    n = F.row_number().over(Window.partitionBy("scope").orderBy("place", "name"))
    kept = first.withColumn("n", n).filter(F.col("n") <= limit)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), joiner)
    return kept.groupBy("scope").agg(line.alias("names"), F.count("*").alias("n"))
