"""Who gets a seat: quotas by role and recency, then relevance; and chains of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import constants as C


def seats(eligible: DataFrame, cap: int = C.CAP, turning: int = C.QUOTAS[0][1], recent: int = C.QUOTAS[1][1], larger_id_first: bool = False) -> DataFrame:
    """eligible: qid, id, score, rank, role, occurred_ts, created_ts (unique per qid and id). The seated, with bucket and final_rank.

    First up to `turning` cards of that role, the latest first; then up to `recent` of the others by creation; the rest by rank, `cap`
    in all. Seats say who is in; the order is that of rank. One exchange on qid serves all windows.
    """
    by = Window.partitionBy("qid")
    last = F.desc("id") if larger_id_first else F.asc("id")
    df = eligible.repartition("qid")
    is_turning = F.coalesce(F.col("role") == "turning_point", F.lit(False))
    t = F.row_number().over(by.orderBy(F.desc(is_turning.cast("int")), F.desc_nulls_last("occurred_ts"), last))
    df = df.withColumn("t", is_turning & (t <= min(turning, cap)))
    df = df.withColumn("nt", F.sum(F.col("t").cast("int")).over(by))
    r = F.row_number().over(by.orderBy(F.asc(F.col("t").cast("int")), F.desc_nulls_last("created_ts"), last))
    df = df.withColumn("r", ~F.col("t") & (r <= F.least(F.lit(recent), F.lit(cap) - F.col("nt"))))
    df = df.withColumn("nr", F.sum(F.col("r").cast("int")).over(by))
    q = F.row_number().over(by.orderBy(F.asc((F.col("t") | F.col("r")).cast("int")), F.asc("rank")))
    df = df.withColumn("q", ~(F.col("t") | F.col("r")) & (q <= F.lit(cap) - F.col("nt") - F.col("nr")))
    bucket = F.when(F.col("t"), "turning_point").when(F.col("r"), "recent").when(F.col("q"), "query")
    out = df.withColumn("bucket", bucket).filter("bucket is not null")
    return out.withColumn("final_rank", F.row_number().over(by.orderBy("rank")).cast("long")).select("qid", "id", "bucket", "score", "final_rank")


def soft_seats(eligible: DataFrame, cap: int = C.CAP) -> DataFrame:
    """Seats where relevance gates every bucket: eligible as for `seats`, without rank. Quotas are soft, spare seats go to the best of the
    rest; of cards that are alike the larger id comes first."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc_nulls_last("occurred_ts"), F.desc("id"))
    return seats(eligible.withColumn("rank", F.row_number().over(order)), cap, larger_id_first=True)


def top_by(cards: DataFrame, scope: str, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` cards of each scope in an order, with their rank."""
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(*order))
    return cards.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= limit)


def chain(stages: list[tuple[str, DataFrame, int]], total: int) -> DataFrame:
    """stages: (name, rows of qid, id, rank, quota). Each stage takes its best of what earlier stages left, up to its quota; `total` in all."""
    taken: DataFrame | None = None
    for place, (name, rows, quota) in enumerate(stages):
        left = rows if taken is None else rows.join(taken.select("qid", "id"), ["qid", "id"], "left_anti")
        n = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id"))
        now = left.withColumn("n", n).filter(F.col("n") <= quota).select("qid", "id", F.lit(name).alias("stage"), F.lit(place).alias("place"), "n")
        taken = now if taken is None else taken.unionByName(now)
    position = F.row_number().over(Window.partitionBy("qid").orderBy("place", "n"))
    return taken.withColumn("position", position.cast("long")).filter(F.col("position") <= total).select("qid", "id", "stage", "position")


def sensitive_allowed(query: Column, markers: tuple[str, ...]) -> Column:
    """Whether a query asks for sensitive cards: it contains one of the markers."""
    low = F.lower(F.coalesce(query, F.lit("")))
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))
