"""Filling containers of fixed capacity by sum-of-squares packing.

Each item goes where the sum, over residual gaps, of the squared number of open containers with that gap becomes smallest. Items
are dealt out evenly to shards of about SHARD_ITEMS, each packed by one task; containers that are left with more than a small gap
are opened again and their items packed anew, in ever fewer shards, so that what sharding wastes does not grow with the data.
"""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.session import written

SHARD_ITEMS = 20_000
#: A container with a gap above this share of its capacity is opened again in the next round.
LOOSE = 0.004
_OUT = "budget string, capacity bigint, bin long, item string, part int, size bigint, gap bigint"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(container of each item, gap of each container). Sizes are from 1 to capacity; ties go to the smallest gap that fits."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_: dict[int, list[int]] = {}
    where, gaps = np.empty(len(sizes), dtype=np.int64), []
    for k, s in enumerate(map(int, sizes)):
        fits = np.flatnonzero(count[s:capacity]) + s
        best, place = (0 if s == capacity else 2 * int(count[capacity - s]) + 1), capacity
        if len(fits):
            left = fits - s
            cost = np.where(left > 0, 2 * (count[left] - count[fits]) + 2, 1 - 2 * count[fits])
            at = int(cost.argmin())
            if cost[at] <= best:
                place = int(fits[at])
        if place == capacity:
            b = len(gaps)
            gaps.append(capacity)
        else:
            b = open_[place].pop()
            count[place] -= 1
        gaps[b] = left_ = place - s
        if left_:
            open_.setdefault(left_, []).append(b)
            count[left_] += 1
        where[k] = b
    return where, np.array(gaps, dtype=np.int64)


def _pack(items: DataFrame, shards: int, largest_first: bool) -> DataFrame:
    """items: budget, capacity, item, part, size. Adds bin (unique in a budget) and gap; a shard holds about SHARD_ITEMS items."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item", "part"], ascending=[False, True, True]) if largest_first else pdf.sort_values(["order", "item", "part"])
        where, gaps = sum_of_squares(pdf["size"].to_numpy(), int(pdf["capacity"].iloc[0]))
        return pdf.assign(bin=where * shards + pdf["shard"].to_numpy(), gap=gaps[where])[["budget", "capacity", "bin", "item", "part", "size", "gap"]]

    order = F.xxhash64("item", "part")
    dealt = items.select("budget", "capacity", "item", "part", "size", order.alias("order"), F.pmod(order, F.lit(shards)).alias("shard"))
    return dealt.groupBy("budget", "shard").applyInPandas(run, _OUT)


def pack(sizes: DataFrame, budgets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pack every item of `sizes` (key, n_tokens) once for each budget (budget, capacity; a few rows).

    Result: budget, capacity, container, key, part, n_tokens, gap (left in the container). An item above the capacity is split into
    whole containers and one rest; no other is split. Items of size 0, null or less need no space: they have a null container. Keys
    must be unique (a repeated key is packed once, at its largest size). A budget without a positive capacity is left out.
    """
    kind = dict(sizes.dtypes)[key]
    items = sizes.groupBy(key).agg(F.coalesce(F.max("n_tokens"), F.lit(0)).cast("long").alias("n")).filter(F.col(key).isNotNull())
    few = budgets.select("budget", F.col("capacity").cast("long").alias("capacity")).filter("capacity > 0").distinct()
    each_budget = F.array(*[F.struct(F.lit(r.budget).alias("budget"), F.lit(r.capacity).cast("long").alias("capacity")) for r in few.collect()])
    asked = written(items.withColumn("b", F.explode(each_budget)).select("b.*", F.col(key).cast("string").alias("item"), "n"), "sizes")
    parts = F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1)).cast("int")
    each = asked.filter("n > 0").select("budget", "capacity", "item", "n", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    each = each.select("budget", "capacity", "item", "part", F.least("capacity", F.col("n") - F.col("part") * F.col("capacity")).alias("size"))
    whole = each.filter("size = capacity").select("budget", "capacity", F.concat(F.lit("w-"), "item", F.lit("-"), F.col("part").cast("string")).alias("container"), "item", "part", "size", F.lit(0).cast("long").alias("gap"))
    todo = each.filter("size < capacity")
    done: list[DataFrame] = [whole]
    most = todo.groupBy("budget").count().agg(F.max("count").alias("n")).first()["n"] or 0
    turn = 0
    while most:
        shards = math.ceil(most / SHARD_ITEMS)
        packed = written(_pack(todo, shards, largest_first=turn > 0), "packed")
        last = (shards == 1 and turn > 0) or turn > 8
        loose = F.lit(False) if last else F.col("gap") > F.col("capacity") * LOOSE
        name = F.concat(F.lit(f"{turn}-"), F.col("bin").cast("string"))
        done.append(packed.filter(~loose).select("budget", "capacity", name.alias("container"), "item", "part", "size", "gap"))
        if last:
            break
        todo = packed.filter(loose).drop("bin", "gap")
        before, most = most, todo.groupBy("budget").count().agg(F.max("count").alias("n")).first()["n"] or 0
        turn = 9 if most > 0.9 * before and shards > 1 else turn + 1
    none = asked.filter("n <= 0").select("budget", "capacity", F.lit(None).cast("string").alias("container"), "item", F.lit(0).alias("part"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("gap"))
    out = none
    for df in done:
        out = out.unionByName(df)
    return out.select("budget", "capacity", "container", F.col("item").cast(kind).alias(key), "part", F.col("size").alias("n_tokens"), "gap")


def fill(packed: DataFrame) -> DataFrame:
    """Per budget: containers, tokens, and the share of the containers' space that is used."""
    used = packed.filter("container is not null").groupBy("budget", "capacity", "container").agg(F.sum("n_tokens").alias("n"))
    return used.groupBy("budget", "capacity").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.round(F.sum("n") / (F.count("*") * F.col("capacity")), 6).alias("used"))

