"""Joins that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than 1/HOT_SHARE of all rows: by counting, there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 256
#: Below so many rows a key is never worth splitting off.
HOT_ROWS = 20_000


def hot_keys(counts: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """The keys of more than 1/HOT_SHARE of the rows that `counts` counts; at most HOT_SHARE rows."""
    total = counts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("t")).first()["t"]
    return counts.filter(F.col(count) > max(HOT_ROWS, total // HOT_SHARE)).select(*keys).limit(HOT_SHARE)


def lookup(rows: DataFrame, values: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Left join of `rows` to `values` (unique by `keys`, never null in them).

    Rows of hot keys meet their value in a broadcast of at most HOT_SHARE rows; the others are shuffled and no key of theirs
    is large. No row is dropped: every row is in exactly one of the two parts.
    """
    if hot is None or hot.isEmpty():
        return rows.join(values, keys, "left")
    few = F.broadcast(values.join(F.broadcast(hot), keys, "left_semi").limit(HOT_SHARE))
    often = rows.join(F.broadcast(hot), keys, "left_semi").join(few, keys, "left")
    rest = rows.join(F.broadcast(hot), keys, "left_anti").join(values, keys, "left")
    return often.unionByName(rest)
