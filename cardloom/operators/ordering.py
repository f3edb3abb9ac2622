"""A global order without a single task: rows numbered from 0 in the order of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.session import written


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `place`, the position in the order: ranges are sorted apart, and only the ranges' sizes are gathered."""
    parts = written(rows.orderBy(*order).withColumn("id_", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("id_", 33).alias("part_")
    sizes = parts.groupBy(part).agg(F.count("*").alias("n_")).orderBy("part_").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part_"], before))
        before += r["n_"]
    small = parts.sparkSession.createDataFrame(starts or [(0, 0)], "part_ bigint, start_ bigint")
    placed = parts.withColumn("part_", part).join(F.broadcast(small), "part_")
    return placed.withColumn("place", F.col("start_") + F.col("id_").bitwiseAND((1 << 33) - 1)).drop("id_", "part_", "start_")
