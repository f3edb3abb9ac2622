"""Quality of retrieval against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(results: DataFrame, truth: DataFrame, queries: DataFrame, k: int = 5, k_mrr: int = 8, k_precision: int = 3) -> DataFrame:
    """results: qid, id, rank; truth: qid, id, label ('must', 'should' or 'must_not'); queries: qid, expect_empty.

    recall, hit, precision (of what was returned; null if nothing was), reciprocal rank, violations and false_empty per query.
    """
    need = truth.filter("label = 'must'").groupBy("qid").agg(F.count("*").alias("need"))
    joined = results.join(truth, ["qid", "id"], "left")
    good = F.col("label").isin("must", "should")
    found = joined.groupBy("qid").agg(
        F.count("*").alias("returned"),
        F.count_if((F.col("label") == "must") & (F.col("rank") <= k)).alias("got"),
        F.count_if(good & (F.col("rank") <= k_precision)).alias("good"),
        F.count_if(F.col("rank") <= k_precision).alias("shown"),
        F.min(F.when((F.col("label") == "must") & (F.col("rank") <= k_mrr), F.col("rank"))).alias("first"),
        F.count_if(F.col("label") == "must_not").alias("violations"),
    )
    df = queries.select("qid", "expect_empty").join(need, "qid", "left").join(found, "qid", "left").fillna(0, ["need", "returned", "got", "good", "shown", "violations"])
    rounded = lambda c: F.round(c, 6)
    return df.select(
        "qid",
        rounded(F.when(F.col("need") > 0, F.col("got") / F.col("need"))).alias("recall"),
        rounded(F.when(F.col("shown") > 0, F.col("good") / F.col("shown"))).alias("precision"),
        rounded(F.when(F.col("need") > 0, F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)))).alias("reciprocal_rank"),
        F.col("violations"),
        (F.col("expect_empty") & (F.col("returned") == 0)).alias("right_empty"),
        ((F.col("need") > 0) & (F.col("returned") == 0)).alias("false_empty"),
    )


def summary(each: DataFrame, *by: str) -> DataFrame:
    """Means over queries; queries without a value of a measure do not count in it."""
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return each.groupBy(*by).agg(F.count("*").alias("queries"), mean("recall"), mean("precision"), mean("reciprocal_rank"), F.sum("violations").alias("violations"), F.count_if("right_empty").alias("right_empty"), F.count_if("false_empty").alias("false_empty"))


def nearest_rank(values: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """Nearest-rank percentiles, at position round(p/100 * (n-1)), halves to even: one global sort, no collected list."""
    from cardloom.operators.ordering import numbered

    rows = numbered(values.filter(F.col(column).isNotNull()).select(column), [column])
    n = rows.agg(F.count("*").alias("n")).select("n")
    asked = values.sparkSession.createDataFrame([(p,) for p in percents], "p int").join(n)
    asked = asked.withColumn("place", F.bround(F.col("p") / 100.0 * (F.col("n") - 1), 0).cast("long"))
    return asked.join(rows, "place").select("p", F.col(column).alias("value"))


