"""Vector similarity and reciprocal-rank fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import constants as C


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, within -1 and 1. Vectors must be of one size, finite and not zero: anything else raises."""
    bad = a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    value = dot(a, b) / norm
    wrong = bad | F.isnan(value) | F.coalesce(norm == 0, F.lit(True))
    return F.when(wrong, F.raise_error(F.lit("vectors must be of one size, finite and not zero")).cast("double")).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))


#: Vectors of a scope are cut into blocks of so many, queries of a scope into blocks of at most so many.
VECTOR_BLOCK, QUERY_BLOCK = 50_000, 1_000


def vector_top(queries: DataFrame, vectors: DataFrame, limit: int | None, min_cosine: float, scope: str | None = None) -> DataFrame:
    """Nearest vectors of each query: (qid, id, rank, cosine), at least `min_cosine`, the query itself left out.

    queries: qid, vector; vectors: id, vector; both with `scope`, if given. A stated set of queries against all rows of their scope, in
    blocks: each block of queries meets each block of vectors in one matrix product, and only what reaches `min_cosine`, and of that the
    best `limit` of a block, leaves the task. Vectors must be of one size, finite and not zero: anything else raises.
    """
    key = (F.col(scope) if scope else F.lit("")).alias("scope_")
    asked, held = queries.select(key, F.col("qid").alias("id_"), "vector"), vectors.select(key, F.col("id").alias("id_"), "vector")
    parts = lambda df, size, name: df.groupBy("scope_").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    grid = parts(asked, QUERY_BLOCK, "nq_").join(parts(held, VECTOR_BLOCK, "nv_"), "scope_")
    own = lambda n: F.pmod(F.xxhash64("id_"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.join(grid, "scope_").withColumn("q_", own("nq_")).withColumn("v_", every("nv_")).drop("nq_", "nv_")
    held = held.join(grid, "scope_").withColumn("v_", own("nv_")).withColumn("q_", every("nq_")).drop("nq_", "nv_")
    held = held.select(*(F.col(c).alias(c) for c in held.columns))  # columns of its own, should both sides come from one table
    kinds = dict(queries.dtypes)["qid"], dict(vectors.dtypes)["id"]

    def nearest(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"qid": [], "id": [], "cosine": []})
        a, b = (_unit(x["vector"]) for x in (q, v))
        if a.shape[1] != b.shape[1]:
            raise ValueError("vectors must be of one size, finite and not zero")
        near = np.round(np.clip(a @ b.T, -1, 1), 4)
        near[q["id_"].to_numpy()[:, None] == v["id_"].to_numpy()[None, :]] = -2
        if limit is not None and near.shape[1] > 4 * limit:
            near = np.where(near >= np.partition(near, -limit, axis=1)[:, -limit][:, None], near, -2)
        i, j = np.nonzero(near >= max(min_cosine, -1))
        return pd.DataFrame({"qid": q["id_"].to_numpy()[i], "id": v["id_"].to_numpy()[j], "cosine": near[i, j]})

    pairs = asked.select("scope_", "q_", "v_", "id_", "vector").groupBy("scope_", "q_", "v_").cogroup(held.groupBy("scope_", "q_", "v_")).applyInPandas(nearest, f"qid {kinds[0]}, id {kinds[1]}, cosine double")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cosine"), F.asc("id"))))
    kept = pairs if limit is None else pairs.filter(F.col("rank") <= limit)
    return kept.select("qid", "id", F.col("rank").cast("long").alias("rank"), "cosine")


def _unit(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of length one."""
    if vectors.isna().any() or len(sizes := set(map(len, vectors))) != 1 or 0 in sizes:
        raise ValueError("vectors must be of one size, finite and not zero")
    x = np.stack(vectors.to_numpy()).astype(float)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    if not np.isfinite(x).all() or not norm.all():
        raise ValueError("vectors must be of one size, finite and not zero")
    return x / norm


def fuse(lexical: DataFrame, vector: DataFrame, k: int = C.RRF_K, vector_weight: float = C.VECTOR_WEIGHT, lexical_weight: float = C.LEXICAL_WEIGHT) -> DataFrame:
    """Weighted reciprocal-rank fusion of two lanes (qid, id, rank): an id of either lane is a candidate; a missing lane adds 0.

    A lane of weight 0 is off: it brings no candidates either.
    """
    lexical, vector = (lane if weight > 0 else lane.limit(0) for lane, weight in ((lexical, lexical_weight), (vector, vector_weight)))
    lanes = lexical.select("qid", "id", F.col("rank").alias("lexical_rank")).join(vector.select("qid", "id", F.col("rank").alias("vector_rank")), ["qid", "id"], "full")
    return scored(lanes, k, vector_weight, lexical_weight)


def scored(lanes: DataFrame, k: int = C.RRF_K, vector_weight: float = C.VECTOR_WEIGHT, lexical_weight: float = C.LEXICAL_WEIGHT) -> DataFrame:
    """Score and rank of candidates with their ranks in both lanes (qid, id, lexical_rank, vector_rank)."""
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    fused = F.round(part(vector_weight, "vector_rank") + part(lexical_weight, "lexical_rank"), 6)
    lanes = lanes.withColumn("score", fused)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    return lanes.withColumn("rank", F.row_number().over(order).cast("long"))


def lane_reason(fused: DataFrame) -> DataFrame:
    """For each candidate, by which lanes it came."""
    both = F.col("lexical_rank").isNotNull() & F.col("vector_rank").isNotNull()
    return fused.withColumn("reason", F.when(both, "both").when(F.col("vector_rank").isNotNull(), "vector_only").otherwise("lexical_only"))
