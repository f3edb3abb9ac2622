"""BM25 and vectors fused in cells: the lanes of fusion.fuse, none of them shuffled."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cardloom.operators import fusion, hybrid, lexical
from test_cells import crowd, rows, shuffled  # noqa: F401


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(9)
    words, n = [f"w{k}" for k in range(12)], 40
    text = lambda most: " ".join(rng.choices(words, k=rng.randrange(0, most)))
    at = lambda: rng.choice([None, *(dt.datetime(2025, 1, d) for d in range(1, 4))])
    vec = lambda: rng.choice([None, 999, *range(n)] + list(range(n)) * 3)
    cards = [(o, f"{o}{k:03d}", text(9), at(), vec()) for o, m in (("a", 150), ("b", 12), ("c", 1)) for k in range(m)] + [("a", "a900", None, None, 3), (None, "n1", "w1", None, 3)]
    asks = [(f"q{k:02d}", rng.choice("aaabcd"), text(6), vec()) for k in range(60)] + [("z1", None, "w1", 1)]
    vectors = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(n)] + [(999 + 1, [1.0] * 6)]
    frame = spark.createDataFrame
    return frame(asks, "qid string, owner string, text string, vec long"), frame(cards, "owner string, id string, text string, occurred_ts timestamp, vec long"), frame(vectors, "vec long, vector array<float>")


def whole(made):
    """Both lanes ranked whole and joined."""
    q, c, v = made
    near = fusion.vector_top(q.join(v, "vec"), c.join(v, "vec"), None, 0.1, "owner")
    return fusion.lane_reason(fusion.fuse(lexical.ranked(lexical.evaluate(q, c, gated=True), c, None), near))


NAMES = ("qid", "id", "lexical_rank", "vector_rank", "score", "rank")


@pytest.mark.parametrize("blocks", [(20_000, 4_000), (20_000, 4), (17, 4), (60, 4_000)])
def test_fused_as_whole_lanes(made, monkeypatch, blocks):  # F2
    want = whole(made)
    key = lambda x: [tuple(-1 if v is None else v for v in r) for r in x]
    got = {k: sorted(key(want.filter(F.col("rank") <= k).select(*NAMES).collect())) for k in (3, 20)}
    assert max(x[2] for x in got[3]) > hybrid._depth(3)  # a place that no cell of firsts can tell
    monkeypatch.setattr(lexical, "CARD_BLOCK", blocks[0])
    monkeypatch.setattr(lexical, "ASK_BLOCK", blocks[1])
    monkeypatch.setattr(hybrid, "COSINES", 100)
    for k, rows_ in got.items():
        assert sorted(key(hybrid.fused(*made, k, 0.1).select(*NAMES).collect())) == rows_


@pytest.mark.parametrize("blocks", [(20_000, 4_000), (17, 4)])
def test_reasons_as_whole_lanes(made, monkeypatch, blocks):  # F1
    want = rows(whole(made).groupBy("reason").agg(F.count("*").alias("n")), "reason", "n")
    monkeypatch.setattr(lexical, "CARD_BLOCK", blocks[0])
    monkeypatch.setattr(lexical, "ASK_BLOCK", blocks[1])
    assert len(want) == 3 and rows(hybrid.reasons(*made, 0.1), "reason", "n") == want


def test_wrong_vectors_raise(spark, made):
    q, c, _ = made
    for bad in (None, [], [0.0], [float("nan")]):
        with pytest.raises(Exception, match="vectors must be"):
            hybrid.reasons(q, c, spark.createDataFrame([(k, bad if k == 5 else [1.0]) for k in range(40)], "vec long, vector array<float>"), 0.1).collect()


@pytest.mark.parametrize("name", ["hybrid_terminal_reason", "rrf_fusion"])
def test_lanes_are_not_shuffled(spark, crowd, data, name):  # noqa: F811
    """90,000 pairs of the lexical lane, and as many of the vector lane."""
    at = f"{crowd}/embeddings.parquet"
    spark.read.parquet(f"{data}/embeddings.parquet").withColumn("embedding", F.lit([1.0, 0.5]).cast("array<float>")).write.mode("overwrite").parquet(at)
    n, moved = shuffled(spark, lambda: entry.queries()[name](spark, crowd))
    assert n == {"hybrid_terminal_reason": 2, "rrf_fusion": 6_000}[name] and moved < 45_000
