"""BM25 by cells of queries and cards: what leaves a cell is small, and nothing is lost at the edges of blocks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cardloom.operators import curation, evidence, lexical, selection


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    at = lambda: rng.choice([None, *(dt.datetime(2025, 1, d) for d in range(1, 9))])
    cards = [(o, f"{o}{k:03d}", " ".join(rng.choices(words, k=rng.randrange(0, 12))), at(), rng.choice([None, "2025-01", "2025-02"]), rng.choice([None, "turning_point"])) for o, n in (("a", 60), ("b", 4), ("c", 1)) for k in range(n)]
    asks = [(f"q{k}", rng.choice("aaabc"), " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for k in range(40)]
    return spark.createDataFrame(asks, "qid string, owner string, text string"), spark.createDataFrame(cards, "owner string, id string, text string, occurred_ts timestamp, created_ts string, role string")


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_blocks_lose_nothing(made, monkeypatch):
    q, c = made
    whole = rows(lexical.evaluate(q, c), "qid", "id", "score", "coverage", "matched", "passed")
    ranked = {g: lexical.ranked(lexical.evaluate(q, c), c, None, gated=g) for g in (True, False)}
    seats = rows(selection.seats(ranked[True].join(c.select("id", "created_ts", "role"), "id")), "qid", "id", "bucket", "final_rank")
    want = {g: rows(ranked[g].filter("rank <= 3"), "qid", "id", "rank") for g in ranked}
    ungated = ranked[False].groupBy("qid").agg(F.count("*").alias("pairs"), F.min_by("id", "rank").alias("best"))
    first, counts = rows(ungated, "qid", "pairs", "best"), rows(lexical.evaluate(q, c).groupBy("qid", "scope").agg(F.count("*").alias("pairs"), F.count_if("passed").alias("found")), "qid", "scope", "pairs", "found")
    monkeypatch.setattr(lexical, "CARD_BLOCK", 7)
    monkeypatch.setattr(lexical, "ASK_BLOCK", 4)
    assert rows(lexical.evaluate(q, c), "qid", "id", "score", "coverage", "matched", "passed") == whole
    assert rows(lexical.evaluate(q, c, gated=True), "qid", "id") == [x[:2] for x in whole if x[-1]]
    assert {g: rows(lexical.best(q, c, 3, gated=g), "qid", "id", "rank") for g in ranked} == want
    assert rows(lexical.best_and_counts(q, c), "qid", "pairs", "best") == first
    assert rows(lexical.counted(q, c), "qid", "scope", "pairs", "found") == counts
    found, n = lexical.seatable(q, c, counts=True)
    assert rows(selection.seats(found), "qid", "id", "bucket", "final_rank") == seats and rows(n, "qid", "scope", "pairs", "found") == counts


def test_blocks_of_relevance(made, monkeypatch):
    q, c = made
    text = F.concat_ws(" ", F.regexp_replace("text", "w1", "代码今天猫咪 w1"), F.lit("memory"))
    q, c = q.withColumn("text", text), c.withColumn("text", text)
    every = evidence.relevance(q, c, passing=False).filter("score >= 0.35 and confidence in ('strong', 'medium') and reason <> 'rare_term_with_support'")  # single characters count there
    whole = rows(evidence.relevance(q, c), "qid", "id", "score", "reason")
    assert whole and {x for x in whole if x[3].endswith("phrase_match") or x[3] == "multiple_rare_terms"} == {tuple(r) for r in every.select("qid", "id", "score", "reason").collect() if r.reason.endswith("phrase_match") or r.reason == "multiple_rare_terms"}
    seats = rows(selection.soft_seats(evidence.relevance(q, c).join(c.select("id", "role", "occurred_ts", "created_ts"), "id")), "qid", "id", "bucket", "final_rank")
    monkeypatch.setattr(evidence, "CARD_BLOCK", 7)
    monkeypatch.setattr(evidence, "ASK_BLOCK", 4)
    assert rows(evidence.relevance(q, c), "qid", "id", "score", "reason") == whole
    assert rows(selection.soft_seats(evidence.passed(q, c, keep=("occurred_ts", "created_ts", "role"))), "qid", "id", "bucket", "final_rank") == seats


@pytest.fixture(scope="module")
def crowd(spark, data, tmp_path_factory):
    """300 queries and 300 cards of one owner that share a word: 90,000 pairs."""
    at = str(tmp_path_factory.mktemp("crowd"))
    c, w = (spark.read.parquet(f"{data}/{t}.parquet").limit(1) for t in ("cards", "conversations"))
    k = F.explode(F.sequence(F.lit(0), F.lit(299)))
    text = F.concat(F.lit("harbour word"), F.col("k"))
    over = {"owner": F.lit("o"), "id": F.format_string("c_%06d", "k"), "summary": text, "content": text, "status": F.lit("active"), "archived": F.lit(False), "superseded_by": F.lit(None).cast("string"), "role": F.lit("turning_point")}
    c.withColumn("k", k).withColumns(over).drop("k").write.parquet(f"{at}/cards.parquet")
    w.withColumn("k", k).withColumns({"owner": F.lit("o"), "cid": F.format_string("v%06d", "k"), "window": F.concat(F.lit("A: "), text)}).drop("k").write.parquet(f"{at}/conversations.parquet")
    return at


def shuffled(spark, df):
    """Rows that went through a shuffle while `df` was made."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (x for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))}
    before = stages()
    made = df()
    n = len(made.collect())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return n, sum(v for k, v in stages().items() if k not in before)


CROWDED = ("chain_stages", "bm25_gated", "bm25_gated_scaled", "select_quota", "injection_histogram", "bm25_topk", "import_index", "bm25_small_pool", "index_ranker", "retrieval_metrics", "metrics_by_category", "recall_by_stage", "injection_record", "small_pool_grid", "legacy_relevance", "relevant_quota")


@pytest.mark.parametrize("name", CROWDED)
def test_pairs_are_not_shuffled(spark, crowd, name):
    n, moved = shuffled(spark, lambda: entry.queries()[name](spark, crowd))
    assert n and moved < 45_000


def test_topics_are_not_shuffled(spark, crowd):
    n, moved = shuffled(spark, lambda: entry.queries()["topic_match"](spark, crowd))
    assert n == 90_000 and moved < 45_000


def test_blocks_of_topics(spark, monkeypatch):
    rng = random.Random(5)
    words = ["bicycle", "motorbicycles", "tea", "steam", "code", "猫", "猫咪不吃饭", "邻居的猫咪", "喜欢", "Straße_9", "a b"]
    text = lambda n: rng.choice([" ", "", "、"]).join(rng.choices(words, k=n))
    asks, cards = ([(f"{p}{k:03d}", rng.choice("aab"), text(n)) for k in range(60)] for p, n in (("q", 1), ("c", 2)))
    q = spark.createDataFrame([*asks, asks[0], (None, "a", "bicycle"), ("z", None, "tea")], "qid string, owner string, text string")
    c = spark.createDataFrame([*cards, cards[0], ("n", "a", None), (None, "a", "tea"), ("y", None, "tea")], "id string, owner string, text string")
    terms = {r.qid: (r.owner, r.t) for r in q.filter("owner is not null").select("qid", "owner", curation.topic_terms(F.col("text")).alias("t")).collect()}
    low = c.filter("id is not null and text is not null").selectExpr("id", "owner", "lower(text) low").collect()
    want = {(qid, r.id) for qid, (o, ts) in terms.items() for r in low if r.owner == o and any(t in r.low for t in ts)}
    got = curation.topic_matches(q, c).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
    monkeypatch.setattr(curation, "CARD_BLOCK", 7)
    monkeypatch.setattr(curation, "ASK_BLOCK", 4)
    got = curation.topic_matches(q, c).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def words_moved(spark, of):
    """Rows shuffled for 200 queries and 200 cards of a scope, of 40 terms each."""
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.concat(F.lit("word"), k + F.col("id") % 50)), " ")
    rows = spark.range(200).withColumns({"owner": F.lit("o"), "text": text, "occurred_ts": F.lit(None).cast("timestamp"), "created_ts": F.lit(None).cast("string"), "role": F.lit(None).cast("string")})
    c = rows.withColumn("id", F.format_string("c%03d", "id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as large tables are joined
    try:
        return shuffled(spark, lambda: of(rows.select(F.format_string("q%03d", "id").alias("qid"), "owner", "text"), c))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_seats_shuffle_no_terms(spark):  # F15
    n, moved = words_moved(spark, lambda q, c: lexical.seatable(q, c)[0].select("qid", "id"))
    assert 200 <= n <= 200 * 21 and moved < n + 1_000


def test_gate_shuffles_no_terms(spark):  # F2
    n, moved = words_moved(spark, lambda q, c: lexical.evaluate(q, c, gated=True, strong_terms=8).select("qid", "id"))
    assert n and moved < 1_000


def test_best_shuffles_no_terms(spark):  # F11
    n, moved = words_moved(spark, lambda q, c: lexical.best(q, c, 8).select("qid", "id"))
    assert n == 1_600 and moved < n + 1_000
