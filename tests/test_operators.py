import math
import random

import pytest
from pyspark.sql import functions as F

from cardloom.functions import constants as C
from cardloom.operators import budgets, fusion, importing, lexical, lifecycle, metrics, ordering, related, selection


def bm25(query, docs, floor=20, strong_terms=None):
    """One query over one pool, in loops."""
    split = lambda t: (t or "").lower().split()
    terms = sorted(set(split(query)) - set(C.STOPWORDS))
    toks = {i: split(t) for i, t in docs.items()}
    n, total = len(docs), sum(map(len, toks.values()))
    df = {t: sum(t in set(x) for x in toks.values()) for t in terms}
    idf = lambda n, d: math.log1p((n - d + 0.5) / (d + 0.5))
    mass = sum(idf(max(n, floor), df[t]) for t in terms)
    out = {}
    for i, x in toks.items():
        hit = [t for t in terms if t in x]
        if not hit:
            continue
        score = sum(idf(n, df[t]) * x.count(t) * 2.2 / (x.count(t) + 1.2 * (0.25 + 0.75 * len(x) / (total / n))) for t in hit)
        cover = sum(idf(max(n, floor), df[t]) for t in hit) / mass
        scale = math.sqrt(max(1, len(terms) / strong_terms)) if strong_terms else 1
        out[i] = (round(score, 6), round(cover, 6), cover >= 0.25 or score >= 1.25 * idf(n, 0) * scale)
    return out


@pytest.mark.parametrize("strong_terms", [None, 8])
def test_bm25_equals_loops(spark, strong_terms):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(40)] + ["the", "of"]
    docs = {o: {f"{o}{k:02d}": " ".join(rng.choices(words, k=rng.randrange(0, 30))) for k in range(n)} for o, n in (("a", 30), ("b", 3))}
    asks = {f"q{k}": (rng.choice("ab"), " ".join(rng.sample([*words, "unseen"], rng.randrange(0, 14)))) for k in range(20)}
    cards = spark.createDataFrame([(o, i, t, "clash") for o, d in docs.items() for i, t in d.items()] + [("a", None, "w1", "x")], "owner string, id string, text string, term string")
    q = spark.createDataFrame([(k, o, t) for k, (o, t) in asks.items()] + [("null", "a", None)], "qid string, owner string, text string")
    got = {(r.qid, r.id): (r.score, r.coverage, r.passed) for r in lexical.evaluate(q, cards, strong_terms=strong_terms).collect()}
    want = {(k, i): v for k, (o, t) in asks.items() for i, v in bm25(t, docs[o], strong_terms=strong_terms).items()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-6)


def test_seats_equal_a_greedy_loop(spark):
    rng = random.Random(8)
    rows = [(f"q{k}", f"c{i:02d}", float(-i), i + 1, rng.choice(["turning_point", None, "x"]), rng.choice([None, f"2025-0{rng.randrange(1, 9)}"]), rng.choice([None, f"2025-0{rng.randrange(1, 9)}"])) for k in range(30) for i in range(rng.randrange(0, 20))]
    df = spark.createDataFrame(rows, "qid string, id string, score double, rank int, role string, occurred_ts string, created_ts string")
    got = {}
    for r in selection.seats(df).orderBy("qid", "final_rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.bucket))
    for q in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == q]
        seats = {}
        newest = lambda col: lambda r: (r[col] is None, [-ord(c) for c in r[col] or ""], r[1])
        for name, pool, quota in (("turning_point", sorted((r for r in mine if r[4] == "turning_point"), key=newest(5)), 3), ("recent", sorted(mine, key=newest(6)), 2), ("query", mine, 8)):
            n = 0
            for r in pool:
                if len(seats) < 8 and n < quota and r[1] not in seats:
                    seats[r[1]] = name
                    n += 1
        assert got[q] == [(r[1], seats[r[1]]) for r in mine if r[1] in seats]


def test_cosine_and_fusion(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1e-30, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in df.select(fusion.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.707107, -1.0]
    for a, b in (([0.0], [1.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([float("nan")], [1.0]), ([], [])):
        with pytest.raises(Exception):
            spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(fusion.cosine(F.col("a"), F.col("b"))).collect()
    lane = lambda *x: spark.createDataFrame(list(x), "qid string, id string, rank bigint")
    got = {r.id: (r.score, r.rank) for r in fusion.fuse(lane(("q", "a", 1), ("q", "b", 2)), lane(("q", "b", 1), ("q", "c", 2))).collect()}
    assert got == {"b": (round(2 / 21 + 1 / 22, 6), 1), "c": (round(2 / 22, 6), 2), "a": (round(1 / 21, 6), 3)}


def test_lifecycle_and_pages(spark):
    rows = [("a", None, None, None), ("b", True, None, None), ("c", True, "active", " x "), ("d", False, "Deleted", "x"), ("e", None, "odd", None), ("f", None, "superseded", None)]
    df = spark.createDataFrame(rows, "id string, archived boolean, status string, superseded_by string").withColumn("owner", F.lit("o")).withColumn("mount", F.lit(None).cast("string"))
    assert [r.state for r in lifecycle.with_status(df).orderBy("id").collect()] == ["active", "archived", "superseded", "deleted", "unknown", "superseded"]
    assert [r.id for r in lifecycle.scoped(df, []).collect()] == ["a"]
    at = lambda c: spark.createDataFrame([("o", c)], "owner string, cursor string")
    ids = lambda p: ([r.id for r in p.orderBy("id").collect()], p.first().has_more)
    assert ids(lifecycle.page(df, at(None), 2)) == (["a", "b"], True)
    assert ids(lifecycle.page(df, at("d"), 2)) == (["e", "f"], False)
    assert ids(lifecycle.page(df, at("gone"), 2)) == (["a", "b"], True)


def test_one_hop_priorities(spark):
    none = None
    c = [  # id, summary, threads, supersedes, anchors, status, superseded_by, archived
        ("s1", "src", ["t"], ["old"], ["far"], none, none, none),
        ("s2", "src", ["t"], none, ["old"], none, none, none),
        ("far", "f", ["t"], none, none, none, none, none),
        ("old", "o", none, none, none, "superseded", "s1", True),
        ("near", " n \n n ", ["t", "t"], none, none, none, none, none),
        ("gone", "g", ["t"], none, none, "archived", none, True),
        ("mute", " ", ["t"], none, none, none, none, none),
    ]
    df = spark.createDataFrame(c, "id string, summary string, threads array<string>, supersedes array<string>, anchor_memory_ids array<string>, status string, superseded_by string, archived boolean").withColumn("scope", F.lit("o"))
    got = [(r.id, r.source_id, r.relation, r.summary) for r in related.one_hop(df.filter("id like 's%'").withColumn("set_id", F.lit(1)), df).orderBy("rank").collect()]
    assert got == [("far", "s1", "anchor", "f"), ("old", "s1", "supersedes", "o"), ("near", "s1", "thread", "n n")]


def test_budgets_and_chunks(spark):
    lines = spark.createDataFrame([("s", k, "x" * n) for k, n in enumerate((5, 3, 9, 1))], "scope string, place int, line string")
    assert [r.place for r in budgets.within_budget(lines, 9).collect()] == [0, 1] and budgets.within_budget(lines, 4).collect() == []
    text = "aaaa\nbbbb\ncccc" * 40
    assert "".join(budgets.chunk_text(text, 50)) == text and max(map(len, budgets.chunk_text(text, 50))) <= 50 and budgets.chunk_text("", 5) == []
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    plan = importing.plan(docs, 200)
    first = importing.next_batch(plan, plan.limit(0)).collect()
    assert [(r.scope, r.place, r.start) for r in first] == [(1, 0, 0)]
    done = spark.createDataFrame([(first[0].batch_key,)], "batch_key string")
    assert importing.next_batch(plan, done).first().place == 1 and importing.estimate(plan, done).first().batches_left == plan.count() - 1


def test_metrics_and_order(spark):
    results = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "x", 1)], "qid string, id string, rank bigint")
    truth = spark.createDataFrame([("q1", "b", "must"), ("q1", "z", "must"), ("q2", "x", "must_not")], "qid string, id string, label string")
    queries = spark.createDataFrame([("q1", False), ("q2", True), ("q3", True)], "qid string, expect_empty boolean")
    got = {r.qid: (r.recall, r.precision, r.reciprocal_rank, r.violations, r.right_empty) for r in metrics.per_query(results, truth, queries).collect()}
    assert got == {"q1": (0.5, 0.5, 0.5, 0, False), "q2": (None, 0.0, None, 1, False), "q3": (None, None, None, 0, True)}
    values = spark.range(100).selectExpr("cast((id * 37) % 101 as double) v").repartition(7)
    rows = ordering.numbered(values, ["v"]).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(100)) and [r.v for r in rows] == sorted(r.v for r in rows)
    assert {r.p: r.value for r in metrics.nearest_rank(values, "v", [0, 50, 100]).collect()} == {0: rows[0].v, 50: rows[50].v, 100: rows[99].v}


def test_leaked_ids_equal_a_substring_search(spark, tmp_path):
    from cardloom.operators import maintenance
    from cardloom.plans import memory

    rng = random.Random(5)
    ids = [("o1", " m_000000017 "), ("o1", "m_00000001"), ("o1", "卡片-0001-αβγδ"), ("o2", "x" * 170), ("o1", "short"), ("o2", "a b.c/d#e"), (None, "nobody_1"), ("o1", None)]
    ids += [(f"o{rng.randint(1, 2)}", "".join(rng.choice("ab01_-é") for _ in range(rng.randint(8, 12)))) for _ in range(60)]
    texts = [("o1", "t0", "seem_000000017x"), ("o2", "t1", "m_000000017"), ("o1", "t2", None), ("o1", "t3", ""), ("o2", "t4", "y" + "x" * 171), ("o2", "t5", "(a b.c/d#e)"), (None, "t6", "nobody_12"), ("o1", "t7", "😀卡片-0001-αβγδ。")]
    for k in range(200):
        o, i = rng.choice([x for x in ids if x[1]])
        texts.append((rng.choice((o, "o1", "o2")), f"r{k}", "".join(rng.choice("ab01_-é ") for _ in range(30)) + i[rng.randint(0, 1) :] + rng.choice(("", "z", " end"))))
    want = {}
    for o, k, t in texts:
        hit = [i.strip() for p, i in ids if i and p == o and len(i.strip()) >= 8 and i.strip() in (t or "")]
        if hit:
            want[k] = min(hit, key=lambda x: x.encode())
    t, i = spark.createDataFrame(texts, "owner string, key string, text string"), spark.createDataFrame(ids, "owner string, id string")
    assert {r.key: r.id for r in maintenance.leaked_ids(t, i).collect()} == want and {"t0", "t4", "t5", "t6", "t7"} <= set(want) and "t1" not in want
    assert maintenance.leaked_ids(t, i.limit(0)).collect() == []

    cards = [("m_000000001", "o1", "see m_000000002.", "none"), ("m_000000002", "o1", "none", "xm_000000001x"), ("m_000000003", "o2", "m_000000001", None)]
    spark.createDataFrame(cards, "id string, owner string, summary string, content string").write.parquet(f"{tmp_path}/cards.parquet")
    feed = [(1, "o1", ("g_000000009", "s", "m_000000002!"), None, None), (2, "o1", None, {"content": "ag_000000009b"}, "merged m_000000001"), (3, "o2", None, {"content": "g_000000009"}, None)]
    spark.createDataFrame(feed, "feed_seq bigint, owner string, card struct<id:string,summary:string,content:string>, changes map<string,string>, reason string").write.parquet(f"{tmp_path}/mutations.parquet")
    assert {tuple(r) for r in memory.QUERIES["id_leak"](spark, str(tmp_path)).collect()} == {
        ("cards", "m_000000001", "summary", "m_000000002"), ("cards", "m_000000002", "content", "m_000000001"),
        ("mutations", "1", "card.content", "m_000000002"), ("mutations", "2", "changes.content", "g_000000009"), ("mutations", "2", "reason", "m_000000001"),
    }


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(fusion, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(fusion, "QUERY_BLOCK", 3)
    rng = random.Random(1)
    rows = [(f"v{k:02d}", rng.choice("ab"), [rng.uniform(-1, 1) for _ in range(4)]) for k in range(40)] + [("v90", "a", [1.0, 0.0, 0.0, 0.0]), ("v91", "a", [1.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id string, owner string, vector array<double>")
    q = v.withColumnRenamed("id", "qid").filter("qid < 'v12' or qid = 'v90'")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for limit, scope in ((3, None), (None, "owner")):
        want = set()
        for qid, own, a in [r for r in rows if r[0] < "v12" or r[0] == "v90"]:
            near = sorted((-round(cos(a, b), 4), i) for i, o, b in rows if i != qid and (o == own or not scope) and round(cos(a, b), 4) >= 0.1)
            want |= {(qid, i, n + 1) for n, (_, i) in enumerate(near[:limit])}
        assert {(r.qid, r.id, r["rank"]) for r in fusion.vector_top(q, v, limit, 0.1, scope).collect()} == want
    with pytest.raises(Exception):
        fusion.vector_top(q, spark.createDataFrame([("x", "a", [0.0] * 4)], v.schema), 3, 0.1).collect()
    assert fusion.vector_top(q, v.limit(0), 3, 0.1).collect() == []
