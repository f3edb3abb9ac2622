from cardloom.operators import evidence


def test_rungs(spark):
    cards = [("c1", "meeting about the green kettle"), ("c2", "kettle photo"), ("c3", "东方红车站的票"), ("c4", "fix the api test code"), ("c5", "sun"), ("c6", None), ("c7", "violin kettle tower")]
    df = spark.createDataFrame([("o", *c) for c in cards], "owner string, id string, text string")
    ask = [("q1", "a green kettle please"), ("q2", "kettle and photo"), ("q3", "票在东方红"), ("q4", "the api code test"), ("q5", None), ("q6", "kettle, then violin")]
    q = spark.createDataFrame([(i, "o", t) for i, t in ask], "qid string, owner string, text string")
    got = {(r.qid, r.id): (r.score, r.reason) for r in evidence.relevance(q, df).collect()}
    assert got["q1", "c1"] == (0.88, "entity_phrase_match")
    assert got["q2", "c2"] == (0.36, "rare_term_with_support")
    assert got["q3", "c3"][1] == "phrase_match"
    assert got["q4", "c4"][1] == "multiple_weak_terms"
    assert got["q6", "c7"] == (0.58, "multiple_rare_terms")
    assert not any(k[0] == "q5" or k[1] in ("c5", "c6") for k in got)
    every = {(r.qid, r.id): r.confidence for r in evidence.relevance(q, df, passing=False).collect()}
    assert every["q1", "c2"] == "weak" and set(got) <= set(every)
