import datetime as dt

import pytest

from cardloom.api import Garden, RequestError, Scope
from cardloom.streaming import feeds


@pytest.fixture(scope="module")
def garden(spark):
    g, s = Garden(spark, clock=lambda: dt.datetime(2025, 1, 1)), Scope("t", "o", ("agent-private", "family"))
    card = lambda i, text: {"op": "add", "card": {"id": i, "summary": text, "content": text, "source": "capture"}}
    assert g.apply(s, [card("a", "green tea at noon"), card("b", "the red bicycle is broken"), card("c", "tea kettle")], "k1").ok
    return g, s


def test_writes_and_reads(garden):
    g, s = garden
    assert [r.id for r in g.search(s, "kettle tea").collect()] == ["c", "a"] and g.search(s, " ").collect() == []
    assert g.search(Scope("t", "other"), "tea").collect() == []
    assert {r.id for r in g.context(s, ["", "where is my bicycle"]).collect()} == {"b"}
    again = g.apply(s, [{"op": "add", "card": {"id": "x", "summary": "other"}}], "k1")
    assert again.error == "key_conflict"
    new = g.apply(s, [{"op": "supersede", "target_ids": ["c"], "card": {"id": "d", "summary": "blue kettle", "content": "x"}}, {"op": "update", "record_id": "b", "changes": {"summary": "bicycle mended"}}, {"op": "promote", "record_id": "a", "to_mount": "family"}], "k2")
    assert new.ok and [r["revision"] for r in new.results] == [1, 2, 2]
    assert {r.id: r.state for r in g.browse(s, states=("active", "superseded")).collect()} == {"a": "active", "b": "active", "c": "superseded", "d": "active"}
    assert [(r.id, r.relation) for r in g.related(s, ["d"]).collect()] == [("c", "supersedes")]
    assert g.export(s)[1] == {"total": 4, "archived": 0, "superseded": 1}
    part = g.read(s, "b", limit=10)
    assert len(part["text"]) == 10 and "mended" in g.read(s, "b", part["cursor"])["text"]
    assert g.needs_maintenance(s, min_new=2).first().reason == "due"
    assert {r.id for r in g.browse(Scope("t", "o")).collect()} == {"b", "d"}  # without the mount, without its card


def test_refusals(garden):
    g, s = garden
    bad = [({"op": "update", "record_id": "nowhere", "changes": {"summary": "x"}}, "not_found"), ({"op": "update", "record_id": "b", "changes": {"mount": "x"}}, "invalid_request"), ({"op": "delete", "record_id": "b"}, "invalid_request"), ({"op": "fly"}, "unsupported_operation"), ({"op": "add", "card": {"id": "b", "summary": "x"}}, "invalid_request")]
    for k, (m, error) in enumerate(bad):
        assert g.apply(s, [m], f"bad{k}").error.startswith(error)
    with pytest.raises(RequestError):
        g.promote(s, "b", "secret", "k9")
    with pytest.raises(RequestError):
        g.read(s, "nowhere")


def test_store_contract(spark):
    g, s = Garden(spark, clock=lambda: dt.datetime(2025, 1, 1)), Scope("t", "o")
    add = lambda text, i=None: {"op": "add", "card": {"summary": text, **({"id": i} if i else {})}}
    at = lambda: {r.id: (r.summary, r.state, r.superseded_by, r.revision) for r in g.cards(s, ("active", "archived", "superseded")).collect()}
    first = g.apply(s, [add("one", "a"), add("two", "b"), add("three", "c"), add("free")], "k", expected_revision="0", maintenance={"n": 1})
    fresh = first.results[3]["id"]
    assert first.ok and fresh.startswith("m_") and set(at()) == {"a", "b", "c", fresh}
    # the same key gives the same receipt, other content or a longer key does not
    assert g.apply(s, [add("one", "a"), add("two", "b"), add("three", "c"), add("free")], "k", maintenance={"n": 1}) == first
    assert g.apply(s, [add("x")], "k").error == "key_conflict"
    # a stale revision, of a record or of the store, refuses the whole batch
    stale = g.apply(s, [{"op": "update", "record_id": "b", "changes": {"summary": "kept out"}}, {"op": "update", "record_id": "a", "expected_revision": 7, "changes": {"summary": "x"}}], "k#0", maintenance={"n": 2})
    assert stale.error.startswith("revision_conflict") and at()["b"] == ("two", "active", None, 1)
    assert g.apply(s, [add("x")], "k2", expected_revision="0").error.startswith("revision_conflict") and g.ledger(s) == {"n": 1}
    # all targets of a supersede retire; later mutations see earlier ones; a taken number is never given again
    done = g.apply(s, [{"op": "supersede", "target_ids": ["b", "c", "b"], "card": {"summary": "both"}}, {"op": "update", "record_id": "a", "changes": {"summary": "one!"}}, {"op": "delete", "record_id": "a", "requested_by": "me"}, add("again", "a"), add("big", "m_500")], "k3", maintenance={"n": 3})
    new = done.results[0]["id"]
    assert done.ok and done.results[0]["replaced"] == ["b", "c"] and g.ledger(s) == {"n": 3}
    now = at()
    assert now["b"][1:3] == now["c"][1:3] == ("superseded", new) and now["a"] == ("again", "active", None, 4) and now[new][1] == "active"
    assert g.apply(s, [{"op": "delete", "record_id": "a", "requested_by": "me"}], "k4").ok and "a" not in at()
    back = g.apply(s, [add("back", "a"), add("later")], "k5")
    assert back.ok and at()["a"] == ("back", "active", None, 6) and int(back.results[1]["id"][2:]) > 500
    assert g.apply(Scope("t", "other"), [{"op": "archive", "record_id": "a"}], "k6").error.startswith("not_found")
    assert g.apply_judged(s, lambda cards: [{"op": "archive", "record_id": r.id} for r in cards.filter("summary = 'later'").collect()], "k7").ok
    assert [r.state for r in g.browse(s, states=("archived",)).collect()] == ["archived"]


def test_feed_stream(spark, data, tmp_path):
    from cardloom.operators.change_feed import RecordTable, replay

    feed = spark.read.parquet(f"{data}/mutations.parquet")
    table = RecordTable(spark)
    stream = spark.readStream.schema(feed.schema).parquet(f"{data}/mutations.parquet*")
    q = feeds.apply_feed(stream, table, str(tmp_path / "c"))
    q.awaitTermination(300)
    key = lambda t: sorted(map(tuple, t.records().select("record_id", "idempotency_key").collect()))
    assert key(table) == key(replay(feed, 1))


def test_session_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").selectExpr("user_id", "cast(ts as timestamp) ts")
    events.write.parquet(str(tmp_path / "e"))
    s = feeds.sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "user_id", "ts")
    q = s.writeStream.format("memory").queryName("closed_sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).start()
    q.awaitTermination(300)
    closed = spark.table("closed_sessions")
    assert 0 < closed.count() and closed.filter("n < 1").count() == 0
