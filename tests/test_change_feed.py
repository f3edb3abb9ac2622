import datetime as dt
import random

import pytest

from cardloom.operators import change_feed as cf
from cardloom.sources.delete_vectors import DeleteVectorTable, RevisionConflict

SCHEMA = "feed_seq bigint, tenant string, owner string, op string, mount string, record_id string, target_ids array<string>, card struct<id:string,summary:string,content:string,bucket:string,importance:double,source:string>, changes map<string,string>, to_mount string, reason string, requested_by string, idempotency_key string, expected_revision string, written_at timestamp, arrived_at timestamp, extra string"
T = dt.datetime(2025, 1, 1)


def row(seq, op, rec=None, rev=None, key=None, new=None, changes=None, to=None, summary="s"):
    card = (new or rec, summary, "c", "b", 0.5, "capture") if op in (None, "add", "ADD", "supersede") else None
    target = [rec] if op == "supersede" else None
    return (seq, "t", "o", op, "m", None if card else rec, target, card, changes, to, None, None, key or f"k{seq}", rev, T, T, "x")


def brute(rows):
    """Record -> (revision, exists, key), by trying changes again and again."""
    seen, todo = set(), []
    for r in sorted(set(map(repr, rows)), key=lambda x: eval(x, {"datetime": dt})[0]):
        r = eval(r, {"datetime": dt})
        if r[12] in seen:
            continue
        seen.add(r[12])
        op = (r[3] or "add").strip().lower()
        if op == "no_op":
            continue
        rec = r[7][0] if op == "add" else r[6][0] if op == "supersede" else r[5]
        rev = int("".join(c for c in (r[13] or "0") if c.isdigit()))
        todo.append((r[0], op, rec, rev, r[12], r[7] and r[7][0]))
    by = {}
    for x in todo:
        by.setdefault(x[2], []).append(x)
    starts = {}
    while True:
        final, new = {}, {}
        for rec in set(by) | set(starts):
            rev, ok, key = 0, False, None
            while True:
                c = [(x[0], x[1], x[4], x[5]) for x in by.get(rec, []) if x[3] == rev and (x[1] == "add") != ok]
                if rev == 0:
                    c += [(q, "start", k, None) for q, k in starts.get(rec, ())]
                if not c:
                    break
                q, op, key, to = min(c)
                rev, ok = rev + 1, op != "delete"
                if op == "supersede":
                    new.setdefault(to, set()).add((q, key))
            final[rec] = (rev, ok, key)
        if new == starts:
            return {r: (v[0], v[2]) for r, v in final.items() if v[1]}
        starts = new


def current(table):
    return {r.record_id: (r.revision, r.idempotency_key) for r in table.records().collect()}


def test_order_repeats_rivals_and_waiting(spark):
    rows = [
        row(1, "update", "a", "2", changes={"summary": "late"}),
        row(2, None, "a"),
        row(3, "update", "a", "r1", changes={"summary": "first"}),
        row(4, "update", "a", "0001", changes={"summary": "rival"}),
        row(5, "update", "a", "1", key="k3", changes={"summary": "repeat"}),
        row(6, "no_op"),
        row(7, "supersede", "a", "3", new="b"),
        row(8, "update", "b", "1", changes={"bucket": "new"}),
        row(9, "supersede", "a", "3", new="lost"),
        row(10, "update", "lost", "1"),
        row(11, "update", "a", "9"),
        row(12, "ADD", "d"),
        row(13, "delete", "d", "1"),
        row(14, "add", "d", "2", summary="again"),
        row(15, "promote", "d", "3", to="family"),
        row(2, None, "a"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for batches in (1, 4):
        table = cf.replay(df, batches)
        got = {r.record_id: r for r in table.records().collect()}
        assert current(table) == brute(rows) == {"a": (4, "k7"), "b": (2, "k8"), "d": (4, "k15")}
        assert (got["a"].summary, got["a"].archived, got["a"].superseded_by) == ("late", True, "b")
        assert (got["b"].bucket, got["d"].summary, got["d"].mount) == ("new", "again", "family")


def test_random_feeds_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(cf, "BLOCK", 3)  # several levels of blocks
    rng = random.Random(5)
    rows = []
    for seq in range(1, 400):
        rec = rng.choice(["hot", "hot", "r1", "r2", "r3"])
        op = rng.choice(["add", "update", "update", "update", "delete", "supersede"])
        new = f"n{rng.randrange(30)}" if op == "supersede" else None
        if new and rng.random() < 0.3:
            rec = f"n{rng.randrange(30)}"
        rows.append(row(seq, op, rec, str(rng.randrange(25)), key=f"k{rng.randrange(350)}", new=new))
    df = spark.createDataFrame(rows, SCHEMA)
    assert current(cf.replay(df, 2)) == brute(rows)


def test_a_repeated_batch_changes_nothing_and_empty_feeds_are_fine(spark):
    df = spark.createDataFrame([row(1, "add", "a"), row(2, "update", "a", "1", changes={"content": None})], SCHEMA)
    table = cf.RecordTable(spark)
    table.apply(df)
    before = [tuple(r) for r in table.records().collect()]
    table.apply(df)
    assert [tuple(r) for r in table.records().collect()] == before
    assert before[0][before and 0] == "a" and table.records().first().content is None
    assert cf.replay(spark.createDataFrame([], SCHEMA)).records().collect() == []


def test_delete_vectors_and_conflicts(spark, tmp_path):
    t = DeleteVectorTable(spark, str(tmp_path / "t"), "id", ["rev"])
    base = t.manifest()
    t.commit(spark.range(200_000).selectExpr("cast(id as string) id", "cast(0 as bigint) rev").coalesce(1), None, base)
    keys = spark.range(0, 200_000, 3).selectExpr("cast(id as string) id")
    for rev in (1, 2):
        base = t.manifest()
        at = t.lookup(keys, base)
        t.commit(keys.selectExpr("id", f"cast({rev} as bigint) rev"), at, base)
    live = t.live()
    assert live.count() == 200_000
    assert {r["rev"]: r["count"] for r in live.groupBy("rev").count().collect()} == {0: 133_333, 2: 66_667}
    assert t.live(1).filter("rev = 0").count() == 200_000  # an older version reads as it was
    with pytest.raises(RevisionConflict):
        t.commit(keys.selectExpr("id", "cast(9 as bigint) rev"), None, base)


def test_rival_predecessors_are_followed_to_the_end(spark):
    rows = [row(1, "add", "s0")]
    seq = 2
    for k in range(9):  # each record is offered by two others, and each of those by two, so that no chain can be halved
        for side in ("a", "b"):
            frm = "s0" if k == 0 else f"{side}{k - 1}"
            for to in ("a", "b"):
                rows.append(row(seq, "supersede", frm, "1" if k == 0 or to == "a" else "2", key=f"k{seq}", new=f"{to}{k}"))
                seq += 1
    df = spark.createDataFrame(rows[::-1], SCHEMA)
    assert current(cf.replay(df, 1)) == brute(rows)


def test_the_second_of_two_racing_writers_leaves_nothing_behind(spark, tmp_path):
    table = lambda: cf.RecordTable(spark, str(tmp_path / "t"))
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    table().apply(frame(row(1, "add", "a", key="start")))
    base = table().images.manifest()
    table().apply(frame(row(2, "update", "a", "1", key="winner", changes={"summary": "won"})))
    with pytest.raises(RevisionConflict):
        table().apply(frame(row(3, "update", "a", "1", key="loser", changes={"summary": "lost"})), base=base)
    assert current(table()) == {"a": (2, "winner")}
    table().apply(frame(row(2, "update", "a", "1", key="winner", changes={"summary": "again"}), row(4, "update", "a", "2", key="loser", changes={"summary": "later"})))
    assert current(table()) == {"a": (3, "loser")} and table().records().first().summary == "later"


def test_compaction_changes_nothing_that_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cf, "COMPACT_AT", 3)
    from cardloom.sources import delete_vectors

    monkeypatch.setattr(delete_vectors.DeleteVectorTable.compact, "__defaults__", (None, 3))
    table = cf.RecordTable(spark, str(tmp_path / "t"))
    rows = []
    for k in range(5):
        batch = [row(2 * k + 1, "add", f"r{k}"), row(2 * k + 2, "update", "r0", str(k + 1), changes={"summary": f"s{k}"})]
        rows += batch
        table.apply(spark.createDataFrame(batch, SCHEMA))
    manifest = table.images.manifest()
    assert len(manifest["index"]) < 4 and len(manifest["extra"]["receipts"]) < 4 and manifest["version"] > 5
    assert current(table) == brute(rows)
    assert {r.record_: r.revision_ for r in table.images.lookup(["r0", "r4", "nowhere"]).collect()} == {"r0": 6, "r4": 1}
    table.apply(spark.createDataFrame(rows, SCHEMA))
    assert current(table) == brute(rows)
