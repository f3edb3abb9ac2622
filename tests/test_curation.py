import pytest
from pyspark.sql import functions as F

from cardloom.functions import labels as L
from cardloom.operators import curation as K
from cardloom.operators import fusion, maintenance


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_buckets_and_names(spark):
    lit = F.lit
    cases = [("Pets", "猫很可爱", "宠物"), ("preferences", "中文", "偏好与边界"), ("健康", "plain english", "Health"), (" the house ", "中文", "the house"), (None, "x", ""), ("WORK", "中", "工作")]
    for bucket, text, want in cases:
        assert value(spark, L.bucket_in_language(lit(bucket).cast("string"), lit(text))) == want
    known = F.array(lit("Work "), lit("健康"), lit(None).cast("string"))
    for bucket, locale, want in [("work", "", "Work"), ("健康/Health", "en", "Health"), ("Health/健康", "zh-Hans", "健康"), ("工作、目标与成长", "", "工作"), ("妈妈、爸爸", "", "妈妈、爸爸"), ("  ", "", ""), ("new", "", "new")]:
        assert value(spark, L.converged_bucket(lit(bucket), known, lit(locale))) == want, bucket
    assert [value(spark, L.clean_name(lit(n).cast("string"))) for n in (" “Mina” ", "USER", None, "用户", "a  b")] == ["Mina", "TA", "TA", "TA", "a b"]
    assert value(spark, L.speaker_label(lit("voice_call_record"), lit("x"), lit("y"))) == "通话记录"
    assert [value(spark, L.speaker_label(lit(r), lit(u), lit(a))) for r, u, a in (("User", "user", ""), ("user", "Mina", ""), ("assistant", "x", " "), (None, "x", "Aster"))] == ["对方", "Mina", "我", "Aster"]
    c = value(spark, L.clean_labels(lit("无"), F.array(lit("todo"), lit(" trip "), lit(None).cast("string"), lit('x": 1}]}')), lit("text")))
    assert (c.bucket, c.threads, c.reasons) == ("", ["trip"], ["bucket_placeholder_word", "threads_placeholder_word", "threads_protocol_leak"])
    assert value(spark, L.user_tokens([lit("the User said"), lit("用户 users")], F.array(lit("user")))) == 3


def test_language_ladder(spark):
    none = F.lit(None).cast("string")
    of = lambda e, s, cjk, latin, loc: tuple(value(spark, L.garden_language(e, s, F.lit(cjk), F.lit(latin), loc, 12, 0.62)))
    assert of(F.lit("fr"), F.lit("en"), 99, 0, none) == ("fr", "explicit_preference", 0, 1.0)
    assert of(none, F.lit("en"), 99, 0, none)[:2] == ("en", "established_language")
    assert of(none, none, 10, 2, F.lit("en")) == ("zh-Hans", "writing_language", 12, 0.833)
    assert of(none, none, 6, 6, F.lit("de")) == ("de", "client_locale", 12, 0.0) and of(none, none, 0, 0, none)[:2] == ("zh-Hans", "default")


def test_errors(spark):
    assert value(spark, L.format_error(F.array(*map(F.lit, ("a", "b", "a", "c", "d"))))) == "invalid_card_content:a,b,c"
    for error, raw, want in [("invalid_card_content:x", "y", True), ("json_decode_error:V", "y", True), ("no_json_object", " ", True), ("no_json_object", "prose", False), (None, None, False), ("invalid_card_content_after_retry", "y", False)]:
        assert value(spark, L.retryable(F.lit(error).cast("string"), F.lit(raw).cast("string"))) is want


def test_topics(spark):
    q = spark.createDataFrame([("q1", "o", "my bicycle, code"), ("q2", "o", "猫咪不吃饭"), ("q3", "o", "喜欢"), ("q4", None, None), ("q5", "p", "bicycle")], "qid string, owner string, text string")
    c = spark.createDataFrame([("a", "o", "motorbicycles"), ("b", "o", "code"), ("c", "o", "邻居的猫咪"), ("d", "o", "喜欢咖啡"), ("e", "o", None), ("f", "p", "x bicycle")], "id string, owner string, text string")
    assert {tuple(r) for r in K.topic_matches(q, c).collect()} == {("q1", "a"), ("q2", "c"), ("q5", "f")}


def test_replies_against_cards(spark):
    p = spark.createDataFrame([(1, "merge", None), (2, "supersede", "x"), (3, "merge", " a "), (4, "add", None), (5, None, "x")], "k int, action string, target string")
    assert {r.k: r.verdict for r in K.checked_targets(p, spark.createDataFrame([("a",), ("a",)], "id string"), ["k"]).collect()} == {1: "target_missing", 2: "target_unknown", 3: "ok", 4: "ok", 5: "ok"}
    rows = spark.createDataFrame([("b", "x", 1), ("b", "x", 2), ("b", "other", 1), ("b", " ", 1)], "batch string, id string, place int")
    done, left = K.migrated(rows, spark.createDataFrame([("b", "x"), ("b", "y")], "batch string, id string"), "batch")
    assert [(r.id, r.place) for r in done.collect()] == [("x", 1)] and [r.id for r in left.collect()] == ["y"]
    shown = spark.createDataFrame([("o", "a", False), ("o", "b", True)], "owner string, id string, truncated boolean")
    prop = spark.createDataFrame([("o", 1, ["a"]), ("o", 2, ["a", "b", "z"]), ("o", 3, ["a", "z"])], "owner string, k int, ids array<string>")
    assert {r.k: r.verdict for r in K.safe_proposals(prop, shown, ["owner", "k"]).collect()} == {1: "kept", 2: "truncated_target", 3: "unrendered_target"}


def test_rendering(spark):
    rows = [("o", "a", "one  line", "x\n\n  y ", "b", ["t"], None, ["c"]), ("o", "b", "s" * 50, "short", None, None, "2025", None), ("o", "c", "", " ", None, None, None, None), ("o", "d", "z", "q" * 500, None, None, None, None)]
    df = spark.createDataFrame(rows, "owner string, id string, summary string, content string, bucket string, threads array<string>, occurred_at string, retrieval_cues array<string>")
    blocks = {r.id: (r.block, r.truncated) for r in K.dream_blocks(df, 40, 100).collect()}
    assert set(blocks) == {"a", "b", "d"} and blocks["a"] == ("- id=a | bucket=b | threads=t\n  summary: one line\n  retrieval_cues: c\n  content:\n    x\n\n      y", False)
    assert blocks["b"][1] and "[TRUNCATED]" in blocks["b"][0] and "first 100 of 500 characters" in blocks["d"][0]
    kept = K.rendered(df, "owner", [F.asc("id")], 60, len(blocks["a"][0]) + 1 + len(blocks["b"][0]), 40, 100).collect()
    assert [r.id for r in kept] == ["a", "b"]


def test_ledgers_ids_and_requests(spark):
    ids = spark.createDataFrame([("o", "m_9"), ("o", "m_x"), ("o", "m_10"), ("p", "y"), ("p", None)], "owner string, id string")
    floor = spark.createDataFrame([("o", 3), ("p", 40)], "owner string, next_id int")
    assert {r.owner: r.next_id for r in K.next_ids(ids, "owner").collect()} == {"o": 11, "p": 1}
    assert {r.owner: r.next_id for r in K.next_ids(ids, "owner", floor).collect()} == {"o": 11, "p": 40}
    assert value(spark, K.targets(F.lit(" a "), F.array(F.lit("b"), F.lit("a"), F.lit(""), F.lit(None).cast("string")))) == ["a", "b"]
    lit = lambda x: F.lit(x).cast("string")
    for args, want in [((None, None, "m", "m"), True), ((None, None, "m", "n"), False), ((None, None, None, "n"), True), (("r", None, "m", "m"), False), (("r", "r", "m", "n"), True), (("r", "s", "m", "m"), False)]:
        assert value(spark, K.same_request(*map(lit, args))) is want
    ledger = spark.createDataFrame([("a", "1"), ("b", "1"), ("gone", "1")], "id string, version string")
    out = spark.createDataFrame([("a", "2", "memory_dream"), ("c", "1", "capture")], "id string, version string, source string")
    cards = spark.createDataFrame([("a", False, None), ("b", True, None), ("c", None, " ")], "id string, archived boolean, superseded_by string")
    assert [tuple(r) for r in K.reviewed_after(ledger, out, cards).collect()] == [("a", "2")]
    with pytest.raises(AssertionError):
        K.assert_content_free(spark.createDataFrame([(1, ("x",))], "n int, seen struct<summary:string>"))


def test_fuse_and_lanes(spark):
    assert [value(spark, maintenance.fuse_blown(F.lit(a), F.lit(b))) for a, b in ((10, 0), (10, 12), (9, 9), (10, 13))] == [False, True, False, False]
    lane = spark.createDataFrame([("q", "a", 1)], "qid string, id string, rank long")
    other = spark.createDataFrame([("q", "b", 1)], "qid string, id string, rank long")
    assert [r.id for r in fusion.fuse(lane, other, vector_weight=0).collect()] == ["a"]


def test_shapes():
    from cardloom.functions import shape

    schema = {
        "type": "object", "required": ["id", "kind"],
        "properties": {"id": {"$ref": "#/defs/name"}, "kind": {"enum": ["a", "b"]}, "n": {"type": "integer", "minimum": 1, "maximum": 3}, "tags": {"type": "array", "maxItems": 2, "items": {"type": "string", "minLength": 2}}, "x": {"oneOf": [{"type": "number"}, {"type": ["integer", "null"]}]}, "y": {"anyOf": [{"const": 1}, {"type": "string"}]}},
    }
    of = lambda v: set(shape.violations(v, schema, {"name": {"type": "string", "maxLength": 3}}))
    assert of({"id": "abc", "kind": "a", "n": 2, "tags": ["xx"], "x": None, "y": 1}) == set()
    assert of({"id": "abcd", "n": True, "tags": ["x", "yy", 3], "x": 1, "y": 2}) == {("id", "maxLength"), ("kind", "required"), ("n", "type"), ("tags", "maxItems"), ("tags[0]", "minLength"), ("tags[2]", "type"), ("x", "oneOf"), ("y", "anyOf")}
    assert of([]) == {("", "type")} and of({"id": "a", "kind": "c", "n": 9}) == {("kind", "enum"), ("n", "maximum")}


def test_shapes_of_columns(spark):
    from cardloom.functions import shape

    df = spark.createDataFrame([('{"id": 1}',), ("{",), (None,), ('{"id": "x"}',)], "t string")
    got = [[tuple(x) for x in r.v] for r in df.select(shape.broken(F.col("t"), {"properties": {"id": {"type": "string"}}}).alias("v")).collect()]
    assert got == [[("id", "type")], [("", "json")], [], []]


def test_candidates_and_upgrades(spark):
    from cardloom.operators import reply_rows as replies

    good = '{"candidates": [{"summary": " likes  tea ", "about": "Person", "occurred_at": "2025-01-02T03:04:05+01:00", "evidence": ""}, {"summary": "todo"}, "x"]}'
    df = spark.createDataFrame([("a", good), ("b", '{"candidates": []}'), ("c", "no"), ("d", '{"candidates": [{"summary": "..."}]}'), ("e", '{"cards": []}')], "key string, raw string")
    rows = {(r.key, r.place): r for r in replies.candidates_of_replies(df, strict=False).collect()}
    assert set(rows) == {("a", 0), ("c", None), ("d", None), ("e", None)}
    assert tuple(rows["a", 0])[3:] == ("person", "likes tea", None, "2025-01-02T02:04:05Z")
    assert (rows["c", None].error, rows["d", None].error, rows["e", None].error) == ("no_json", "invalid_card_content_after_retry:summary_no_substantive_chars", "missing_candidates_list")
    assert {r.key: r.error for r in replies.candidates_of_replies(df).collect() if r.error}["a"] == "invalid_card_content:summary_placeholder_word"
    reply = '{"upgrades": [{"id": " m1 ", "summary": "猫", "content": "", "bucket": "Pets", "threads": ["x", "todo", 3]}, {"id": "m1", "summary": "again"}, {"id": "m2"}, {"id": "other", "summary": "s"}]}'
    done, left = replies.upgrades_of_replies(spark.createDataFrame([("k", reply), ("j", None)], "key string, raw string"), spark.createDataFrame([("k", "m1"), ("k", "m2"), ("j", "m3")], "key string, id string"))
    assert [(r.id, r.bucket, r.threads, r.summary) for r in done.collect()] == [("m1", "宠物", ["x", "3"], "猫")]
    assert {(r.key, r.id) for r in left.collect()} == {("k", "m2"), ("j", "m3")}


def test_canonical_times(spark):
    from cardloom.functions.timeparse import canonical_time

    cases = {"2025-01-02": "2025-01-02", " 2025-01-02T03:04:05+01:00": "2025-01-02T02:04:05Z", "2025-01-02 03:04:05.5": "2025-01-02T03:04:05.500000Z", "2025-13-01": "", "nonsense": "", "": ""}
    assert {c: value(spark, canonical_time(F.lit(c))) for c in cases} == cases
