import datetime as dt

import pytest

from cardloom.operators import timestamps

CASES = [  # raw, tz, locale, instant, date
    ("2025-03-30T02:30:00", "Europe/Berlin", "de-DE", "2025-03-30 01:30:00", None),  # skipped: moves on
    ("2025-10-26T02:30:00", "Europe/Berlin", "de-DE", "2025-10-26 00:30:00", None),  # twice: the earlier
    ("2025-11-02 01:30:00", "America/New_York", "en-US", "2025-11-02 05:30:00", None),
    (" 2025-06-01T10:00 ", None, "en-US", "2025-06-01 10:00:00", None),
    ("2025-06-01T10:00:00Z", "Asia/Kolkata", "en-US", "2025-06-01 10:00:00", None),
    ("2025-06-01T10:00:00.123456+05:30", "UTC", "en-US", "2025-06-01 04:30:00.123456", None),
    ("2025-06-01 10:00:00 +0200", "UTC", "fr-FR", "2025-06-01 08:00:00", None),
    ("2025-06-01 10:00:00 PST", "UTC", "fr-FR", "2025-06-01 18:00:00", None),
    ("2025-06-01 10:00:00 Asia/Shanghai", "UTC", "fr-FR", "2025-06-01 02:00:00", None),
    ("2025-06-01T10:00:00[Europe/Paris]", "UTC", "fr-FR", "2025-06-01 08:00:00", None),
    ("Sun, 10 Aug 2025 03:56:58 -0700", "UTC", "en-US", "2025-08-10 10:56:58", None),
    ("20250517T022948Z", "UTC", "en-US", "2025-05-17 02:29:48", None),
    ("1772970917", "Asia/Tokyo", "en-US", "2026-03-08 11:55:17", None),
    ("1777676184864", "UTC", "en-US", "2026-05-01 22:56:24.864", None),
    ("05/11/2026 09:49 PM", "UTC", "en-US", "2026-05-11 21:49:00", None),
    ("05/11/2026 12:05 AM", "UTC", "en-US", "2026-05-11 00:05:00", None),
    ("05/11/2026 09:49", "UTC", "fr-FR", "2026-11-05 09:49:00", None),
    ("02.12.2025 17:52", "Europe/Berlin", "de-DE", "2025-12-02 16:52:00", None),
    ("2025年8月9日 00:30", "Asia/Shanghai", "zh-Hans", "2025-08-08 16:30:00", None),
    ("2025-03-15", "UTC", "en-US", None, "2025-03-15"),
    ("2025-06-31", "UTC", "en-US", None, None),
    ("2025-06-31 10:00", "UTC", "en-US", None, None),
    ("2025-06-01 25:00", "UTC", "en-US", None, None),
    ("13/13/2025 10:00", "UTC", "en-US", None, None),
    ("2025-06-01 10:00:00 Mars/Base", "UTC", "en-US", None, None),
    ("2025-06-01 10:00:00", "Nowhere/Else", "en-US", None, None),
    ("2025-W99", "UTC", "en-US", None, None),
    ("T08:00", "UTC", "en-US", None, None),
    ("yesterday", "UTC", "en-US", None, None),
    ("-", "UTC", "en-US", None, None),
    ("", "UTC", "en-US", None, None),
    (None, "UTC", "en-US", None, None),
    ("x" * 20000, "UTC", "en-US", None, None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(k, raw, tz, loc, "clash") for k, (raw, tz, loc, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows * 2, "k int, raw string, tz string, loc string, raw_utc string")
    return timestamps.normalise(df, ["raw"], "tz", "loc").collect()


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(parsed, k):
    instant, date = CASES[k][3:]
    want = None if instant is None else dt.datetime.fromisoformat(instant)
    mine = [r for r in parsed if r.k == k]
    assert len(mine) == 2  # repeated rows stay
    assert {r.raw_utc for r in mine} == {want}
    assert {r.raw_date and str(r.raw_date) for r in mine} == {date}


def test_dictionary_grows_by_what_is_new_only(spark, tmp_path):
    d = timestamps.TimestampDictionary(spark, str(tmp_path / "dictionary"))
    keys = lambda *v: spark.createDataFrame([(x, "import", "UTC", False) for x in v], "raw_ string, source_ string, zone_ string, month_first_ boolean")
    assert d.extend(keys("2025-01-01", "a")).count() == 2
    assert d.extend(keys("2025-01-01", "b")).count() == 3
    d.read().write.mode("append").parquet(str(tmp_path / "twice"))
    again = timestamps.TimestampDictionary(spark, str(tmp_path / "twice"))
    d.read().write.mode("append").parquet(str(tmp_path / "twice"))  # a job that was tried again
    assert again.read().count() == 6 and again.extend(keys("c")).count() == 4


def test_dictionary_of_the_session_is_kept(spark, tmp_path):
    spark.conf.set(timestamps.SETTING, str(tmp_path / "kept"))
    try:
        cards = spark.createDataFrame([("a", "o", "x", "2025-01-02T00:00:00Z", "2025-01-01 00:00"), ("b", None, None, None, "")], "id string, owner string, source string, occurred_at string, created_at string")
        gardens = spark.createDataFrame([("o", "Europe/Berlin", "de")], "owner string, tz string, locale string")
        for _ in range(2):
            assert [r.id for r in timestamps.written_before_it_happened(cards, gardens).collect()] == ["a"]
            assert timestamps.TimestampDictionary(spark).read().count() == 3
    finally:
        spark.conf.unset(timestamps.SETTING)


def test_empty_table(spark):
    df = spark.createDataFrame([], "raw string, tz string, loc string")
    assert timestamps.normalise(df, ["raw"], "tz", "loc").collect() == []


def test_hot_values_are_looked_up_apart(spark, monkeypatch):
    from cardloom.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    df = spark.createDataFrame([("2025-01-01T00:00:00Z", "UTC", "en")] * 200 + [("2025-01-02T00:00:00Z", "UTC", "en")], "raw string, tz string, loc string")
    out = timestamps.normalise(df, ["raw"], "tz", "loc").groupBy("raw_utc").count().collect()
    assert sorted(r["count"] for r in out) == [1, 200]


def test_cards_are_ordered_by_instant(spark, tmp_path):
    from cardloom.plans import memory

    newest_first = [
        ("z", "2025-05-02T01:00:00"), ("y", " 2025-05-02T02:30:00+02:00"), ("x", "20250502T001500Z"), ("w", "2025-05-02"), ("v", "2025-05-02T05:00:00+08:00"), ("u", "2025-05-01 20:00:00.5"),
        ("a", "2025-05-03 10:00 UTC"), ("b", "2025年5月4日"), ("c", "2025-13-01"), ("d", "0001-01-01T00:00:00+05:00"), ("e", ""), ("f", None),
    ]
    schema = "id string, owner string, occurred_at string, updated_at string, summary string, content string, bucket string, threads array<string>, retrieval_cues array<string>, role string, status string, superseded_by string, archived boolean"
    row = lambda i, t, owner: (i, owner, t, "", "", "", None, None, None, "turning_point", "active", None, False)
    rows = [row(i, t, "all") for i, t in newest_first] + [row(f"{k}{i}", t, f"from{k}") for k in range(10) for i, t in newest_first[k:]]
    spark.createDataFrame(rows[::-1], schema).write.parquet(f"{tmp_path}/cards.parquet")
    got = {}
    for r in memory.QUERIES["role_topk"](spark, str(tmp_path)).orderBy("owner", "rank").collect():
        got.setdefault(r.owner, []).append(r.id)
    assert got["all"] == ["z", "y", "x"]
    assert all(got[f"from{k}"] == [f"{k}{i}" for i, _ in newest_first[k : k + 3]] for k in range(10))
