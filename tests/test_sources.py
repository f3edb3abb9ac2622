import json
import sqlite3

import pytest

from cardloom.functions.tokenizer import tokenize, tokens
from cardloom.sources import records


def test_json_sources(spark, tmp_path):
    rows = [{"id": "a", "summary": "x", "threads": ["t"], "odd": 1}, {"id": "b", "importance": 0.5}]
    (tmp_path / "lines.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "wrapped.json").write_text(json.dumps({"cards": rows}))
    want = [("a", "x", ["t"], None), ("b", None, None, 0.5)]
    pick = lambda df: [(r.id, r.summary, r.threads, r.importance) for r in df.orderBy("id").collect()]
    assert pick(records.open_cards(spark, f"json:{tmp_path}/lines.jsonl")) == want
    for name in ("array", "wrapped"):
        assert pick(records.open_cards(spark, f"jsons:{tmp_path}/{name}.json")) == want
    records.cards_from_json(spark, f"{tmp_path}/lines.jsonl").createOrReplaceTempView("some_cards")
    assert pick(records.open_cards(spark, "memory:some_cards")) == want
    with pytest.raises(ValueError):
        records.open_cards(spark, "ftp://x")


def test_sqlite_source(spark, tmp_path):
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("CREATE TABLE cards (tenant TEXT, owner TEXT, id TEXT, doc TEXT)")
        db.executemany("INSERT INTO cards VALUES (?, ?, ?, ?)", [("t", "o", f"m{k}", json.dumps({"summary": f"s{k}"})) for k in range(7)])
    got = {(r.tenant, r.owner, r.id, r.summary) for r in records.sqlite_cards(spark, str(tmp_path / "s.db"), 3).collect()}
    assert got == {("t", "o", f"m{k}", f"s{k}") for k in range(7)}


def test_records_as_cards(spark):
    df = spark.createDataFrame([(1, " ", "title", "body", "secret", 7), (2, "head", None, "", None, 8)], "k int, a string, b string, c string, p string, extra int")
    got = [(r.id, r.summary, r.search_text, r.private_text, r.extra) for r in records.as_cards(df, "k", ["a", "b"], ["b", "c"], ["p"], ["extra"]).orderBy("id").collect()]
    assert got == [("1", "title", "title body", "secret", 7), ("2", "head", "", "", 8)]


def test_tokens_as_columns(spark):
    df = spark.createDataFrame([("Café np-4286 体检",), (None,), ("",)], "t string")
    assert [list(r.v) for r in df.select(tokens("t").alias("v")).collect()] == [tokenize("Café np-4286 体检"), [], []]
