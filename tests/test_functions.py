import pytest

from cardloom.functions import replies
from cardloom.functions import text as X
from cardloom.functions.tokenizer import terms, tokenize
from pyspark.sql import functions as F


def test_tokenizer():
    assert tokenize("Fix np-4286 in v2.3.1") == ["fix", "np-4286", "in", "v2.3.1"]
    assert tokenize("Café Müller") == ["café", "müller"] == tokenize("Café Müller")
    assert tokenize("café-np-4286") == ["café", "np-4286"]
    assert tokenize("μmol/l") == ["μ", "mol/l"]
    assert tokenize("猫的车") == ["猫", "的", "车"] and tokenize("体检") == ["体", "检", "体检"]
    assert tokenize(None) == tokenize("") == tokenize(" .,;") == [] and tokenize("Straße") == ["strasse"]


ODD = ["Fix np-4286 in v2.3.1", "naïve-bayes.v2 and bayes-naïve.v2", "a_b/c--d .e. f.", "猫的车体检OK中文abc-中", "Café Müller", "Cafe\u0301 Straße ﬁne", "Ελλάς ΟΔΟΣ привет-мир", "x\U0001e130\u0301y", "ＡＢＣ カタカナ 한국", "", " ", "e\u0301-a", "Ⅷ ½ ª µ", "İstanbul ı", "don't 3,5 €"]


def test_terms_of_columns_are_those_of_the_tokenizer(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*ODD, None, "é" * 3000 + " a" * 3000])], "k int, t string")
    for r in df.select("k", "t", terms(F.col("t")).alias("v")).collect():
        assert sorted(r.v) == sorted(tokenize(r.t)), r.t


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('Here: {"a": "x } y"} ok', {"a": "x } y"}),
        ('<think>{"a": 2}</think>{"a": 1}', {"a": 1}),
        ('{"a": "he said "hi" to me"}', {"a": 'he said "hi" to me'}),
    ],
)
def test_salvage(raw, want):
    assert replies.salvage(raw) == (want, None)


@pytest.mark.parametrize("raw, error", [(None, "empty_output"), (" ", "empty_output"), ("no", "no_json"), ('{"a": 1', "invalid_json"), ("<think>{", "unclosed_reasoning"), ('{"a": NaN}', "invalid_json"), ('{"a": 1, "a": 2}', "invalid_json")])
def test_salvage_errors(raw, error):
    assert replies.salvage(raw)[0] is None and replies.salvage(raw)[1] in (error, "no_json" if error == "invalid_json" else error)


def test_replies_to_rows(spark):
    good = '{"cards": [{"summary": " a  b ", "content": "c", "threads": ["x", "x", 3], "importance_level": 4}, {"action": "supersede", "target_id": "m_1", "summary": "s", "content": "t", "importance": 7}]}'
    df = spark.createDataFrame([("k", good), ("none", '{"cards": []}'), ("bad", "nothing"), ("null", None), ("hole", '{"cards": [{"summary": ""}]}')], "key string, raw string")
    rows = {(r.key, r.place): r for r in replies.cards_of_replies(df).collect()}
    assert rows["k", 0].summary == "a b" and rows["k", 0].threads == ["x"] and rows["k", 0].importance == 0.8 and rows["k", 1].importance == 1.0
    assert (rows["bad", None].error, rows["null", None].error, rows["hole", None].error, rows["none", None].error) == ("no_json", "empty_output", "invalid_card_content", None)
    ops = {(r.key, r.place): (r.op, r.target_ids) for r in replies.mutations_of_cards(replies.cards_of_replies(df)).collect()}
    assert ops == {("k", 0): ("add", None), ("k", 1): ("supersede", ["m_1"])}
    assert replies.consolidations('{"consolidations": [{"card_ids": ["a", "b"], "summary": "s", "content": "c"}]}', frozenset("ab"))[1] is None
    assert replies.consolidations('{"consolidations": [{"card_ids": ["z"], "summary": "s", "content": "c"}]}', frozenset("ab"))[1] == "invalid_card_ids"


def test_text_gates(spark):
    cases = [("", "empty"), ("  ", "empty"), (None, "empty"), ("[summary]", "bracket_placeholder"), ("TODO", "placeholder_word"), ("...", "no_substantive_chars"), ("real", None), ("Привет", None)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r.k: r.v for r in df.select("k", X.placeholder_reason(F.col("t")).alias("v")).collect()}
    assert [got[k] for k in range(len(cases))] == [w for _, w in cases]
    torn = spark.createDataFrame([('x", "k": 1}]}',), ('{"a": 1}',), ("plain",), ("a]] b",)], "t string").select(X.torn_json(F.col("t")).alias("v")).collect()
    assert [r.v for r in torn] == [True, False, False, True]
    two = spark.createDataFrame([("abcd", "abce"), ("", ""), ("a", "a"), (None, "ab")], "a string, b string").select(X.bigram_jaccard(F.col("a"), F.col("b")).alias("v")).collect()
    assert [r.v for r in two] == [0.5, 0, 0, 0]


@pytest.mark.parametrize("raw, want", [("a<think>b</think>c", "ac"), ("<think>a<think>b</think>c</think>", None), ("a</think>b", None), ("<reasoning>", None), ("plain", "plain"), ("<THINK>x</think><think>y</think>z", "z")])
def test_reasoning_fails_closed(raw, want):
    assert replies.strip_reasoning(raw) == want


def test_blocks_and_known_ids():
    assert replies.balanced_block('x {"a": "}", "b": {"c": "\\"}"}} y {') == '{"a": "}", "b": {"c": "\\"}"}}'
    assert replies.balanced_block('{"open": "') is None and replies.balanced_block("none") is None and replies.balanced_block("{}") == "{}"
    reply = '{"consolidations": [{"card_ids": ["a"], "summary": "s", "content": "c"}]}'
    assert replies.consolidations(reply)[1] is None and replies.consolidations(reply, frozenset())[1] == "invalid_card_ids"
