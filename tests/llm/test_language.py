import math

import numpy as np
import pytest

from cardloom.llm import language as lg

TEXTS = {
    "en": "The quick fox runs over the green hill and the old man was looking for his keys in the house",
    "de": "Der schnelle Fuchs läuft über den grünen Hügel und der alte Mann suchte seine Schlüssel in dem Haus",
    "fr": "Le renard rapide court sur la colline verte et le vieil homme cherchait ses clés dans la maison",
    "es": "El zorro rápido corre por la colina verde y el hombre viejo buscaba sus llaves en la casa",
    "zh": "敏捷的狐狸跑过绿色的山丘，老人在房子里找他的钥匙，因为天很黑。",
}


@pytest.fixture(scope="module")
def model():
    return lg.train([(k, v) for k, v in TEXTS.items() for _ in range(3)] + [("en", TEXTS["de"])], lg.load_pieces())


def test_score_sums_all_segmentations(model):
    def brute(s):
        if not s:
            return np.ones(len(lg.LANGUAGES))
        total = np.zeros(len(lg.LANGUAGES))
        for n in range(1, len(s) + 1):
            piece = s[:n] if s[:n] in model.pieces else lg._unknown(s[0]) if n == 1 and s[0] not in model.pieces else None
            if piece:
                total = total + model.table.get(piece, model.floor) * brute(s[n:])
        return total

    for word in ("house", "schlüssel", "x", "qqq", "ß", "狐"):
        assert np.allclose(model.score(word), np.log(brute(lg._marked(word)))), word


def test_long_words_are_scored_and_learned_whole(model):
    for word in ("häuser" * 60, "q" * 3000):  # beyond any bound of a piece or of the range of numbers
        edges = lg._lattice(word, model.pieces, model.longest)
        used = lg._expected(edges, [1e-4] * len(edges))
        assert math.isclose(sum(v * (j - i) for v, (i, j, _) in zip(used, edges)), len(lg._marked(word)), rel_tol=1e-6)
    assert np.isfinite(model.score("q" * 3000)).all()
    short, long = model.score("schlüssel"), model.score("schlüssel" * 40)
    assert long.argmax() == short.argmax() and (long < short).all()
    assert not np.allclose(model.score("a" * 250), model.score("a" * 250 + "schlüsselhaus"))
    plain = lambda u: lg._expected(lg._lattice(u, model.pieces, model.longest), [0.01] * len(lg._lattice(u, model.pieces, model.longest)))
    at = lg._SHORT
    lg._SHORT = 0
    try:
        scaled = plain("schlüssel")
    finally:
        lg._SHORT = at
    assert np.allclose(plain("schlüssel"), scaled)


def test_sample_is_that_of_the_least_hashes_for_any_number_of_copies(spark, monkeypatch):
    monkeypatch.setattr(lg, "TRAIN_ROWS", 5)
    seen = []
    monkeypatch.setattr(lg, "train", lambda rows, pieces: seen.append(sorted(rows)))
    rows = spark.createDataFrame([(lang, f"{TEXTS[lang]} {k}") for k in range(300) for lang in ("en", "de")] + [("fr", "oui"), (None, "x"), ("nl", "y"), ("es", None)], "label string, text string")
    lg.model_of(rows)
    lg.model_of(rows.unionAll(rows).unionAll(rows.unionAll(rows)).unionAll(rows))
    named = rows.filter("label in ('en', 'de')").withColumn("h", lg.F.xxhash64("text"))
    least = [(r.label, r.text) for lang in ("en", "de") for r in named.filter(lg.F.col("label") == lang).orderBy("h").limit(5).collect()]
    assert seen[0] == seen[1] == sorted([*least, ("fr", "oui")])


def test_sentences_of_cards(model, spark):
    cards = spark.createDataFrame([("a", "en", "s", TEXTS["en"] + ". " + TEXTS["de"] + "! " + TEXTS["en"])], "id string, lang string, summary string, content string")
    found = lg.of_windows(cards.selectExpr("id rec_id", "content text", "lang label"), model, lg.sentences).filter("line_no > 0").collect()
    assert [(r.line_no, r.lang) for r in found] == [(2, "de")]


def test_languages_and_labels(model, spark):
    rows = [(k, v, k) for k, v in TEXTS.items()] + [("none", None, "en"), ("blank", " 12 !", "en"), ("long", TEXTS["fr"] * 400, "fr"), ("upper", TEXTS["es"].upper(), "es")]
    df = spark.createDataFrame(rows + rows[:1], "rec_id string, text string, label string")
    got = {r.rec_id: (r.lang, r.confidence) for r in lg.of_texts(df, model).collect()}
    assert {k: got[k][0] for k in TEXTS} == {k: k for k in TEXTS}
    assert got["none"] == got["blank"] == (None, None) and got["long"][0] == "fr" and got["upper"][0] == "es"
    assert all(v[1] is None or 0.5 < v[1] <= 1 for v in got.values())
    labels = ["en", "EN", "eng", "English", "en-US", "en_US", " en ", "zh-Hans", "zho", "deu", "fr_CA", "nl", "und", "", None, "xx"]
    named = spark.createDataFrame([(x,) for x in labels], "x string").select(lg.label_language(lg.F.col("x")).alias("y")).collect()
    assert [r.y for r in named] == ["en"] * 7 + ["zh", "zh", "de", "fr"] + [None] * 5


def test_windows(model, spark):
    w = "[08:00] Mina: " + TEXTS["en"] + "\n\nAster：" + TEXTS["de"] + "\nuser: the man and the house"
    df = spark.createDataFrame([("a", w, "en"), ("b", None, None), ("c", TEXTS["zh"], "en")], "rec_id string, text string, label string")
    got = {(r.rec_id, r.line_no): r.lang for r in lg.of_windows(df, model).collect()}
    assert got == {("a", 0): "en", ("a", 3): "de", ("b", 0): None, ("c", 0): "zh"}
    found = lg.of_windows(df, model).selectExpr("'conversations' tab", "*")
    assert {(r.rec_id, r.line_no, r.lang) for r in lg.wrong_labels(found).collect()} == {("a", 3, "de"), ("c", 0, "zh")}


def test_empty_tables(spark):
    cards = spark.createDataFrame([], "id string, lang string, summary string, content string")
    assert lg.languages(cards, spark.createDataFrame([], "cid string, locale string, window string")).collect() == []
    assert math.isfinite(lg.MARGIN)
