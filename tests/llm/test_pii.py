import itertools

from cardloom.llm import pii
from cardloom.llm.pii_seeds import SEEDS

LEX = pii.Lexicon({"Nora", "Hugo", "Ilse", "Lucía", "晚晴"}, {"Velmoor", "Stein-Berg", "Río"})


def spans(text):
    return [(text[s:e], k) for s, e, k in pii.find(text, LEX, pii.weights())]


def test_kinds_and_boundaries():
    assert spans("Call Nora B. Velmoor at (212) 555-0100, or n.velmoor+x@mail.lake.test.") == [("Nora B. Velmoor", "name"), ("(212) 555-0100", "phone"), ("n.velmoor+x@mail.lake.test", "email")]
    assert spans("Her new address is 12B N. Lake St., third floor.") == [("12B N. Lake St.", "address")]
    assert spans("My passport number is 666-12-3456; order 4263-0277-309 and Nora are fine.") == [("666-12-3456", "id_number")]
    assert spans("联系人林晚晴现在住在湖山路15号，电话 12012345678 。邻居晚晴也在。") == [("林晚晴", "name"), ("湖山路15号", "address"), ("12012345678", "phone")]
    assert spans("HUGO VELMOOR wohnt jetzt in der Nähe, Am Seeplatz 14a.") == [("HUGO VELMOOR", "name"), ("Am Seeplatz 14a", "address")]
    assert spans("Nora sold it to Hugo. Update 2.17.4 of np-12345678 cost 1234567890123456.") == []


def test_seeds_are_found():
    lex = pii.Lexicon({"Anna", "Marta", "Paul", "Lena", "Oskar", "Julie", "Karim", "Sofía", "Pedro", "Ingrid", "Tom", "小雨", "志远", "思源"}, {"Fielding", "Harrow-Smith", "Okafor", "Brandauer", "Lefèvre", "Marchand", "Ibarra", "Solano"})
    right = 0
    for marked in SEEDS:
        text, gold = pii._unlabel(marked)
        right += set(pii.find(text, lex, pii.weights())) == gold
    assert right >= 0.97 * len(SEEDS)


def test_best_set_equals_brute_force():
    w = pii.weights()
    text = "Call back Nora Velmoor at +1 212 555 0100 about DNI 00012345A and 0612345678, 5 Lake Row."
    cands = pii._candidates(text, LEX)
    best, top = [], 0.0
    for r in range(len(cands) + 1):
        for some in itertools.combinations(cands, r):
            if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(some, 2)):
                v = sum(w.get(f, 0) for c in some for f in c[3])
                if v > top:
                    best, top = sorted((c[0], c[1], c[2]) for c in some), v
    assert pii.find(text, LEX, w) == best


def test_marginals_sum_to_one_over_rivals():
    text = "Text me: 555 012 345."
    cands = pii._candidates(text, LEX)
    p = pii._marginals(cands, [1.0] * len(cands))
    assert all(0 < x < 1 for x in p)


def test_frames(spark):
    texts = [("cards", "a", "Write to x@y.test."), ("cards", "b", None), ("cards", "c", ""), ("specifics", "d", "no data " * 5000 + "Text me: 07700 900123.")]
    df = spark.createDataFrame([(*t, "clash") for t in texts + texts[:1]], "tab string, rec_id string, text string, kind string")
    names = spark.createDataFrame([("Nora", "en"), (None, None)], "given string, lang string")
    assert {tuple(r) for r in pii.personal_data(df, names).collect()} == {("cards", "a", "email", "x@y.test"), ("specifics", "d", "phone", "07700 900123")}
    clean = {r.rec_id: r.redacted for r in pii.scan(df, pii.lexicon(df, names)).collect()}
    assert clean["a"] == "Write to [EMAIL]." and clean["b"] is None and clean["c"] == ""
    assert pii.personal_data(df.limit(0), names).collect() == []


def test_names_are_learned():
    texts = ["My sister Zelda saw my cousin Nora. Zelda Quorn came.", "My sister Zelda and Nora Quorn left.", "My sister Zelda met Nora Quorn."] * 2
    lex = pii.learn(texts, {"Nora"})
    assert "Zelda" in lex.given and "quorn" in lex.surnames


def test_names_are_learned_from_all_texts(spark):
    letters = "bdfgklmnprstvz"
    rare = [f"Q{a}u{b}i{c}en" for a, b, c in itertools.product(letters, letters, "klm")]
    texts = [f"Note {k}: then Nora {s} came." for s in rare for k in (1, 2)] + [f"Note {k}: my sister Zelda met my cousin Nora and 邻居晚晴." for k in range(3)] + [f"plain text {k}" for k in range(30_000)]
    df, names = spark.createDataFrame([(t,) for t in texts * 2], "text string").repartition(8), spark.createDataFrame([("Nora",), ("晚晴",), (None,)], "given string")
    got, want = pii.lexicon(df, names), pii.learn(texts, {"Nora", "晚晴"})
    assert {s.lower() for s in rare} <= got.surnames
    assert (got.given, got.han, got.surnames) == (want.given, want.han, want.surnames) and "Zelda" in got.given


def test_long_addresses_are_found_whole():
    address = "first.last-" + "a" * 50 + "@" + ".".join(["subdomain" * 4] * 3) + ".example"
    lex, w = pii.Lexicon({"Anna"}), pii.weights()
    assert 90 < len(address) <= pii.MOST_CHARS
    assert [f"write to {address} soon"[s:e] for s, e, _ in pii.find(f"write to {address} soon", lex, w)] == [address]


def test_few_words_are_searched_for_cues(monkeypatch):
    import itertools
    import re

    shape = pii._PERSON_BEFORE
    said = ["dr.", "Dr", "MRS.", "signed by", "Herr", "señor", "señora", "caser", "casera", "firmó", "llamada a", "amiga", "AMIGO", "联系人", "名叫", "the", "red", "by", "r", "", "Kipra", "mſ.", "docteur"]
    for a, b in itertools.product(said, ["", " ", ", ", ":", " \n", "\n", "  ", "; ", ",: ", "\t"]):
        assert pii._person_before(f"x {a}{b}"[-16:]) == bool(shape.search(f"x {a}{b}"[-16:])), (a, b)
    seen = []

    class Counting:
        def search(self, text):
            seen.append(text)
            return re.Pattern.search(shape, text)

    monkeypatch.setattr(pii, "_PERSON_BEFORE", Counting())
    pii._candidates("Signed by Wilma Moss. " + "The Old Mill at Kipside was Long Gone. " * 50, pii.Lexicon({"Anna"}))
    assert 1 <= len(seen) < 50
