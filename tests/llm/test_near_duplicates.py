import random

import numpy as np
import pytest

from cardloom.llm import near_duplicates as nd


def corpus(n=160):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)] + list("山水云月风花雪木火土金石")
    texts = {}
    for k in range(n):
        if k % 3 and texts:
            base = rng.choice(list(texts.values())).split()
            for _ in range(rng.randrange(8)):
                at = rng.randrange(len(base))
                base[at : at + rng.choice((0, 1))] = [rng.choice(vocabulary)]
            rng.shuffle(base)
            texts[f"d{k:03d}"] = " ".join(base)
        else:
            texts[f"d{k:03d}"] = " ".join(rng.sample(vocabulary, rng.randrange(8, 50)))
    return texts


def brute(texts, least=0.7):
    sets = {i: set(nd.words(t or "")) for i, t in texts}
    pairs = set()
    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x + 1, len(ids)):
            a, b = sets[ids[x]], sets[ids[y]]
            if a | b and len(a & b) >= least * len(a | b) - 1e-9:
                pairs.add((ids[x], ids[y]))
    return pairs


@pytest.mark.parametrize("shard_rows", [20_000, 12])
def test_pairs_equal_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(nd, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(nd, "COUNTED", 1)
    texts = [*corpus().items(), ("empty", ""), ("null", None), ("blank", " .,; "), ("copy1", "a b c"), ("copy2", "C b, a"), ("long", "x " * 20000 + "y")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts + texts[:5]], "id string, text string, d string")
    got = {tuple(r) for r in nd.near_pairs(df).collect()}
    assert got == brute(texts) and ("copy1", "copy2") in got


def test_classes(spark):
    df = spark.createDataFrame([("a", "1 2 3 4 5 6 7 8 9 10"), ("b", "1 2 3 4 5 6 7 8 9 11"), ("c", "1 2 3 4 5 6 7 8 12 11"), ("d", "x y z"), ("e", "z y x"), ("f", None)], "id string, text string")
    got = {r.id: (r.class_id, r.n_links, r.n_copies) for r in nd.classes(df).collect()}
    assert got == {"a": ("a", 1, 1), "b": ("a", 2, 1), "c": ("a", 1, 1), "d": ("d", 0, 2), "e": ("d", 0, 2)}


def test_trees_find_what_comparing_all_finds():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    f = np.repeat(base, 20)
    for _ in range(4):
        f = np.where(rng.random(len(f)) < 0.7, f ^ (np.uint64(1) << rng.integers(0, 64, len(f)).astype(np.uint64)), f)
    zero, n = np.zeros(len(f), dtype=np.uint64), rng.choice([9, 10, 11, 40, 4094], len(f))

    def pairs(s):
        return {(min(a, b), max(a, b)) for x, y in zip(s.left, s.right) for a, b in zip(x.tolist(), y.tolist())}

    for shard in (np.zeros(len(f), np.int64), np.arange(len(f)) // 37, np.arange(len(f)) // 2):
        trees, every = nd._Forest(f, zero, zero, n, 0.7), nd._Forest(f, zero, zero, n, 0.7)
        trees.search(shard)
        i, j = np.triu_indices(len(f), 1)
        every.near(*(x[shard[i] == shard[j]] for x in (i, j)))
        assert pairs(trees) == pairs(every) and trees.compared <= every.compared
        assert pairs(every) or len(set(shard)) > 100


def test_sizes_are_told_within_their_bounds():
    n = np.array([1, 2047, 2048, 2049, 4095, 5000, 99_999, 524_287, 600_000])
    code = nd._size_code(n)
    assert (nd._LOW[code] <= n).all() and (nd._HIGH[code] >= n).all() and code.max() < 4096
    assert (nd._HIGH[code][:-2] <= 1.01 * n[:-2] + 1).all()


def test_very_long_texts_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(nd, "COPIES", 4)
    long = [f"v{k}" for k in range(6000)]
    texts = [("a", " ".join(long)), ("b", " ".join(long[:4300])), ("c", " ".join(long[1000:]))] + [(f"k{k:02d}", "same few words") for k in range(13)]
    got = {tuple(r) for r in nd.near_pairs(spark.createDataFrame(texts, "id string, text string")).collect()}
    assert got == brute(texts) and ("a", "b") in got and ("k00", "k12") in got


def test_components_and_empty(spark):
    edges = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(30)] + [("x", "y")]
    got = {r.node: r.component for r in nd.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert set(got.values()) == {"n00", "x"} and got["n30"] == "n00"
    empty = spark.createDataFrame([], "id string, text string")
    assert nd.near_pairs(empty).collect() == [] and nd.classes(empty).collect() == []


def test_pairs_in_shards_grow_slower_than_the_square():
    rng = np.random.default_rng(5)
    # unrelated texts of one language: each has about 51 of 170 words
    sets = [np.flatnonzero(rng.random(170) < 0.3).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2000)]
    h, ends = np.concatenate(sets), np.cumsum([len(s) for s in sets])

    def share(of):
        rows, bands = nd.plan(of, 0.7)
        assert (1 - 0.7**rows) ** bands <= nd.MISSED
        keys = nd._Bands(0, bands, rows).keys(h, ends)
        many = [np.unique(keys[:, k], return_counts=True)[1] for k in range(bands)]
        return sum(int((m * (m - 1)).sum()) for m in many) / (len(sets) * (len(sets) - 1))

    few, more, most = share(2000), share(2_000_000), share(20_000_000)
    assert few < 0.6 * 24 * 0.18**3 and more < few / 2 and most < more / 2


def test_keys_do_not_depend_on_rounds_batches_or_the_order_of_words(monkeypatch):
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 7, 400, 3, 1500, 50)]
    ends = np.cumsum([len(s) for s in sets])
    whole = nd._Bands(0, 37, 4).keys(np.concatenate(sets), ends)
    assert (np.concatenate([nd._Bands(a, b, 4).keys(np.concatenate(sets), ends) for a, b in ((0, 12), (12, 24), (24, 37))], axis=1) == whole).all()
    monkeypatch.setattr(nd, "_WORDS", 100)
    assert (nd._Bands(0, 37, 4).keys(np.concatenate([s[::-1] for s in sets]), ends) == whole).all()
