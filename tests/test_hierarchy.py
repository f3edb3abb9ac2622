import random

from cardloom.operators import hierarchy as h

SCHEMA = "id string, superseded_by string, supersedes array<string>, node string, parent string"


def brute(parent):
    out = {}
    for i in set(parent) | set(parent.values()):
        path, x = [i], i
        while x in parent and parent[x] not in path:
            x = parent[x]
            path.append(x)
        if x in parent:
            ring = path[path.index(parent[x]) :]
            inside = path[: path.index(parent[x]) + 1]
            out[i] = (min(ring), inside[::-1], i in ring)
        else:
            out[i] = (x, path[::-1], False)
    return out


def check(spark, parent, monkeypatch=None):
    rows = [(i, parent.get(i), None, "clash", "clash") for i in set(parent) | set(parent.values())]
    df = spark.createDataFrame(rows + rows[:2], SCHEMA)
    want = brute(parent)
    got = {r.id: r for r in h.paths(df).collect()}
    assert set(got) == set(want)
    for i, (root, path, ring) in want.items():
        assert (got[i].root_id, got[i].path, got[i].on_circle) == (root, path, ring)
        assert got[i].depth == len(path) - 1
        assert got[i].descendants == sum(p[0] != i and i in p[1][:-1] for p in ((k, v[1]) for k, v in want.items()))


def test_random_forests_with_circles(spark):
    rng = random.Random(3)
    ids = [f"m_{k:03d}" for k in range(60)]
    parent = {}
    for k, i in enumerate(ids):
        if rng.random() < 0.8:
            parent[i] = ids[rng.randrange(k)] if k and rng.random() < 0.9 else rng.choice(ids)
    check(spark, parent)


def test_chain_star_and_loops(spark):
    parent = {f"c{k:02d}": f"c{k + 1:02d}" for k in range(20)} | {f"s{k}": "star" for k in range(30)} | {"self": "self", "x": "y", "y": "z", "z": "x", "below": "y"}
    check(spark, parent)


def test_references(spark):
    rows = [
        ("m_1", " M_2 ", None, "", ""),
        ("m_2", None, [None, "", "M_3", "nowhere", "m_3"], "", ""),
        ("m_3", "absent", None, "", ""),
        ("m_4", None, None, "", ""),
        ("m_5", "m_1", ["m_4"], "", ""),
        (None, "m_1", ["m_4"], "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.child, r.parent) for r in h.parents(df).collect()} == {("m_1", "m_2"), ("m_3", "m_2"), ("m_5", "m_1"), ("m_4", "m_5")}
    assert {(r.id, r.root_id) for r in h.roots(df).collect()} == {(f"m_{k}", "m_2") for k in range(1, 6)}


def test_empty(spark):
    assert h.paths(spark.createDataFrame([], SCHEMA)).collect() == []


def test_descendants_are_a_query(spark, tmp_path):
    from cardloom.plans import problems

    up = {"b": "a", "c": "b", "d": "b", "e": "d", "g": "f"}
    rows = [(i, up.get(i), None) for i in "abcdefgh"]
    spark.createDataFrame(rows, "id string, superseded_by string, supersedes array<string>").write.parquet(f"{tmp_path}/cards.parquet")
    want = set()
    for i in up:
        at, n = i, 0
        while at in up:
            at, n = up[at], n + 1
            want.add((at, i, n))
    got = [tuple(r) for r in problems.QUERIES["p6_descendants"](spark, str(tmp_path)).select("ancestor", "descendant", "distance").collect()]
    assert len(got) == len(want) and set(got) == want
