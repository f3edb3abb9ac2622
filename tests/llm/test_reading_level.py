import random

import numpy as np

from cardloom.llm import reading_level as rl

EASY = "cat dog run sun red hat big box".split()
HARD = "epistemic latent asymptotic provenance hermeneutic idempotent contingent taxonomy".split()
BASE = "the and of with on it was for".split()


def text(rng, level, n=60):
    hard = (level - 1) / 3
    return " ".join(rng.choice(BASE) if rng.random() < 0.4 else rng.choice(HARD) if rng.random() < hard else rng.choice(EASY) for _ in range(n))


def test_levels(spark):
    rng = random.Random(1)
    docs = [(k, text(rng, k % 4 + 1)) for k in range(400)] + [(900, None), (901, ""), (902, "too short"), (903, "教" * 300), (904, "zzz qqq " * 60)]
    grades = [(k, min(4, max(1, k % 4 + 1 + rng.choice((0,) * 12 + (1, -1)))), "r") for k in range(0, 200)] + [(0, 1, "s"), (5000, 4, "r"), (1, None, "r")]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, level string")
    g = spark.createDataFrame(grades, "doc_id bigint, level int, rater string")
    got = {r.doc_id: r.level for r in rl.levels(d, g).collect()}
    assert len(got) == len(docs) and got[900] is got[901] is got[902] is None and got[903] and got[904]
    held = [k for k in range(200, 400)]
    assert sum((got[k] == 4) == (k % 4 == 3) for k in held) >= 0.95 * len(held)
    assert sum(abs(got[k] - (k % 4 + 1)) <= 1 for k in held) == len(held)


def test_no_grades_and_empty(spark):
    d = spark.createDataFrame([(1, "word " * 60)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, level int")
    assert rl.levels(d, none).first().level in (2, 3)
    assert rl.levels(d.limit(0), none).collect() == []


def test_likelihood_rises_and_abilities_are_ordered(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([(k, text(rng, k % 4 + 1)) for k in range(160)], "doc_id bigint, text string")
    g = spark.createDataFrame([(k, k % 4 + 1) for k in range(160)] + [(0, 2)], "doc_id bigint, level int")
    m = rl.fit(d, g)
    assert all(b >= a - 1e-9 for a, b in zip(m.likelihood, m.likelihood[1:])) and len(m.likelihood) > 2
    assert list(m.abilities) == sorted(m.abilities)
    assert m.difficulty[m.index["epistemic"]] > m.difficulty[m.index["the"]] > m.difficulty[m.index["cat"]]


def test_distributed_slopes_are_those_of_the_likelihood(spark):
    rng = random.Random(3)
    d = spark.createDataFrame([(k, text(rng, k % 4 + 1)) for k in range(40)], "doc_id bigint, text string")
    graded = rl._Graded(d, spark.createDataFrame([(k, k % 4 + 1) for k in range(40)], "doc_id bigint, level int"))
    tau, b = np.array([-1.0, 0.2, 1.5]), np.linspace(-2, 2, len(graded.words))
    value = lambda b: (lambda f: rl._likelihood(f[:, -1], tau, f[:, :-1], b) + (b @ b) / (2 * rl.PRIOR**2))(graded.means(b))
    slope = graded.slopes(b, tau)[0]
    for w in (0, 5, len(b) - 1):
        step = np.eye(len(b))[w] * 1e-4
        assert abs((value(b + step) - value(b - step)) / 2e-4 - slope[w]) < 1e-5


def test_one_level_only(spark):
    d = spark.createDataFrame([(k, "plain words here " * 20) for k in range(6)], "doc_id bigint, text string")
    got = rl.levels(d, spark.createDataFrame([(k, 4) for k in range(4)], "doc_id bigint, level int")).collect()
    assert {r.level for r in got} == {4}
