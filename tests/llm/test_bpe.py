import random

import pytest

tiktoken = pytest.importorskip("tiktoken")

from cardloom.llm import bpe  # noqa: E402

TEXTS = [None, "", " ", "a", "The kid's 123 cats  \n\n sat.", "教练藏起了收音机，因为价钱合适。", "naïve é🙂​\xa0 x", "<|endoftext|>", "\ud800"]


@pytest.fixture(scope="module")
def public():
    e = bpe.encoder()
    return tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=e.ranks, special_tokens={})


def test_same_ids_as_the_public_library(public):
    rng = random.Random(1)
    e = bpe.encoder()
    for t in TEXTS[:-1]:
        assert e.encode(t) == public.encode_ordinary(t or "")
    for _ in range(500):
        t = "".join(rng.choice("aabcde é一的 xy\ń١½$_'st") for _ in range(rng.randint(1, 80)))
        assert e.encode(t) == public.encode_ordinary(t), t


def test_very_long_pretokens(public):
    rng = random.Random(2)
    for t in ("a" * 30_000, "".join(rng.choice("abcdethn") for _ in range(30_000))):
        assert bpe.encoder().merge(t.encode()) == public.encode_ordinary(t)


def test_rank_queue_pops_in_order():
    q, rng = bpe.RankQueue(60_000), random.Random(3)
    pushed = [(rng.randrange(60_000), k) for k in range(5_000)]
    for rank, k in pushed:
        q.push(rank, k)
    out = []
    while (top := q.pop()) is not None:
        out += [(top[0], k) for k in top[1]]
    assert [r for r, _ in out] == sorted(r for r, _ in pushed) and sorted(out) == sorted(pushed)


def test_frames(spark):
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(TEXTS[:-1])] * 2, "doc_id bigint, text string, ids string")
    rows = bpe.encode(df).collect()
    assert len(rows) == 2 * len(TEXTS[:-1])
    assert {r.doc_id: list(r.ids) for r in rows} == {k: bpe.encoder().encode(t) for k, t in enumerate(TEXTS[:-1])}
    sizes = {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()}
    assert sizes[0] == sizes[1] == 0 and sizes[4] == len(bpe.encoder().encode(TEXTS[4]))
    assert bpe.encode(df.limit(0)).collect() == []
