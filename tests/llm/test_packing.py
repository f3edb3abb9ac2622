import numpy as np

from cardloom.llm import packing


def test_sum_of_squares_is_the_best_choice_each_time():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 11, 300)
    where, gaps = packing.sum_of_squares(sizes, 10)
    content, count = {}, np.zeros(11, dtype=int)
    for s, b in zip(sizes, where):
        gap = 10 - sum(content.get(b, []))
        assert s <= gap

        def cost(g):
            c = count.copy()
            if g < 10:
                c[g] -= 1
            if g - s > 0:
                c[g - s] += 1
            return (c[1:] ** 2).sum()

        open_ = [g for g in range(int(s), 10) if count[g]]
        assert cost(gap) == min(cost(g) for g in [*open_, 10])
        if gap < 10:
            count[gap] -= 1
        if gap - s > 0:
            count[gap - s] += 1
        content.setdefault(b, []).append(int(s))
    assert all(10 - sum(v) == gaps[b] for b, v in content.items())


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 40)  # several shards and rounds
    rng = np.random.default_rng(2)
    items = [(k, int(n)) for k, n in enumerate(rng.integers(0, 260, 300))] + [(1000, None), (1001, 950), (1002, 100), (1003, -5)]
    sizes = spark.createDataFrame(items + items[:3] + [(None, 5)], "doc_id bigint, n_tokens bigint")
    budgets = spark.createDataFrame([("small", 100), ("large", 400), ("none", 0)], "budget string, capacity bigint")
    rows = packing.pack(sizes, budgets).collect()
    want = {k: max(0, n or 0) for k, n in items}
    for name, capacity in (("small", 100), ("large", 400)):
        mine = [r for r in rows if r.budget == name]
        total, boxes = {}, {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            assert (r.container is None) == (r.n_tokens == 0)
            if r.container:
                boxes.setdefault(r.container, []).append(r)
        assert total == want
        for box in boxes.values():
            used = sum(r.n_tokens for r in box)
            assert used <= capacity and {r.gap for r in box} == {capacity - used}
        for doc, n in want.items():
            parts = [r.n_tokens for r in mine if r.doc_id == doc]
            assert len(parts) == max(1, -(-n // capacity))
        assert sum(want.values()) / (len(boxes) * capacity) > 0.93
    assert "none" not in {r.budget for r in rows}
    assert packing.pack(sizes.limit(0), budgets).collect() == []
