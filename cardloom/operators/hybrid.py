"""BM25 and vector similarity over the cards of a scope, fused: both lanes are ranked where a block of queries meets a block of cards.

A lane has as many ranks as pairs, so lanes are never shuffled. The first `limit` of a fusion lie among the first `_depth` of either lane,
each with its exact place in the other, however deep. A cell that has all cards of its scope tells those places itself. Of a scope of more
blocks each cell gives out its own first; what of these is first in the scope goes back to all its cells, which count how many cards of
theirs stand before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import constants as C
from cardloom.operators import fusion, lexical
from cardloom.session import written

#: Cosines that are held at a time; rows that a task gives out at a time.
COSINES, OUT_ROWS = 2_000_000, 50_000
_KNOBS = {"min_coverage": C.MIN_COVERAGE, "strong_evidence": C.STRONG_EVIDENCE, "strong_terms": None, "pool_floor": C.POOL_FLOOR}


def _depth(limit: int) -> int:
    """Beyond this place in both lanes nothing gets to the first `limit`.

    If the weightier lane has `limit` ids, those alone score more than two ranks past the depth do (1 % more, so that rounding can't tie them).
    If it has fewer, all of them are within, and so are the first `limit` of the other lane that it has not.
    """
    w = C.VECTOR_WEIGHT, C.LEXICAL_WEIGHT
    return max(2 * limit, int(1.01 * (C.RRF_K + limit) * sum(w) / max(w) - C.RRF_K) + 1)


class _Lanes:
    """Both lanes of a cell. A lane of a query: places of its cards, ascending, and keys, the largest of which is first and none of which is there twice."""

    def __init__(self, rows: pa.Table, min_cosine: float, knobs: dict):
        is_vector, no_id = pc.is_valid(rows["vector"]), pc.is_null(rows["id"])
        held, asks, vectors = rows.filter(pc.invert(no_id)), rows.filter(pc.and_(no_id, pc.invert(is_vector))), rows.filter(is_vector)
        self.held = held.take(pc.sort_indices(held, sort_keys=[("occurred_ts", "descending"), ("id", "ascending")], null_placement="at_end")).combine_chunks()
        self.asks, self.size = asks.combine_chunks(), len(held)
        if not len(held) or not len(asks):
            return
        self.least, self.of_id = int(np.ceil(round(max(min_cosine, -1) * 1e4, 6))), np.empty(self.size, np.int64)
        self.of_id[pc.sort_indices(self.held["id"]).to_numpy()] = np.arange(self.size)
        self.scores = lexical._Scores(self.held, self.asks, **_KNOBS | knobs)
        self.unit = fusion._unit(vectors["vector"].to_pandas()) if len(vectors) else np.zeros((0, 1))
        numbers = lexical._whole(vectors["vec"])
        self.at, self.asked_at = (pc.fill_null(pc.index_in(t["vec"], value_set=numbers), -1).to_numpy() for t in (self.held, self.asks))

    def __iter__(self) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
        if not self.size or not len(self.asks):
            return
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = max(1, COSINES // max(1, len(self.unit)))
        for begin in range(0, len(self.asks), step):
            mine = self.asked_at[begin : begin + step]
            own, back = np.unique(mine, return_inverse=True)
            near = np.rint(np.round(np.clip(self.unit[own] @ self.unit.T, -1, 1), 4) * 1e4).astype(np.int64) if len(self.unit) else None
            for k in range(begin, begin + len(mine)):
                lex = vec = none
                if (found := self.scores.of(k)) is not None:
                    at, score, _, _, passed = found
                    at = at[passed]
                    lex = at, self.key(np.rint(score[passed] * 1e6).astype(np.int64), at)
                if mine[k - begin] >= 0:
                    cosine = near[back[k - begin]][self.at]
                    at = np.nonzero((cosine >= self.least) & (self.at >= 0))[0]
                    vec = at, self.key(cosine[at], self.of_id[at])
                yield k, lex, vec

    def key(self, value: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A larger value is first; of equal ones the lower place."""
        return value * (self.size + 1) + (self.size - place)

    def value(self, key: np.ndarray) -> np.ndarray:
        return (key - 1) // (self.size + 1)


def _first(keys: np.ndarray, most: int) -> np.ndarray:
    return np.arange(len(keys)) if len(keys) <= most else np.argpartition(keys, -most)[-most:]


def _of(lane: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the places `at` in a lane, and which of them are in it."""
    places, keys = lane
    if not len(places):
        return np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    k = np.minimum(np.searchsorted(places, at), len(places) - 1)
    return keys[k], places[k] == at


def _before(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many keys are larger than each of `of`."""
    return len(keys) - np.searchsorted(np.sort(keys), of, "right") if len(of) else np.zeros(0, np.int64)


def _batches(rows: Iterator[tuple], lanes: _Lanes, names: list[str], make: Callable[..., list]) -> Iterator[pa.RecordBatch]:
    """Batches of (k, arrays of one length ...): the query's id and what `make` makes of the arrays."""
    out: list[tuple] = []
    waiting = 0

    def batch() -> pa.RecordBatch:
        k = pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64))
        arrays = [lanes.asks["qid"].take(k), lanes.asks["scope"].take(k), *make(*(np.concatenate([x[i] for x in out]) for i in range(1, len(out[0]))))]
        return pa.RecordBatch.from_arrays([lexical._whole(x) for x in arrays], names=names)

    for row in rows:
        if not len(row[1]):
            continue
        out.append(row)
        if (waiting := waiting + len(row[1])) >= OUT_ROWS:
            yield batch()
            out, waiting = [], 0
    if out:
        yield batch()


class _Meeting:
    """Queries (qid, owner, text, vec) and cards (owner, id, text, occurred_ts, vec) dealt to cells, with the vectors (vec, vector) that a cell's rows name."""

    def __init__(self, queries: DataFrame, cards: DataFrame, vectors: DataFrame, min_cosine: float, scope: str, knobs: dict):
        dealing = {x: knobs[x] for x in ("stopwords", "cut") if x in knobs}
        self.knobs = {x: v for x, v in knobs.items() if x not in dealing}
        self.min_cosine, self.kinds = min_cosine, {"qid": dict(queries.dtypes)["qid"], "scope": dict(cards.dtypes)[scope], "id": dict(cards.dtypes)["id"]}
        wrong = F.raise_error(F.lit("vectors must be of one size, finite and not zero")).cast(dict(vectors.dtypes)["vector"])
        self.vectors = vectors.select("vec", F.coalesce("vector", wrong).alias("vector"))
        self.texts, asked, self.many = lexical._prepared(queries, cards, ("occurred_ts", "vec"), ("vec",), scope, **dealing)
        asked = lexical._weighed(self.texts, asked, self.many, ("vec",))
        self.asked = written(asked.withColumn("df", F.when(F.col("df").isNull() | (F.col("terms") != ""), F.col("df")).otherwise(F.array().cast("array<bigint>"))), "weighed")
        self.parted = self.many.filter("nv > 1").select("scope")
        self.split = not self.parted.isEmpty()

    def run(self, cell: Callable[[_Lanes], Iterator[pa.RecordBatch]], schema: str, part: bool | None = None, marks: DataFrame | None = None) -> DataFrame:
        """`cell` for each cell: of all scopes, or of those that have more than one block of cards (or have not). marks: (qid, scope, marks)."""
        texts, asked, keep, knobs, min_cosine = self.texts, self.asked, ("vec",), self.knobs, self.min_cosine
        if self.split and part is not None:
            texts, asked = (x.join(self.parted, "scope", "left_semi" if part else "left_anti") for x in (texts, asked))
        if marks is not None:
            asked, keep = asked.join(marks, ["qid", "scope"]), ("vec", "marks")
        dealt = lexical._deal(texts, asked, self.many, ("occurred_ts", "vec"), keep)
        named = dealt.filter("vec is not null").select("scope", "q_", "v_", "vec").distinct().join(self.vectors, "vec")
        dealt = dealt.withColumn("vector", F.lit(None).cast(dict(self.vectors.dtypes)["vector"])).unionByName(named, allowMissingColumns=True)
        return lexical._by_cell(dealt, lambda rows: cell(_Lanes(rows, min_cosine, knobs)), schema)


def reasons(queries: DataFrame, cards: DataFrame, vectors: DataFrame, min_cosine: float, scope: str = "owner", **knobs) -> DataFrame:
    """(reason, n): by which lanes the candidates of `fused`, without a limit, came; only counts leave a cell."""

    def cell(lanes: _Lanes) -> Iterator[pa.RecordBatch]:
        n = np.zeros(3, np.int64)
        for _, (lex, _), (vec, _) in lanes:
            mark = np.zeros(lanes.size, bool)
            mark[lex] = True
            both = np.count_nonzero(mark[vec])
            n += both, len(vec) - both, len(lex) - both
        yield pa.RecordBatch.from_pydict({"reason": ["both", "vector_only", "lexical_only"], "n": n})

    met = _Meeting(queries, cards, vectors, min_cosine, scope, knobs)
    return met.run(cell, "reason string, n long").filter("n > 0").groupBy("reason").agg(F.sum("n").alias("n"))


def fused(queries: DataFrame, cards: DataFrame, vectors: DataFrame, limit: int, min_cosine: float, scope: str = "owner", **knobs) -> DataFrame:
    """The first `limit` of fusion.fuse per query (qid, id, lexical_rank, vector_rank, score, rank), of all ranks of both lanes.

    queries: qid, scope, text, vec; cards: scope, id, text, occurred_ts, vec; vectors: vec, vector. The lexical lane is what passes
    lexical.evaluate, the vector lane what reaches `min_cosine`; rows whose vec is no row of `vectors` are in no vector lane. Ids are
    unique in a scope, qids altogether.
    """
    met = _Meeting(queries, cards, vectors, min_cosine, scope, knobs)
    kinds, depth = met.kinds, _depth(limit)
    ids = f"qid {kinds['qid']}, scope {kinds['scope']}, id {kinds['id']}, "
    w_vec, w_lex, k_rrf = float(C.VECTOR_WEIGHT), float(C.LEXICAL_WEIGHT), float(C.RRF_K)

    def candidates(lex: tuple, vec: tuple) -> np.ndarray:
        return np.union1d(*(places[_first(keys, depth)] for places, keys in (lex, vec)))

    def ranks(lanes: _Lanes) -> Iterator[tuple]:
        for k, lex, vec in lanes:
            at = candidates(lex, vec)
            rank = []
            for lane in (lex, vec):
                keys, there = _of(lane, at)
                rank.append(np.where(there, _before(lane[1], keys) + 1, 0))
            if len(at) > limit:
                score = sum(np.where(r > 0, w / (k_rrf + r), 0.0) for w, r in zip((w_lex, w_vec), rank))
                near = score >= np.partition(score, -limit)[-limit] - 2e-6  # rounding may yet tie them
                at, rank = at[near], [r[near] for r in rank]
            yield k, at, *rank

    def whole(lanes: _Lanes) -> Iterator[pa.RecordBatch]:
        make = lambda at, lex, vec: [lanes.held["id"].take(pa.array(at)), *(pa.array(r, pa.int64(), mask=r == 0) for r in (lex, vec))]
        yield from _batches(ranks(lanes), lanes, ["qid", "scope", "id", "lexical_rank", "vector_rank"], make)

    def firsts(lanes: _Lanes) -> Iterator[tuple]:
        for k, lex, vec in lanes:
            at = candidates(lex, vec)
            (a, in_lex), (b, in_vec) = _of(lex, at), _of(vec, at)
            yield k, at, lanes.value(a), in_lex, lanes.value(b), in_vec

    def parts(lanes: _Lanes) -> Iterator[pa.RecordBatch]:
        def make(at, points, in_lex, cosine, in_vec):
            return [*(lanes.held[x].take(pa.array(at)) for x in ("id", "occurred_ts")), pa.array(points, pa.int64(), mask=~in_lex), pa.array(cosine, pa.int64(), mask=~in_vec)]

        yield from _batches(firsts(lanes), lanes, ["qid", "scope", "id", "occurred_ts", "points", "cosine"], make)

    def counted(lanes: _Lanes) -> Iterator[pa.RecordBatch]:
        if not lanes.size or not len(lanes.asks):
            return
        lists = lexical._whole(lanes.asks["marks"])
        marks, ends = pa.Table.from_batches([pa.RecordBatch.from_struct_array(lists.flatten())]), np.cumsum(pc.list_value_length(lists).to_numpy())
        lane, value, places = marks["lane"].to_numpy(), marks["value"].to_numpy(), []
        for by in ([("occurred_ts", "descending"), ("id", "ascending")], [("id", "ascending")]):  # how many cards of the cell stand before a mark
            names = [x for x, _ in by]
            both = pa.concat_tables([marks.select(names), lanes.held.select(names)])
            order = pc.sort_indices(both, sort_keys=by, null_placement="at_end").to_numpy()  # stable: a mark is before its own card
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(order >= len(lane))
            places.append(place[: len(lane)])
        key = lanes.key(value, np.where(lane == 0, *places))

        def rows() -> Iterator[tuple]:
            for k, lex, vec in lanes:
                at = np.arange(ends[k - 1] if k else 0, ends[k])
                n = np.zeros(len(at), np.int64)
                for which, (_, keys) in enumerate((lex, vec)):
                    mine = lane[at] == which
                    n[mine] = _before(keys, key[at[mine]])
                yield k, at, n

        make = lambda at, n: [marks["id"].take(pa.array(at)), pa.array(lane[at], pa.int32()), pa.array(n)]
        yield from _batches(rows(), lanes, ["qid", "scope", "id", "lane", "before"], make)

    lanes = met.run(whole, ids + "lexical_rank long, vector_rank long", False).drop("scope")
    if met.split:
        col, at = F.col, dict(met.texts.dtypes)["occurred_ts"]
        found = met.run(parts, f"{ids}occurred_ts {at}, points long, cosine long", True)
        of = lambda *order: F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long")
        found = found.withColumn("l_", of(F.desc_nulls_last("points"), F.desc_nulls_last("occurred_ts"), F.asc("id"))).withColumn("c_", of(F.desc_nulls_last("cosine"), F.asc("id")))
        held = lambda value, n: F.when(col(value).isNotNull() & (col(n) <= depth), col(n))
        found = found.withColumns({"lexical_rank": held("points", "l_"), "vector_rank": held("cosine", "c_")}).drop("l_", "c_").filter("lexical_rank is not null or vector_rank is not null")
        found = written(found, "found")
        mark = lambda lane, value: F.struct(F.lit(lane).alias("lane"), col(value).alias("value"), "occurred_ts", "id")
        deep = found.select("qid", "scope", F.explode(F.array_compact(F.array(F.when(col("points").isNotNull() & col("lexical_rank").isNull(), mark(0, "points")), F.when(col("cosine").isNotNull() & col("vector_rank").isNull(), mark(1, "cosine"))))).alias("m"))
        deep = deep.groupBy("qid", "scope").agg(F.collect_list("m").alias("marks"))  # at most twice the depth
        before = met.run(counted, ids + "lane int, before long", True, deep)
        one = lambda lane: (F.sum(F.when(col("lane") == lane, col("before"))) + 1)
        before = before.groupBy("qid", "id").agg(one(0).alias("l_"), one(1).alias("c_"))
        told = found.join(before, ["qid", "id"], "left").select("qid", "id", F.coalesce("lexical_rank", "l_").alias("lexical_rank"), F.coalesce("vector_rank", "c_").alias("vector_rank"))
        lanes = lanes.unionByName(told)
    return fusion.scored(lanes).filter(F.col("rank") <= limit)
