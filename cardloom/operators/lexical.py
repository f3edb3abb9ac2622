"""BM25 over many queries and many scopes at once.

A scope is the candidate pool of a query (the cards of one owner, say): lengths, document frequencies and counts are those of the scope.
Terms of a query that no card has count with the largest weight in its coverage. `cut` makes terms of a text: the default tokenizer, or
text.terms, the simple one.

Each text is cut once, into a table of its terms. Pairs are as many as a scope's queries times its cards, so they are never shuffled: a
block of a scope's queries meets a block of its cards in one task (a cell), posting list by posting list, and only what a caller needs
leaves the task: all pairs, those that pass, the best of each query, those that can get a seat, or counts. A cell that has all cards of
its scope counts documents and frequencies itself; only of scopes of more than one block of cards are they counted and joined before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import constants as C
from cardloom.functions.tokenizer import terms
from cardloom.session import written

Cut = Callable[[Column], Column]

#: Cards and queries of a cell, at most about; rows that a task gives out at a time.
CARD_BLOCK, ASK_BLOCK, OUT_ROWS = 20_000, 4_000, 50_000
#: Joins the terms of a text in a table and in what is shuffled; no term has it.
SIGN = "\n"


def postings(cards: DataFrame, scope: str = "owner", cut: Cut = terms) -> DataFrame:
    """(scope, id, term, tf) of cards (scope, id, text). The id must be unique in its scope; rows without one are left out."""
    rows = cards.filter(F.col("id").isNotNull()).select(F.col(scope).alias("scope"), "id", F.explode(cut(F.col("text"))).alias("term"))
    return rows.groupBy("scope", "id", "term").agg(F.count("*").alias("tf"))


def pool(cards: DataFrame, scope: str = "owner") -> DataFrame:
    """(scope, n) per scope: cards, those without words too."""
    return cards.filter(F.col("id").isNotNull()).groupBy(F.col(scope).alias("scope")).agg(F.count("*").alias("n"))


def query_terms(queries: DataFrame, scope: str = "owner", stopwords: tuple[str, ...] = C.STOPWORDS, cut: Cut = terms) -> DataFrame:
    """(qid, scope, term), distinct and without stop words."""
    rows = queries.select("qid", F.col(scope).alias("scope"), F.explode(F.array_distinct(cut(F.col("text")))).alias("term"))
    return rows.filter(~F.col("term").isin(*stopwords)) if stopwords else rows


def _whole(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


def _split(joined: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Lists of the terms that SIGN joins; of an empty text an empty one."""
    lists = _whole(pc.split_pattern(_whole(joined), SIGN))
    return _whole(pc.if_else(pc.equal(_whole(joined), ""), pa.scalar([], lists.type), lists))


def _idf(n: float, df: np.ndarray | int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _prepared(queries: DataFrame, cards: DataFrame, keep: tuple[str, ...], ask_keep: tuple[str, ...] = (), scope: str = "owner", stopwords: tuple[str, ...] = C.STOPWORDS, cut: Cut = terms) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What cells are dealt from, all written: terms of the cards, terms of the queries, and the scopes of more than one block."""
    col = F.col
    joined = lambda words: F.array_join(words, SIGN)
    texts = cards.filter(col("id").isNotNull() & col(scope).isNotNull()).select(col(scope).alias("scope"), "id", joined(cut(col("text"))).alias("terms"), *keep)
    texts = written(texts, "terms")
    distinct = F.array_distinct(cut(col("text")))
    distinct = F.filter(distinct, lambda w: ~w.isin(*stopwords)) if stopwords else distinct
    asked = queries.filter(col(scope).isNotNull()).select("qid", col(scope).alias("scope"), joined(distinct).alias("terms"), *ask_keep)
    asked = written(asked, "asked")
    # Only scopes of more than one block are sent to all tasks: one for CARD_BLOCK cards or ASK_BLOCK queries at least.
    words = F.when(col("terms") == "", 0).otherwise(F.size(F.split("terms", SIGN)))
    many = asked.groupBy("scope").agg(F.count("*").alias("q")).join(texts.groupBy("scope").agg(F.count("*").alias("n"), F.sum(words).alias("total")), "scope")
    many = many.select("scope", F.ceil(col("q") / ASK_BLOCK).cast("int").alias("nq"), F.ceil(col("n") / CARD_BLOCK).cast("int").alias("nv"), "n", "total").filter("nq > 1 or nv > 1")
    return texts, asked, F.broadcast(written(many, "blocks"))


def _weighed(texts: DataFrame, asked: DataFrame, many: DataFrame, ask_keep: tuple[str, ...] = ()) -> DataFrame:
    """The queries with document frequencies (df, in the order of the terms), where a cell has not all cards of its scope and can't count them itself."""
    col = F.col
    parted = many.filter("nv > 1").select("scope")
    df = texts.join(parted, "scope", "left_semi").select("scope", F.explode(F.array_distinct(F.split("terms", SIGN))).alias("term")).groupBy("scope", "term").agg(F.count("*").alias("df"))
    here = asked.join(parted, "scope", "left_semi")
    sought = here.select("qid", "scope", F.explode(F.split("terms", SIGN)).alias("term")).join(df, ["scope", "term"], "left")
    sought = sought.groupBy("qid", "scope").agg(F.sort_array(F.collect_list(F.struct("term", F.coalesce("df", F.lit(0)).alias("df")))).alias("t"))
    sought = sought.select("qid", "scope", F.array_join(col("t.term"), SIGN).alias("terms"), col("t.df").alias("df"))
    sought = sought.join(here.select("qid", "scope", *ask_keep), ["qid", "scope"]) if ask_keep else sought
    alone = asked.join(parted, "scope", "left_anti").select("qid", "scope", "terms", F.lit(None).cast("array<bigint>").alias("df"), *ask_keep)
    return alone.unionByName(sought)


def _deal(texts: DataFrame, q: DataFrame, many: DataFrame, keep: tuple[str, ...], ask_keep: tuple[str, ...] = ()) -> DataFrame:
    """Cards and queries (no id) with the cells they go to: scope, q_, v_."""
    kinds, asks = dict(texts.dtypes), dict(q.dtypes)
    own = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    c = texts.join(many, "scope", "left").withColumn("v_", own("id", F.col("nv"))).withColumn("q_", every(F.col("nq")))
    q = q.join(many, "scope", "left").withColumn("q_", own("qid", F.col("nq"))).withColumn("v_", every(F.col("nv")))
    none = lambda kind: F.lit(None).cast(kind)
    more = tuple(dict.fromkeys([*keep, *ask_keep]))
    c = c.select("scope", "q_", "v_", none(asks["qid"]).alias("qid"), "id", "terms", none("array<bigint>").alias("df"), none("bigint").alias("n"), none("bigint").alias("total"), *(x if x in keep else none(asks[x]).alias(x) for x in more))
    q = q.select("scope", "q_", "v_", "qid", none(kinds["id"]).alias("id"), "terms", "df", "n", "total", *(x if x in ask_keep else none(kinds[x]).alias(x) for x in more))
    return c.unionAll(q)


def _by_cell(dealt: DataFrame, cell: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `cell` gives out of the rows of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not len(b):
                continue
            key = [b.column(x).to_pylist() if x == "scope" else b.column(x).to_numpy() for x in ("scope", "q_", "v_")]
            n, begin = len(b), 0
            for k in range(n):
                now = (key[0][k], key[1][k], key[2][k])
                if now != last:
                    if k > begin:
                        parts.append(b.slice(begin, k - begin))
                    if parts:
                        yield from cell(pa.Table.from_batches(parts))
                    parts, begin, last = [], k, now
            parts.append(b.slice(begin))
        if parts:
            yield from cell(pa.Table.from_batches(parts))

    return dealt.repartition("scope", "q_", "v_").sortWithinPartitions("scope", "q_", "v_").mapInArrow(run, schema)


class _Scores:
    """Scores of the cards of a cell (in the order of `held`) for each of its queries."""

    def __init__(self, held: pa.Table, asks: pa.Table, min_coverage: float, strong_evidence: float, strong_terms: int | None, pool_floor: int):
        self.size, self.min_coverage = len(held), min_coverage
        lists = [_split(t["terms"]) for t in (held, asks)]
        words = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        codes, n_codes = words.indices.to_numpy(), len(words.dictionary)
        lens = pc.list_value_length(lists[0]).to_numpy()
        of_cards, self.of_asks = codes[: lens.sum()].astype(np.int64), codes[lens.sum() :]
        sought = np.zeros(n_codes, bool)
        sought[self.of_asks] = True
        hit = sought[of_cards]
        keys, tf = np.unique(of_cards[hit] * self.size + np.repeat(np.arange(self.size), lens)[hit], return_counts=True)
        term, self.card = np.divmod(keys, self.size)
        self.starts = np.searchsorted(term, np.arange(n_codes + 1))
        asked_lens = pc.list_value_length(lists[1]).to_numpy()
        n, total = (asks[x][0].as_py() for x in ("n", "total"))  # as for all of the scope
        n, total = (self.size, int(lens.sum())) if n is None else (n, total)
        self.weight = tf * (C.K1 + 1) / (tf + C.K1 * (1 - C.B + C.B * lens[self.card] / (total / n)))
        df = _whole(asks["df"]).flatten().to_numpy() if asks["df"].null_count == 0 else (self.starts[1:] - self.starts[:-1])[self.of_asks]
        self.idf, self.cidf = _idf(n, df), _idf(max(n, pool_floor), df)
        self.mass = np.bincount(np.repeat(np.arange(len(asks)), asked_lens), self.cidf, len(asks))
        scale = 1.0 if strong_terms is None else np.sqrt(np.maximum(1.0, asked_lens / float(strong_terms)))
        self.floor = np.full(len(asks), float(strong_evidence)) * _idf(n, 0) * scale
        self.ends = np.cumsum(asked_lens)

    def of(self, k: int) -> tuple[np.ndarray, ...] | None:
        """Of query k: places of the cards that share a term, score, coverage, matched, passed; None without any."""
        mine = slice(self.ends[k - 1] if k else 0, self.ends[k])
        begin = self.starts[self.of_asks[mine]]
        many = self.starts[self.of_asks[mine] + 1] - begin
        if not (length := many.sum()):
            return None
        post = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(length)
        ix = self.card[post]
        matched = np.bincount(ix, minlength=self.size)
        at = np.nonzero(matched)[0]
        score = np.bincount(ix, np.repeat(self.idf[mine], many) * self.weight[post], self.size)[at]
        coverage = np.bincount(ix, np.repeat(self.cidf[mine], many), self.size)[at] / self.mass[k]
        return at, _rounded(score), coverage, matched[at], (coverage >= self.min_coverage) | (score >= self.floor[k])


def _cells(
    queries: DataFrame,
    cards: DataFrame,
    pick: str,
    limit: int = 0,
    keep: tuple[str, ...] = (),
    scope: str = "owner",
    stopwords: tuple[str, ...] = C.STOPWORDS,
    min_coverage: float = C.MIN_COVERAGE,
    strong_evidence: float = C.STRONG_EVIDENCE,
    strong_terms: int | None = None,
    pool_floor: int = C.POOL_FLOOR,
    cut: Cut = terms,
) -> DataFrame:
    """(qid, scope, id, score, coverage, matched, passed, keep) of the pairs that `pick` lets out of their cell; a row without id, with the
    pairs and the passing ones of a query and cell as `matched` and `found`, if it counts.

    pick: 'all', 'passed', 'best' (the first `limit` of those that pass), 'any' (the first `limit`), 'seats' or 'none', and '+' to count too.
    """
    kinds = dict(cards.dtypes)
    texts, asked, many = _prepared(queries, cards, keep, (), scope, stopwords, cut)
    dealt = _deal(texts, _weighed(texts, asked, many).filter("terms <> ''"), many, keep)
    counts, how = pick.endswith("+"), pick.rstrip("+")

    def cell(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        is_query = pc.is_null(rows["id"])
        held, asks = rows.filter(pc.invert(is_query)), rows.filter(is_query)
        if not len(held) or not len(asks):
            return
        by = [("occurred_ts", "descending")] if "occurred_ts" in keep else []
        held = held.take(pc.sort_indices(held, sort_keys=[*by, ("id", "ascending")], null_placement="at_end")).combine_chunks()  # a card's place settles ties
        asks = asks.combine_chunks()
        size = len(held)
        scores = _Scores(held, asks, min_coverage, strong_evidence, strong_terms, pool_floor)
        if how == "seats":
            turning = pc.fill_null(pc.equal(held["role"], "turning_point"), False).to_numpy()
            newest = np.empty(size, np.int64)
            newest[pc.sort_indices(held, sort_keys=[("created_ts", "descending"), ("id", "ascending")], null_placement="at_end").to_numpy()] = np.arange(size)
        out: list[tuple] = []
        waiting = 0

        def best(score: np.ndarray, most: int) -> np.ndarray:
            """Places of the `most` best; of equal ones the first."""
            if len(score) <= most:
                return np.arange(len(score))
            least = np.partition(score, -most)[-most]
            above = np.nonzero(score > least)[0]
            return np.concatenate([above, np.nonzero(score == least)[0][: most - len(above)]])

        def batch() -> pa.RecordBatch:
            at = np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64)
            ix, score, coverage, matched, found, passed = (np.concatenate([x[k] for x in out]) for k in range(1, 7))
            ids = pa.array(ix, pa.int64(), mask=ix < 0)
            some = ix >= 0
            arrays = [asks["qid"].take(pa.array(at)), asks["scope"].take(pa.array(at)), held["id"].take(ids), pa.array(score, mask=~some), pa.array(coverage, mask=~some), pa.array(matched, pa.int64()), pa.array(passed, pa.bool_(), mask=~some), pa.array(found, pa.int64(), mask=some), *(held[x].take(ids) for x in keep)]
            return pa.RecordBatch.from_arrays([_whole(x) for x in arrays], names=names)

        for k in range(len(asks)):
            if (found := scores.of(k)) is None:
                continue
            at, score, coverage, matched, passed = found
            passing = np.nonzero(passed)[0]
            if how == "all":
                chosen = np.arange(len(at))
            elif how == "passed":
                chosen = passing
            elif how == "best":
                chosen = passing[best(score[passing], limit)]
            elif how == "any":
                chosen = best(score, limit)
            elif how == "seats":  # the first of each order are among these, whatever the other buckets take
                (_, turns), (_, recent) = C.QUOTAS
                fresh = newest[at[passing]]
                late = passing if len(passing) <= turns + recent else passing[np.argpartition(fresh, turns + recent)[: turns + recent]]
                chosen = np.unique(np.concatenate([passing[turning[at[passing]]][:turns], late, passing[best(score[passing], limit + turns + recent)]]))
            else:
                chosen = passing[:0]
            if len(chosen):
                out.append((k, at[chosen], score[chosen], _rounded(coverage[chosen]), matched[chosen], np.zeros(len(chosen), np.int64), passed[chosen]))
                waiting += len(chosen)
            if counts:
                out.append((k, np.array([-1]), np.zeros(1), np.zeros(1), np.array([len(at)]), np.array([len(passing)]), np.array([False])))
                waiting += 1
            if waiting >= OUT_ROWS:
                yield batch()
                out, waiting = [], 0
        if out:
            yield batch()

    names = ["qid", "scope", "id", "score", "coverage", "matched", "passed", "found", *keep]
    types = {"qid": dict(queries.dtypes)["qid"], "scope": kinds[scope], "id": kinds["id"], "score": "double", "coverage": "double", "matched": "long", "passed": "boolean", "found": "long"} | {x: kinds[x] for x in keep}
    return _by_cell(dealt, cell, ", ".join(f"`{x}` {types[x]}" for x in names))


_PAIR = ("qid", "scope", "id", "score", "coverage", "matched", "passed")


def evaluate(queries: DataFrame, cards: DataFrame, gated: bool = False, **knobs) -> DataFrame:
    """Every (qid, id) that shares a term: score, coverage, matched, passed; with `gated` only those that pass.

    queries: qid, scope, text; cards: scope, id, text. A pair passes if it covers at least `min_coverage` of the query's weight or
    scores at least `strong_evidence` times the weight of an unseen term (times the root of terms over `strong_terms`, for longer
    queries). Scores and coverage are rounded to six places after the gate. Null and blank texts have no terms and so no pairs.
    """
    return _cells(queries, cards, "passed" if gated else "all", **knobs).select(*_PAIR)


def counted(queries: DataFrame, cards: DataFrame, **knobs) -> DataFrame:
    """(qid, scope, pairs, found) per query that has a pair: how many, and how many pass."""
    return _counts(_cells(queries, cards, "none+", **knobs))


def _counts(rows: DataFrame) -> DataFrame:
    return rows.filter("id is null").groupBy("qid", "scope").agg(F.sum("matched").alias("pairs"), F.sum("found").alias("found"))


def _order() -> tuple[Column, ...]:
    return F.desc("score"), F.desc_nulls_last("occurred_ts"), F.asc("id")


def _placed(rows: DataFrame) -> DataFrame:
    return rows.filter("id is not null").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*_order())).cast("long"))


def best(queries: DataFrame, cards: DataFrame, limit: int, gated: bool = True, **knobs) -> DataFrame:
    """What `ranked` makes of `evaluate`, the best `limit` per query; each cell gives out its own best only."""
    rows = _cells(queries, cards, "best" if gated else "any", limit, ("occurred_ts",), **knobs)
    return _placed(rows).filter(F.col("rank") <= limit).select(*_PAIR, "occurred_ts", "rank")


def best_and_counts(queries: DataFrame, cards: DataFrame, **knobs) -> DataFrame:
    """(qid, pairs, best) per query that has a pair, gate or not: how many there are and the id of the first."""
    rows = _cells(queries, cards, "any+", 1, ("occurred_ts",), **knobs)
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("id").isNull(), *_order()))
    rows = rows.withColumn("n_", order)
    return rows.groupBy("qid").agg(F.sum(F.when(F.col("id").isNull(), F.col("matched"))).alias("pairs"), F.max(F.when(F.col("n_") == 1, F.col("id"))).alias("best"))


def seatable(queries: DataFrame, cards: DataFrame, counts: bool = False, **knobs) -> tuple[DataFrame, DataFrame | None]:
    """Of the passing pairs those that can get one of the seats of selection.seats, ranked among each other (qid, id, score, rank, role,
    occurred_ts, created_ts); with `counts`, those of `counted` too, from the same pass, which is written."""
    rows = _cells(queries, cards, "seats+" if counts else "seats", C.CAP, ("occurred_ts", "created_ts", "role"), **knobs)
    rows = written(rows, "seatable") if counts else rows
    return _placed(rows).select("qid", "id", "score", "rank", "role", "occurred_ts", "created_ts"), _counts(rows) if counts else None


def ranked(pairs: DataFrame, cards: DataFrame, limit: int | None, gated: bool = True) -> DataFrame:
    """The best `limit` per query: by score, then the later occurred_ts (unknown last), then id."""
    rows = (pairs.filter("passed") if gated else pairs).join(cards.select(F.col("owner").alias("scope"), "id", "occurred_ts"), ["scope", "id"])
    order = Window.partitionBy("qid").orderBy(*_order())
    rows = rows.withColumn("rank", F.row_number().over(order))
    rows = rows if limit is None else rows.filter(F.col("rank") <= limit)
    return rows.withColumn("rank", F.col("rank").cast("long"))
