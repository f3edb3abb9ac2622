"""Queries of a scope meet its cards in cells: a block of queries and a block of cards in one task, so that pairs are never shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.session import written

#: Rows that a task gives out at a time.
OUT_ROWS = 50_000


def meet(held: DataFrame, asked: DataFrame, card_block: int, ask_block: int, cell: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """held: scope, id, ...; asked: scope, qid, ...; both written. `cell` gets the rows of both in a cell, those of queries without id."""
    many = asked.groupBy("scope").agg(F.countDistinct("qid").alias("q")).join(held.groupBy("scope").agg(F.count("*").alias("n")), "scope")
    many = many.select("scope", F.ceil(F.col("q") / ask_block).cast("int").alias("nq"), F.ceil(F.col("n") / card_block).cast("int").alias("nv"))
    many = F.broadcast(written(many.filter("nq > 1 or nv > 1"), "blocks"))  # only scopes of more than one block
    own = lambda key, n: F.pmod(F.xxhash64(key), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    c = held.filter("scope is not null").join(many, "scope", "left").withColumn("v_", own("id", F.col("nv"))).withColumn("q_", every(F.col("nq")))
    q = asked.filter("scope is not null").join(many, "scope", "left").withColumn("q_", own("qid", F.col("nq"))).withColumn("v_", every(F.col("nv")))
    dealt = c.drop("nq", "nv").unionByName(q.drop("nq", "nv"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            keys, begin = list(zip(*(b[x].to_pylist() for x in ("scope", "q_", "v_")))), 0
            for k, now in enumerate(keys):
                if now != last:
                    if k > begin:
                        parts.append(b.slice(begin, k - begin))
                    if parts:
                        yield from cell(pa.Table.from_batches(parts))
                    parts, begin, last = [], k, now
            if len(b):
                parts.append(b.slice(begin))
        if parts:
            yield from cell(pa.Table.from_batches(parts))

    return dealt.repartition("scope", "q_", "v_").sortWithinPartitions("scope", "q_", "v_").mapInArrow(run, schema)


def whole(x: pa.Array | pa.ChunkedArray) -> pa.Array:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


class Postings:
    """Which cards of a cell have each unit that its queries have; units are lists of strings, distinct in a row."""

    def __init__(self, held: pa.Array, asked: pa.Array):
        words = pa.concat_arrays([held.flatten(), asked.flatten()]).dictionary_encode()
        codes, lens = words.indices.to_numpy(), pc.list_value_length(held).to_numpy()
        self.words, self.asked = words.dictionary, codes[lens.sum() :]
        sought = np.zeros(len(words.dictionary), bool)
        sought[self.asked] = True
        of_cards = codes[: lens.sum()]
        hit = sought[of_cards]
        order = np.argsort(of_cards[hit], kind="stable")
        self.card = np.repeat(np.arange(len(held)), lens)[hit][order]
        self.unit = of_cards[hit][order]
        self.starts = np.searchsorted(self.unit, np.arange(len(words.dictionary) + 1))
        self.ends = np.cumsum(pc.list_value_length(asked).to_numpy())

    def of(self, k: int) -> np.ndarray:
        """Places in `card` and `unit` of what query k shares."""
        units = self.asked[self.ends[k - 1] if k else 0 : self.ends[k]]
        begin = self.starts[units]
        n = self.starts[units + 1] - begin
        return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
