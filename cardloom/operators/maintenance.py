"""What needs maintenance: shapes of gardens, changed cards, batches, and the checks before a commit."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import constants as C
from cardloom.operators.lifecycle import with_status
from cardloom.session import written

VERSION_FIELDS = ("summary", "content", "bucket", "threads", "occurred_at", "retrieval_cues", "importance", "pulse", "source", "supersedes")


def shapes(cards: DataFrame, scope: str = "owner", marker: str = C.DREAM_SOURCE) -> DataFrame:
    """(scope, card_count, seed_count, signature) of each garden.

    Seeds are all cards, retired ones too, that maintenance did not write. The signature is that of their lines, in the order of ids
    within 4,096 buckets of the ids' own hash: it does not depend on the order of rows, and no task holds the lines of a whole garden.
    """
    seed = F.coalesce(F.trim("source"), F.lit("")) != marker
    line = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ("id", "source", "created_at", "occurred_at")])
    rows = with_status(cards).select(F.col(scope).alias("scope"), "state", seed.alias("seed"), "id", F.sha2(line, 256).alias("digest"), F.substring(F.sha2("id", 256), 1, 3).alias("bucket"))
    joined = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct(key, "digest")))), lambda x: x["digest"]), "\n")
    parts = rows.withColumn("digest", F.when(F.col("seed"), F.col("digest"))).groupBy("scope", "bucket").agg(
        F.count_if(F.col("state") == "active").alias("cards"), F.count_if("seed").alias("seeds"), joined("id").alias("lines")
    )
    parts = parts.withColumn("digest", F.when(F.col("seeds") > 0, F.sha2("lines", 256)))
    return parts.groupBy("scope").agg(F.sum("cards").alias("card_count"), F.sum("seeds").alias("seed_count"), F.substring(F.sha2(joined("bucket"), 256), 1, 32).alias("signature"))


def verdicts(shapes_: DataFrame, ledger: DataFrame, min_new: int = C.MIN_NEW_CARDS) -> DataFrame:
    """Whether each garden is due: shapes and ledger (scope, last_signature, last_seed_count) to (scope, reason, new_cards, key)."""
    df = shapes_.join(ledger, "scope", "left")
    new = F.greatest(F.lit(0), F.col("seed_count") - F.greatest(F.lit(0), F.coalesce("last_seed_count", F.lit(0))))
    reason = (
        F.when(F.col("card_count") <= 0, "no_memory_cards")
        .when((F.coalesce("last_signature", F.lit("")) != "") & (F.col("last_signature") == F.col("signature")), "already_dreamed")
        .when(new < min_new, "not_enough_new_cards")
        .otherwise("due")
    )
    material = F.concat_ws("|", F.coalesce("last_signature", F.lit("")), "signature", F.col("seed_count").cast("string"))
    return df.select("scope", reason.alias("reason"), new.cast("long").alias("new_cards"), F.concat(F.lit("dream:"), F.substring(F.sha2(material, 256), 1, 32)).alias("key"))


def version(cards: DataFrame) -> Column:
    """Content version: changes with any of VERSION_FIELDS, and with nothing else."""
    del cards
    return F.sha2(F.to_json(F.struct(*VERSION_FIELDS), {"ignoreNullFields": "false"}), 256)


def pending(cards: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Cards whose version is not the reviewed one (id, version)."""
    v = cards.withColumn("version_now", version(cards))
    return v.join(reviewed.select("id", F.col("version").alias("version_seen")), "id", "left").filter(~F.col("version_now").eqNullSafe(F.col("version_seen"))).drop("version_seen")


def batches(cards: DataFrame, backlog: DataFrame, related: DataFrame, limit: int, scope: str = "owner") -> DataFrame:
    """At most `limit` cards per scope: the oldest half from the backlog, then cards on their threads, then related ones, then backlog.

    cards: scope, id, threads, created_at; backlog: ids of cards that changed; related: scope, id, rank. (scope, id, step, place).
    """
    todo = cards.join(backlog.select("id"), "id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy(scope).orderBy(F.coalesce("created_at", F.lit("")), "id"))).filter(F.col("n") <= limit)
    half = max(1, (limit + 1) // 2)
    first = todo.filter(F.col("n") <= half)
    threads = first.select(scope, F.explode("threads").alias("thread")).distinct()
    same = cards.select(scope, "id", F.explode("threads").alias("thread")).join(threads, [scope, "thread"], "left_semi").select(scope, "id").distinct()
    # More than `limit` of any kind are never needed, and a rank with a bound is cut in every task before anything is shuffled.
    same = same.withColumn("n", F.row_number().over(Window.partitionBy(scope).orderBy("id"))).filter(F.col("n") <= limit)
    step = lambda df, k, name: df.select(scope, "id", F.lit(k).alias("k"), F.lit(name).alias("step"), F.col("n").cast("long").alias("n"))
    parts = [step(first, 0, "backlog"), step(same, 1, "thread"), step(related.withColumn("n", F.col("rank")), 2, "related"), step(todo, 3, "backlog")]
    each = reduce(DataFrame.unionByName, parts).groupBy(scope, "id").agg(F.min(F.struct("k", "n", "step")).alias("x")).select(scope, "id", "x.*")
    place = F.row_number().over(Window.partitionBy(scope).orderBy("k", "n", "id"))
    return each.withColumn("place", place.cast("long")).filter(F.col("place") <= limit).select(scope, "id", "step", "place")


def fuse_blown(retiring: Column, active: Column, ratio: float = C.FUSE_RATIO, least: int = C.FUSE_CARDS) -> Column:
    """Whether a batch retires too much of a garden: at least `least` cards and more than `ratio` of the active ones; never without any."""
    return (active > 0) & (retiring >= least) & (retiring > active * ratio)


_GRAM = C.ID_LEAK_CHARS
_CLASS = np.array([2] * 48 + [0] * 10 + [2] * 7 + [1] * 26 + [2] * 6 + [1] * 26 + [2] * 5 + [2], np.int64)


def _shapes_of(text: str) -> np.ndarray:
    """For every position with _GRAM characters: a number of their classes (digit, ASCII letter, other), one of 3^_GRAM."""
    kinds = _CLASS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]
    n = len(kinds) - _GRAM + 1
    return sum((kinds[k : k + n] * 3**k for k in range(_GRAM)), np.zeros(max(n, 0), np.int64)) if n > 0 else np.zeros(0, np.int64)


def leaked_ids(texts: DataFrame, ids: DataFrame, keys: tuple[str, ...] = ("key",), scope: str = "owner") -> DataFrame:
    """texts: scope, keys (strings), text; ids: scope, id. (keys, id): the smallest known id of the same scope that stands anywhere in each text.

    Ids are substrings, trimmed, of at least ID_LEAK_CHARS characters. An id is looked up by its last ID_LEAK_CHARS characters wherever
    a text has characters of such classes (at most 6,561 kinds), with as much of the text before them as the longest id has.
    """
    known = ids.select(F.coalesce(scope, F.lit("")).alias("scope_"), F.regexp_replace("id", r"(?U)^\s+|\s+$", "").alias("id")).filter(F.length("id") >= _GRAM).distinct()
    known = written(known.withColumn("gram", F.expr(f"right(id, {_GRAM})")), "known-ids")
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace("gram", r"[^0-9A-Za-z]", "-"), "[A-Za-z]", "a"), "[0-9]", "0")
    number = {"0": 0, "a": 1, "-": 2}
    shapes = {sum(number[c] * 3**k for k, c in enumerate(r.kind)) for r in known.select(kind.alias("kind")).distinct().collect()}
    longest = known.agg(F.max(F.length("id")).alias("n")).first()["n"] or _GRAM
    wanted = np.zeros(3**_GRAM, bool)
    wanted[list(shapes)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams, heads = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                found = {text[max(0, at + _GRAM - longest) : at + _GRAM] for at in np.flatnonzero(wanted[_shapes_of(text)]).tolist()}
                rows += [k] * len(found)
                grams += [x[-_GRAM:] for x in found]
                heads += found
            left = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("scope_", *keys)]
            yield pa.RecordBatch.from_arrays([*left, pa.array(grams, pa.string()), pa.array(heads, pa.string())], names=["scope_", *keys, "gram", "head"])

    rows = texts.filter(F.length("text") >= _GRAM).select(F.coalesce(scope, F.lit("")).alias("scope_"), *keys, "text")
    places = rows.mapInArrow(run, ", ".join(f"`{c}` string" for c in ("scope_", *keys, "gram", "head")))
    return places.join(known, ["scope_", "gram"]).filter(F.endswith("head", "id")).groupBy(*keys).agg(F.min("id").alias("id"))


def seed_generations(feed: DataFrame, marker: str = C.DREAM_SOURCE) -> DataFrame:
    """feed: scope, mount, day, op, source. Running number of new seeds per mount: adds and supersedes not written by maintenance."""
    seeds = feed.filter(F.col("op").isin("add", "supersede") & (F.coalesce("source", F.lit("")) != marker)).groupBy("mount", "day").agg(F.count("*").alias("new_seeds"))
    running = F.sum("new_seeds").over(Window.partitionBy("mount").orderBy("day"))
    return seeds.withColumn("generation", running.cast("long"))
