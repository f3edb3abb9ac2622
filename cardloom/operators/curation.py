"""Curation of a garden: topics of queries in cards, replies checked against cards, rendering within a budget, ledgers and ids."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import constants as C
from cardloom.functions.text import collapse, strip
from cardloom.operators import cells
from cardloom.session import written

#: Characters of Chinese that make no topic by themselves, single ones that do, and words too general for one.
WEAK_TOPIC_CHARS = "我你他她它的是了在和就都不吗呢啊吧这那什么怎么一个有没给要说想看喜欢记得知道"
CONCRETE = ("猫", "狗")
GENERIC_TOPICS = tuple("ai api app bot bug chat code data debug file fix image ios issue json key memory message model page photo prompt project reply screen server system task test token tool user work".split())
_NONE = "cast(array() as array<string>)"


def _grams(chunk: Column, least: int, most: int) -> Column:
    n = F.length(chunk)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substr(chunk, i, F.lit(k)))).otherwise(F.expr(_NONE))
    return reduce(lambda a, b: F.concat(a, b), [of(k) for k in range(least, most + 1)])


def topic_terms(text: Column) -> Column:
    """Terms that a query is about: words of three ASCII letters or more that are not general, Chinese runs of two to six characters that
    are not all weak, and a few single ones."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-z0-9_]{3,})"), 1), lambda w: ~w.isin(*GENERIC_TOPICS))
    han = F.flatten(F.transform(F.regexp_extract_all(low, F.lit("([一-鿿]{2,})"), 1), lambda c: _grams(c, 2, 6)))
    han = F.filter(han, lambda g: ~g.rlike(f"^[{WEAK_TOPIC_CHARS}]+$"))
    single = F.filter(F.regexp_extract_all(low, F.lit("([一-鿿])"), 1), lambda c: c.isin(*CONCRETE))
    return F.array_distinct(F.concat(words, han, single))


_TOPIC_RUN = re.compile("[a-z0-9_]{3,}|[一-鿿]+")
#: Cards and queries of a cell, at most about.
CARD_BLOCK, ASK_BLOCK = 10_000, 2_000


def _head(term: str) -> str:
    """The first characters of a term: two of a Chinese run, three of a word."""
    return term[:2] if "一" <= term[0] <= "鿿" else term[:3]


def _heads(run: str) -> set[str]:
    """The heads of all terms that can stand in a run."""
    han = "一" <= run[0] <= "鿿"
    size = 2 if han else 3
    return {run[k : k + size] for k in range(len(run) - size + 1)} | ({c for c in CONCRETE if c in run} if han else set())


def topic_matches(queries: DataFrame, cards: DataFrame, scope: str = "owner") -> DataFrame:
    """(qid, id) of a scope where a topic term of the query stands anywhere in the card, as a substring.

    queries: qid, scope, text; cards: scope, id, text. Both are unique in their scope, or count once. A term has characters of one kind, so
    it stands in a card if it stands in one of its runs of that kind: terms are looked for in the distinct runs of a cell's cards (those with
    the term's first characters), and only what matches leaves the cell (operators/cells.py): pairs are not shuffled.
    """
    kinds = dict(cards.dtypes)
    held = written(cards.filter("id is not null").select(F.col(scope).alias("scope"), "id", F.lower(F.coalesce("text", F.lit(""))).alias("low")), "texts")
    asked = written(queries.select(F.col(scope).alias("scope"), "qid", topic_terms(F.col("text")).alias("terms")), "asked")

    def cell(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        is_query = pc.is_null(rows["id"])
        texts, asks = rows.filter(pc.invert(is_query)), rows.filter(is_query)
        if not len(texts) or not len(asks):
            return
        ids, qids = (cells.whole(x).dictionary_encode() for x in (texts["id"], asks["qid"]))
        sought: dict[int | None, set[str]] = defaultdict(set)
        for q, found in zip(qids.indices.to_pylist(), asks["terms"].to_pylist()):
            sought[q].update(found or ())
        heads = {_head(t) for found in sought.values() for t in found}
        places: dict[str, list[int]] = defaultdict(list)
        for card, low in zip(ids.indices.to_pylist(), texts["low"].to_pylist()):
            for run in set(_TOPIC_RUN.findall(low)):
                places[run].append(card)
        runs: dict[str, list[str]] = defaultdict(list)
        for run in places:
            for h in _heads(run) & heads:
                runs[h].append(run)
        of: dict[str, np.ndarray] = {}
        out: list[tuple[int, np.ndarray]] = []
        waiting = 0

        def batch() -> pa.RecordBatch:
            at, ix = np.repeat([q for q, _ in out], [len(x) for _, x in out]).astype(np.int64), np.concatenate([x for _, x in out])
            arrays = [qids.dictionary.take(pa.array(at, mask=at < 0)), ids.dictionary.take(pa.array(ix))]
            return pa.RecordBatch.from_arrays([cells.whole(x) for x in arrays], names=["qid", "id"])

        for q, found in sought.items():
            hit = np.zeros(len(ids.dictionary), bool)
            for t in found:
                if (its := of.get(t)) is None:
                    its = of[t] = np.fromiter({c for run in runs.get(_head(t), ()) if t in run for c in places[run]}, np.int32)
                hit[its] = True
            if len(ix := np.flatnonzero(hit)):
                out.append((-1 if q is None else q, ix))
                waiting += len(ix)
            if waiting >= cells.OUT_ROWS:
                yield batch()
                out, waiting = [], 0
        if out:
            yield batch()

    return cells.meet(held, asked, CARD_BLOCK, ASK_BLOCK, cell, f"`qid` {dict(queries.dtypes)['qid']}, `id` {kinds['id']}")


def checked_targets(proposed: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """proposed: keys, action, target; known: id (all ids, not just those shown). Adds `verdict`: ok, target_missing or target_unknown."""
    ids = known.select(F.col("id").alias("target_")).distinct().withColumn("known_", F.lit(True))
    df = proposed.withColumn("target_", F.when(strip("target") != "", strip("target"))).join(ids, "target_", "left")
    acts = F.lower(strip(F.coalesce("action", F.lit("")))).isin("merge", "supersede")
    verdict = F.when(acts & F.col("target_").isNull(), "target_missing").when(acts & F.col("known_").isNull(), "target_unknown").otherwise("ok")
    return df.withColumn("verdict", verdict).select(*keys, "verdict")


def migrated(rows: DataFrame, allowed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, unmigrated): of `rows` (key, id, place) the first with each allowed id, and the allowed (key, id) that none came back for."""
    own = rows.select(key, strip("id").alias("id"), "place").filter("id <> ''").join(allowed.select(key, "id").distinct(), [key, "id"], "left_semi")
    accepted = own.groupBy(key, "id").agg(F.min("place").alias("place"))
    return accepted, allowed.select(key, "id").distinct().join(accepted, [key, "id"], "left_anti")


def dream_blocks(cards: DataFrame, summary_chars: int = 2000, body_chars: int = 5000) -> DataFrame:
    """Adds `block`, the card as it is shown to a consolidating model, and `truncated`, whether its summary or body was cut."""
    line = lambda c: collapse(F.coalesce(F.col(c), F.lit("")))
    each = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.expr(_NONE)), lambda v: collapse(F.coalesce(v, F.lit("")))), lambda v: v != "")
    body = strip(F.coalesce("content", F.lit("")))
    long_line, long_body = F.length(line("summary")) > summary_chars, F.length(body) > body_chars
    cut, mark = long_line | long_body, "TRUNCATED"
    part = lambda when, *text: F.when(when, F.concat(*text))
    head = F.concat_ws(
        " | ", F.concat(F.lit("- id="), line("id")), part(line("bucket") != "", F.lit("bucket="), line("bucket")), part(F.size(each("threads")) > 0, F.lit("threads="), F.array_join(each("threads"), ", ")),
        part(line("occurred_at") != "", F.lit("occurred_at="), line("occurred_at")), F.when(cut, mark),
    )
    shown = F.substring(body, 1, body_chars)
    lines = F.transform(F.split(shown, "\r\n|\r|\n"), lambda x: F.when(strip(x) == "", "").otherwise(F.concat(F.lit("    "), F.regexp_replace(x, r"(?U)\s+$", ""))))
    title = F.when(long_body, F.concat(F.lit(f"  content ({mark}: showing the first {body_chars} of "), F.length(body).cast("string"), F.lit(" characters):"))).otherwise("  content:")
    block = F.concat_ws(
        "\n", head, part(line("summary") != "", F.lit("  summary: "), F.substring(line("summary"), 1, summary_chars), F.when(long_line, f" [{mark}]").otherwise("")),
        part(F.size(each("retrieval_cues")) > 0, F.lit("  retrieval_cues: "), F.array_join(each("retrieval_cues"), "; ")), part(body != "", title, F.lit("\n"), F.array_join(lines, "\n")), F.when(long_body, f"    [{mark}]"),
    )
    kept = cards.filter((line("id") != "") & ((line("summary") != "") | (body != "")))
    return kept.withColumns({"block": block, "truncated": cut})


def rendered(cards: DataFrame, scope: str, order: list[Column], most: int = 60, budget: int = 60_000, summary_chars: int = 2000, body_chars: int = 5000) -> DataFrame:
    """The longest prefix of each scope's blocks, of at most `most` cards and `budget` characters with line breaks: scope, id, place, used, truncated."""
    place = F.row_number().over(Window.partitionBy(scope).orderBy(*order))
    first = dream_blocks(cards, summary_chars, body_chars).withColumn("place", place.cast("long")).filter(F.col("place") <= most)
    cost = F.length("block") + F.when(F.col("place") > 1, 1).otherwise(0)
    used = F.sum(cost).over(Window.partitionBy(scope).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.withColumn("used", used).filter(F.col("used") <= budget).select(scope, "id", "place", "used", "truncated")


def safe_proposals(proposals: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    """proposals: keys, ids (array); shown: id, truncated, with the first of keys as scope. Adds `verdict`: a proposal that touches a cut
    card or one that was not shown is unsafe as a whole."""
    each = proposals.select(*keys, F.explode(F.array_distinct("ids")).alias("id"))
    met = each.join(shown.select(keys[0], "id", "truncated"), [keys[0], "id"], "left")
    verdict = F.when(F.bool_or(F.coalesce("truncated", F.lit(False))), "truncated_target").when(F.bool_or(F.col("truncated").isNull()), "unrendered_target").otherwise("kept")
    return met.groupBy(*keys).agg(verdict.alias("verdict"))


def consolidation_mutations(rows: DataFrame, mount: str = "agent-private") -> DataFrame:
    """rows: key, card_ids, op, rationale, result (a struct of a card). Each as one supersede of all its cards, its source that of maintenance."""
    ids = F.filter(F.transform("card_ids", lambda i: strip(i)), lambda i: i != "")
    kept = rows.withColumn("ids_", ids).filter((F.size("ids_") > 0) & F.col("result").isNotNull())
    return kept.select("key", F.lit("supersede").alias("op"), F.col("ids_").alias("target_ids"), F.col("result").withField("source", F.lit(C.DREAM_SOURCE)).alias("card"), F.lit(mount).alias("mount"), "rationale", F.lower(strip(F.coalesce("op", F.lit("")))).alias("consolidation_op"))


def recent(cards: DataFrame, scope: str, days: int, reference: Column | None = None) -> DataFrame:
    """Cards written at most `days` before the reference and not after it; by default the newest card of the scope. cards: scope, created_ts."""
    newest = cards.groupBy(scope).agg(F.max("created_ts").alias("ref_"))
    df = cards.join(newest, scope) if reference is None else cards.withColumn("ref_", reference)
    return df.filter((F.col("created_ts") <= F.col("ref_")) & (F.col("ref_").cast("double") - F.col("created_ts").cast("double") <= days * 86400)).drop("ref_")


def next_ids(ids: DataFrame, scope: str, floor: DataFrame | None = None) -> DataFrame:
    """(scope, next_id): one more than the highest number of an id m_<n>, and never less than `floor` (scope, next_id). Counts of rows play no part."""
    number = F.regexp_extract("id", r"^m_(\d{1,18})$", 1)
    high = ids.groupBy(scope).agg((F.coalesce(F.max(number.try_cast("long")), F.lit(0)) + 1).alias("next_id"))
    if floor is None:
        return high
    both = high.unionByName(floor.select(scope, F.col("next_id").cast("long").alias("next_id")))
    return both.groupBy(scope).agg(F.max("next_id").alias("next_id"))


def reviewed_after(ledger: DataFrame, written: DataFrame, cards: DataFrame) -> DataFrame:
    """The ledger (id, version) after a commit: outputs of maintenance (`written`: id, version, source) count as reviewed, so that they
    start no maintenance themselves; ids that are gone, archived or superseded leave it. cards: id, archived, superseded_by."""
    own = written.filter(F.col("source") == C.DREAM_SOURCE).select("id", "version")
    merged = ledger.join(own.select("id"), "id", "left_anti").select("id", "version").unionByName(own)
    live = cards.filter(~F.coalesce("archived", F.lit(False)) & (strip(F.coalesce("superseded_by", F.lit(""))) == "")).select("id")
    return merged.join(live, "id", "left_semi")


def targets(record: Column, others: Column) -> Column:
    """Distinct targets of a mutation, blanks aside: the older single field first."""
    every = F.concat(F.array(record), F.coalesce(others, F.expr(_NONE)))
    return F.array_distinct(F.filter(F.transform(every, lambda t: strip(t)), lambda t: t.isNotNull() & (t != "")))


def same_request(previous: Column, current: Column, previous_mutations: Column, current_mutations: Column) -> Column:
    """Whether a repeated key brings the same request: by the requests' digests if either has one, else by those of the mutations."""
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    requests = some(previous) & some(current) & (previous == current)
    return F.when(some(previous) | some(current), requests).otherwise(~some(previous_mutations) | (previous_mutations == current_mutations))


BANNED_IN_LOGS = ("summary", "content", "bucket_name", "threads", "query", "title")


def assert_content_free(df: DataFrame) -> DataFrame:
    """Refuse a table of observations that has a column, or a field of one, for content."""

    def walk(kind, path: str) -> None:
        for f in getattr(kind, "fields", []):
            if f.name in BANNED_IN_LOGS:
                raise AssertionError(f"a column for content: {path}{f.name}")
            walk(f.dataType, f"{path}{f.name}.")
        if hasattr(kind, "elementType"):
            walk(kind.elementType, path)

    walk(df.schema, "")
    return df
