"""Rule-based relevance: what kind of words a query and a card share, on a ladder of confidence.

Both sides are cut into units (phrases, rare words, weak words) that meet in an equi-join within a scope; counts of shared units per
kind decide the rung. Nothing is compared that shares no unit. What passes is found in cells (operators/cells.py): pairs are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions import constants as C
from cardloom.functions.text import bigram_jaccard
from cardloom.operators import cells
from cardloom.session import written

#: Words that are never evidence, words that are weak evidence, and characters that join phrases.
STOP = frozenset("the and you your for with that this what when where why how can could would should about again then than into from have has had will just really very also there here".split())
GENERIC = frozenset("ai api app bot bug card chat code data debug file fix image ios issue json key memory message model page photo prompt project reply screen server system task test token tool user work day today tomorrow tonight week month thing stuff help done finish finished tired".split())
STOP_CHARS = "我你他她它的是了在和就都不吗呢啊吧这那什么怎么一个有没给要说"
GENERIC_PHRASES = frozenset("今天 明天 昨天 现在 刚刚 这个 那个 一下 东西 事情 项目 任务 工作 问题 代码 系统 消息 聊天 记忆 模型 图片 截图 文件 页面 完成 测试 修复 好累 很累".split())
MIN_RELEVANCE = 0.35


_WORDS, _HAN_RUN, _HAN_CHAR = re.compile(r"[a-z0-9_]{2,}"), re.compile("[一-鿿]{2,}"), re.compile("[一-鿿]")
_RUN, _PART = re.compile(r"[a-z0-9_]+(?:[ \t\n\x0b\f\r_\-]+[a-z0-9_]+)+"), re.compile(r"[a-z0-9_]+")


def units_of(text: str | None, singles: bool = True) -> set[tuple[str, str]]:
    """(kind, unit) of a text: rare and weak words, and phrases of 2 to 5 words or 2 to 4 Chinese characters without joining ones."""
    low = (text or "").lower()
    out = set()
    for w in _WORDS.findall(low):
        if w in GENERIC:
            out.add(("weak", w))
        elif w not in STOP and len(w) >= 3:
            out.add(("rare", w))
    for run in _HAN_RUN.findall(low):
        for part in re.split(f"[{STOP_CHARS}]", run):
            out.update(("phrase", g) for n in (2, 3, 4) for k in range(len(part) - n + 1) if (g := part[k : k + n]) not in GENERIC_PHRASES)
    for run in _RUN.findall(low):
        words = _PART.findall(run)
        for n in range(2, 6):
            for k in range(len(words) - n + 1):
                part = words[k : k + n]
                if part[0] not in STOP and part[-1] not in STOP and not all(len(w) == 1 or w in STOP or w in GENERIC for w in part):
                    out.add(("phrase", " ".join(part)))
    if singles:
        out.update(("weak", c) for c in _HAN_CHAR.findall(low) if c not in STOP_CHARS)
    out.update(("weak", p) for p in GENERIC_PHRASES if p in low)
    return out


def units(rows: DataFrame, text: str, *keys: str, singles: bool = True) -> DataFrame:
    """(keys, kind, unit), distinct: the units of each row's text, cut in Arrow batches."""
    names = [*keys, "kind", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [units_of(t, singles) for t in batch.column(len(keys)).to_pylist()]
            at = pa.array([k for k, x in enumerate(found) for _ in x], pa.int64())
            flat = [u for x in found for u in x]
            arrays = [*(batch.column(k).take(at) for k in range(len(keys))), pa.array([k for k, _ in flat], pa.string()), pa.array([u for _, u in flat], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kinds = dict(rows.dtypes)
    return rows.select(*keys, text).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "kind string", "unit string"]))


_RUNGS = (("strong", "entity_phrase_match"), ("strong", "phrase_match"), ("medium", "multiple_rare_terms"), ("medium", "rare_term_with_support"), ("medium", "multiple_weak_terms"))
#: Cards and queries of a cell, at most about.
CARD_BLOCK, ASK_BLOCK = 10_000, 4_000


def _signed(texts: pa.ChunkedArray) -> pa.Array:
    """Each text's units as strings with a sign of their kind before them (e for an entity); single characters are of kind h."""
    found = []
    for t in texts.to_pylist():
        each = {kind[0] + u if kind != "phrase" else ("e" if len(u.replace(" ", "")) >= 4 else "p") + u for kind, u in units_of(t, False)}
        found.append([*each, *{"h" + c for c in _HAN_CHAR.findall((t or "").lower()) if c not in STOP_CHARS}])
    return pa.array(found, pa.list_(pa.string()))


def _bigrams(text: str | None) -> set[str]:
    low = (text or "").lower()
    return {low[k : k + 2] for k in range(len(low) - 1)}


def passed(queries: DataFrame, cards: DataFrame, scope: str = "owner", keep: tuple[str, ...] = ()) -> DataFrame:
    """(qid, id, score, confidence, reason) of the pairs that pass; with `keep` (occurred_ts, created_ts, role), which come along, those only
    that can get one of the seats of selection.soft_seats."""
    kinds = dict(cards.dtypes)
    held = written(cards.filter("id is not null").select(F.col(scope).alias("scope"), "id", "text", *keep), "texts")
    asked = written(queries.select(F.col(scope).alias("scope"), "qid", "text"), "texts")
    names = ["qid", "id", "score", "rung", *keep]

    def cell(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        is_query = pc.is_null(rows["id"])
        cards_, asks = rows.filter(pc.invert(is_query)), rows.filter(is_query).combine_chunks()
        if not len(cards_) or not len(asks):
            return
        size = len(cards_)
        if keep:  # the larger id first: a card's place settles ties
            cards_ = cards_.take(pc.sort_indices(cards_, sort_keys=[("occurred_ts", "descending"), ("id", "descending")], null_placement="at_end"))
            turning = pc.fill_null(pc.equal(cards_["role"], "turning_point"), False).to_numpy()
            newest = np.empty(size, np.int64)
            newest[pc.sort_indices(cards_, sort_keys=[("created_ts", "descending"), ("id", "descending")], null_placement="at_end").to_numpy()] = np.arange(size)
        posts = cells.Postings(_signed(cards_["text"]), _signed(asks["text"]))  # cut here: units are larger than texts
        kind = np.array(["eprwh".index(w[0]) for w in posts.words.to_pylist()], np.int64)[posts.unit]
        ct, qt, grams = cards_["text"], asks["text"], {}
        out: list[tuple] = []
        waiting = 0

        def batch() -> pa.RecordBatch:
            at, ix = pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64)), pa.array(np.concatenate([x[1] for x in out]))
            score, rung = (np.concatenate([x[k] for x in out]) for k in (2, 3))
            arrays = [asks["qid"].take(at), cards_["id"].take(ix), pa.array(score), pa.array(rung, pa.int32()), *(cards_[x].take(ix) for x in keep)]
            return pa.RecordBatch.from_arrays([cells.whole(x) for x in arrays], names=names)

        for k in range(len(asks)):
            post = posts.of(k)
            if not len(post):
                continue
            n = np.bincount(posts.card[post] * 5 + kind[post], minlength=size * 5).reshape(size, 5)
            at = np.nonzero(n[:, :4].any(axis=1))[0]
            e, p, r, w, h = n[at].T
            p = p + e
            none = (p == 0) & (r == 0)
            b = np.zeros(len(at))
            if len(near := np.nonzero(none & (w >= 2))[0]):
                mine = _bigrams(qt[k].as_py())
                for j in near:
                    if (its := grams.get(at[j])) is None:
                        its = grams[at[j]] = _bigrams(ct[int(at[j])].as_py())
                    b[j] = len(mine & its) / len(mine | its) if mine or its else 0
            when = [e > 0, p > 0, r >= 2, (r == 1) & (w + h > 0), none & ((w >= 3) | ((w >= 2) & (b >= 0.12)))]
            value = [0.86 + np.minimum(0.08, 0.02 * e), 0.68 + np.minimum(0.12, 0.03 * p), 0.52 + np.minimum(0.12, 0.03 * r), np.full(len(at), 0.36), np.minimum(0.42, 0.24 + 0.04 * w + np.minimum(0.06, b))]
            score, rung = np.floor(np.select(when, value, 0) * 1e4 + 0.5) / 1e4, np.select(when, range(5), -1)
            ok = np.nonzero((rung >= 0) & (score >= MIN_RELEVANCE))[0]
            if keep and len(ok):
                (_, turns), (_, recent) = C.QUOTAS
                ranks = np.lexsort((ok, -score[ok]))[: C.CAP + turns + recent]
                ok = np.unique(np.concatenate([ok[turning[at[ok]]][:turns], ok[np.argsort(newest[at[ok]])[: turns + recent]], ok[ranks]]))
            if len(ok):
                out.append((k, at[ok], score[ok], rung[ok]))
                waiting += len(ok)
            if waiting >= cells.OUT_ROWS:
                yield batch()
                out, waiting = [], 0
        if out:
            yield batch()

    schema = f"`qid` {dict(queries.dtypes)['qid']}, `id` {kinds['id']}, score double, rung int" + "".join(f", `{x}` {kinds[x]}" for x in keep)
    found = cells.meet(held, asked, CARD_BLOCK, ASK_BLOCK, cell, schema)
    said = [F.element_at(F.array(*(F.lit(x[k]) for x in _RUNGS)), F.col("rung") + 1) for k in (0, 1)]
    return found.select("qid", "id", "score", said[0].alias("confidence"), said[1].alias("reason"), *keep)


def relevance(queries: DataFrame, cards: DataFrame, scope: str = "owner", passing: bool = True) -> DataFrame:
    """(qid, id, score, confidence, reason) for pairs of one scope that share a unit; with `passing` those of at least MIN_RELEVANCE
    that are not weak. Phrases are matched whole: one of four or more characters is an entity. Null and blank texts share nothing.
    """
    if passing:
        return passed(queries, cards, scope)
    q, c = units(queries, "text", "qid", scope), units(cards.filter("id is not null"), "text", "id", scope)
    shared = q.join(c, [scope, "kind", "unit"]).groupBy(scope, "qid", "id")
    long = F.length(F.regexp_replace("unit", " ", "")) >= 4
    n = shared.agg(
        F.count_if((F.col("kind") == "phrase") & long).alias("entities"),
        F.count_if(F.col("kind") == "phrase").alias("phrases"),
        F.count_if(F.col("kind") == "rare").alias("rare"),
        F.count_if(F.col("kind") == "weak").alias("weak"),
        F.count_if((F.col("kind") == "weak") & (F.col("unit").rlike("[a-z0-9_]") | (F.length("unit") >= 2))).alias("support"),
    )
    texts = n.join(queries.select("qid", F.col("text").alias("qt")), "qid").join(cards.select(scope, "id", F.col("text").alias("ct")), [scope, "id"])
    needs = (F.col("entities") == 0) & (F.col("phrases") == 0) & (F.col("rare") == 0)
    texts = texts.withColumn("bigram", F.when(needs, bigram_jaccard(F.col("qt"), F.col("ct"))).otherwise(F.lit(0.0)))
    col = F.col
    rungs = (
        (col("entities") > 0, 0.86 + F.least(F.lit(0.08), 0.02 * col("entities")), "strong", "entity_phrase_match"),
        (col("phrases") > 0, 0.68 + F.least(F.lit(0.12), 0.03 * col("phrases")), "strong", "phrase_match"),
        (col("rare") >= 2, 0.52 + F.least(F.lit(0.12), 0.03 * col("rare")), "medium", "multiple_rare_terms"),
        ((col("rare") == 1) & (col("weak") > 0), F.lit(0.36), "medium", "rare_term_with_support"),
        (col("rare") == 1, F.lit(0.28), "weak", "single_rare_term"),
        ((col("support") >= 3) | ((col("support") >= 2) & (col("bigram") >= 0.12)), F.least(F.lit(0.42), 0.24 + 0.04 * col("support") + F.least(F.lit(0.06), col("bigram"))), "medium", "multiple_weak_terms"),
        (col("weak") > 0, F.least(F.lit(0.18), 0.06 * col("weak") + F.least(F.lit(0.04), col("bigram"))), "weak", "weak_generic_overlap"),
    )
    score, confidence, reason = F.lit(0.0), F.lit("none"), F.lit("no_overlap")
    for when, value, name, why in reversed(rungs):
        score, confidence, reason = F.when(when, value).otherwise(score), F.when(when, name).otherwise(confidence), F.when(when, why).otherwise(reason)
    return texts.select("qid", "id", F.round(score, 4).alias("score"), confidence.alias("confidence"), reason.alias("reason"))
