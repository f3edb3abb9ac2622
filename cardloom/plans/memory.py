"""Queries of the retrieval and curation operators over the card, conversation and mutation tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions import constants as C
from cardloom.functions import text as X
from cardloom.functions import timeparse, tokenizer
from cardloom.operators import budgets, evidence, fusion, hybrid, importing, lexical, lifecycle, maintenance, metrics, related, selection
from cardloom.session import written
from cardloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- what the operators are bound to ------------------------------------------------------------------------------------------------


def cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards, rows delivered twice once, with the text that queries match and the times they are ordered by."""
    c = table(spark, sf, "cards").dropDuplicates(["id"])
    text = X.match_text(None, [F.col("summary"), F.col("content"), F.col("bucket")], [F.col("threads"), X.cues(F.col("retrieval_cues"))])
    return c.withColumns({"text": text, "occurred_ts": timeparse.iso_instant(F.col("occurred_at")), "created_ts": F.col("updated_at")})


_CARDS = r"""c0 AS (SELECT DISTINCT ON (id) *, list_filter(list_transform(coalesce(retrieval_cues, []), lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))), lambda v: length(v) BETWEEN 1 AND 120) AS cue FROM cards),
c1 AS (SELECT *, regexp_replace(trim(occurred_at), '^(\d{4})(\d{2})(\d{2})[T ](\d{2})(\d{2})(\d{2})', '\1-\2-\3T\4:\5:\6') AS iso FROM c0),
c2 AS (SELECT *, CASE WHEN regexp_full_match(iso, '\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?') THEN regexp_extract(iso,
  '^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2}(?:[.,]\d+)?))?(Z|[+-]\d{2}:?\d{2})?)?$', ['d', 'hm', 's', 'z']) END AS i FROM c1),
c AS (SELECT * EXCLUDE (iso, i, cue), list_slice(list_filter(cue, lambda v, i: list_position(cue, v) = i), 1, 5) AS cues, try_cast(i.d || ' ' || coalesce(nullif(i.hm, ''), '00:00') || ':' || coalesce(nullif(replace(i.s, ',', '.'), ''), '00') AS TIMESTAMP)
  - (CASE WHEN i.z IN ('', 'Z') THEN 0 WHEN i.z[1] = '-' THEN -1 ELSE 1 END) * coalesce(try_cast(substr(i.z, 2, 2) AS BIGINT) * 60 + try_cast(right(i.z, 2) AS BIGINT), 0) * INTERVAL 1 MINUTE AS occurred_ts FROM c2),
k AS (SELECT *, CASE WHEN lower(trim(coalesce(status, ''))) = 'deleted' THEN 'deleted'
    WHEN lower(trim(coalesce(status, ''))) = 'superseded' OR trim(coalesce(superseded_by, '')) <> '' THEN 'superseded'
    WHEN lower(trim(coalesce(status, ''))) = 'archived' OR coalesce(archived, false) THEN 'archived'
    WHEN lower(trim(coalesce(status, ''))) IN ('', 'active') THEN 'active' ELSE 'unknown' END AS state,
  updated_at AS created_ts,
  array_to_string(list_distinct_keep(list_filter(list_concat([coalesce(summary, ''), coalesce(content, ''), coalesce(bucket, '')],
    coalesce(threads, []), cues), lambda x: x <> '')), chr(10)) AS text FROM c)"""
# DuckDB's list_distinct keeps no order; the first occurrence of each is kept by position instead.
_KEEP = "list_distinct_keep("


def _keep_order(sql: str) -> str:
    while (at := sql.find(_KEEP)) >= 0:
        depth, end = 1, at + len(_KEEP)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + len(_KEEP) : end - 1]
        sql = sql[:at] + f"list_filter({inner}, lambda v, i: list_position({inner}, v) = i)" + sql[end:]
    return sql


_CARDS = _keep_order(_CARDS)


#: Terms of a text in SQL: accented words set apart by blanks, so that signs join ASCII words only; full-width ones; Chinese characters; their pairs.
def _terms_sql(x: str) -> str:
    han = f"regexp_extract_all({x}, '[㐀-䶿一-鿿]{{2,}}')"
    pairs = f"flatten(list_transform({han}, lambda r: list_filter(list_transform(range(1, length(r)), lambda i: substr(r, i, 2)), lambda p: NOT regexp_matches(p, '[{tokenizer.PARTICLES}]'))))"
    words = f"regexp_extract_all(regexp_replace(replace(lower({x}), 'ß', 'ss'), '([a-z0-9]*[à-öø-ɏḀ-ỿ][a-z0-9à-öø-ɏḀ-ỿ]*)', ' \\1 ', 'g'), '[a-z0-9à-öø-ɏḀ-ỿ]+(?:[-_./][a-z0-9]+)*|[０-９ａ-ｚ]+')"
    return f"list_concat({words}, regexp_extract_all({x}, '[㐀-䶿一-鿿]'), {pairs})"


def turns(spark: SparkSession, sf: str) -> DataFrame:
    windows = table(spark, sf, "conversations", "cid", "window").dropDuplicates(["cid"])
    return budgets.turns_of(windows.select(F.col("cid").alias("conv"), F.col("window").alias("text")))


_TURNS = r"""w AS (SELECT DISTINCT ON (cid) cid, owner, str_split(coalesce("window", ''), chr(10)) AS l FROM conversations),
l0 AS (SELECT cid, owner, CAST(generate_subscripts(l, 1) AS BIGINT) AS turn, unnest(l) AS line FROM w),
turns AS (SELECT cid, owner, turn, regexp_extract(line, '^\s*(?:\[?\d{1,2}:\d{2}\]?\s*)?([^:：]{1,24})[:：]\s*', 1) AS speaker,
  regexp_replace(line, '^\s*(?:\[?\d{1,2}:\d{2}\]?\s*)?([^:：]{1,24})[:：]\s*', '') AS text FROM l0)"""


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """One query per conversation: its last four turns, asked of its owner's cards."""
    owners = table(spark, sf, "conversations", "cid", "owner").dropDuplicates(["cid"])
    last = budgets.last_turns(turns(spark, sf))
    return last.join(owners.withColumnRenamed("cid", "conv"), "conv").select(F.col("conv").alias("qid"), "owner", "text")


_ASKED = (
    _TURNS
    + r""",
last4 AS (SELECT cid, owner, turn, text, row_number() OVER (PARTITION BY cid ORDER BY turn DESC) AS n FROM turns WHERE trim(text) <> ''),
q AS (SELECT cid AS qid, any_value(owner) AS owner, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_turns FROM last4 WHERE n <= 4 GROUP BY cid)"""
)


def active(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.with_status(cards(spark, sf)).filter("state = 'active'")


_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in C.STOPWORDS) + "]"


def _bm25(pool: str = "k.state = 'active'", terms: int | None = None, floor: int = C.POOL_FLOOR) -> str:
    scale = "1.0::DOUBLE" if terms is None else f"sqrt(greatest(1.0::DOUBLE, nt / {float(terms)}::DOUBLE))"
    return (
        _CARDS
        + ",\n"
        + _ASKED
        + r""",
pool AS (SELECT * FROM k WHERE """
        + pool
        + r"""),
tok AS (SELECT owner, id, unnest("""
        + _terms_sql("text")
        + r""") AS term FROM pool),
tf AS (SELECT owner, id, term, count(*)::DOUBLE AS tf FROM tok GROUP BY ALL),
dl AS (SELECT owner, id, sum(tf) AS len FROM tf GROUP BY ALL),
st AS (SELECT owner, count(*)::DOUBLE AS n, (SELECT sum(len) FROM dl WHERE dl.owner = pool.owner) AS total FROM pool GROUP BY owner),
df AS (SELECT owner, term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
qt0 AS (SELECT qid, owner, unnest(list_distinct("""
        + _terms_sql("text")
        + r""")) AS term FROM q),
qt AS (SELECT * FROM qt0 WHERE NOT list_contains("""
        + _STOP
        + r""", term)),
wt AS (SELECT qt.qid, qt.owner, qt.term, n, total, coalesce(df, 0) AS df,
  ln(1 + (n - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) AS idf,
  ln(1 + (greatest(n, """
        + str(floor)
        + r""") - coalesce(df, 0) + 0.5::DOUBLE) / (coalesce(df, 0) + 0.5::DOUBLE)) AS cidf
  FROM qt JOIN st USING (owner) LEFT JOIN df ON df.owner = qt.owner AND df.term = qt.term),
mass AS (SELECT qid, owner, n, sum(cidf) AS mass, count(*)::DOUBLE AS nt FROM wt GROUP BY ALL),
sc AS (SELECT wt.qid, wt.owner, tf.id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (total / n)))) AS score, sum(cidf) AS covered, count(*) AS matched
  FROM wt JOIN tf ON tf.owner = wt.owner AND tf.term = wt.term JOIN dl ON dl.owner = tf.owner AND dl.id = tf.id GROUP BY ALL),
ev AS (SELECT qid, owner AS scope, id, round(score, 6) AS score, round(covered / mass, 6) AS coverage, matched,
  covered / mass >= 0.25::DOUBLE OR score >= 1.25::DOUBLE * ln(1 + (n + 0.5::DOUBLE) / 0.5::DOUBLE) * """
        + scale
        + r""" AS passed FROM sc JOIN mass USING (qid, owner) WHERE score > 0),
rk AS (SELECT ev.*, k.role, k.occurred_ts, k.created_ts, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k.occurred_ts DESC NULLS LAST, ev.id) AS rank
  FROM ev JOIN k ON k.id = ev.id WHERE passed)"""
    )


def _passing(spark: SparkSession, sf: str, **knobs) -> DataFrame:
    return lexical.evaluate(asked(spark, sf), active(spark, sf), gated=True, **knobs)


# -- lexical ranking -------------------------------------------------------------------------------------------------------------------


@query(
    "WITH "
    + _CARDS
    + ", t AS (SELECT id, " + _terms_sql("text") + """ AS l FROM k)
SELECT id, CAST(len(l) AS BIGINT) AS n_terms, CAST(len(list_distinct(l)) AS BIGINT) AS n_distinct FROM t"""
)
def token_counts(spark, sf):
    t = tokenizer.terms(F.col("text"))
    return cards(spark, sf).select("id", F.size(t).cast("long").alias("n_terms"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(
    "WITH "
    + _CARDS
    + r""", t AS (SELECT id, regexp_extract_all(regexp_replace(lower(text), '([一-鿿])', ' \1 ', 'g'), '([\p{L}\p{N}]+)', 1) AS l FROM k)
SELECT id, CAST(len(l) AS BIGINT) AS n_terms, CAST(len(list_distinct(l)) AS BIGINT) AS n_distinct FROM t"""
)
def simple_token_counts(spark, sf):
    t = X.terms(F.col("text"))
    return cards(spark, sf).select("id", F.size(t).cast("long").alias("n_terms"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("WITH " + _CARDS + ", t AS (SELECT id, unnest(" + _terms_sql("text") + ") AS term FROM k) SELECT term, count(DISTINCT id) AS cards, count(*) AS n FROM t GROUP BY term")
def term_frequencies(spark, sf):
    t = lexical.postings(cards(spark, sf).withColumn("scope_", F.lit(1)), "scope_")
    return t.groupBy("term").agg(F.count("*").alias("cards"), F.sum("tf").alias("n"))


@query(
    "WITH "
    + _ASKED
    + ", t AS (SELECT qid, unnest(list_distinct(" + _terms_sql("text") + r""")) AS term FROM q)
SELECT qid, count(*) FILTER (NOT list_contains("""
    + _STOP
    + """, term)) AS kept, count(*) FILTER (list_contains("""
    + _STOP
    + """, term)) AS dropped FROM t GROUP BY qid"""
)
def query_stopwords(spark, sf):
    t = asked(spark, sf).select("qid", F.explode(F.array_distinct(tokenizer.terms(F.col("text")))).alias("term"))
    stop = F.col("term").isin(*C.STOPWORDS)
    return t.groupBy("qid").agg(F.count_if(~stop).alias("kept"), F.count_if(stop).alias("dropped"))


@query("WITH " + _bm25().replace("WHERE passed)", ")") + " SELECT qid, id, rank, score FROM rk WHERE rank <= 5")
def bm25_topk(spark, sf):
    c = active(spark, sf)
    return lexical.best(asked(spark, sf), c, 5, gated=False).select("qid", "id", "rank", "score")


@query("WITH " + _bm25() + " SELECT qid, id, score, coverage, matched FROM ev WHERE passed")
def bm25_gated(spark, sf):
    return _passing(spark, sf).select("qid", "id", "score", "coverage", "matched")


@query("WITH " + _bm25(terms=8) + " SELECT qid, id, score, coverage FROM ev WHERE passed")
def bm25_gated_scaled(spark, sf):
    return _passing(spark, sf, strong_terms=8).select("qid", "id", "score", "coverage")


@query(
    "WITH "
    + _bm25(floor=1)
    + ", a AS (SELECT scope, count(*) AS found_floor_1 FROM ev WHERE passed GROUP BY scope), "
    + "m AS (SELECT scope, n::BIGINT AS pool, count(*) AS pairs FROM ev JOIN st ON st.owner = ev.scope GROUP BY ALL) "
    + "SELECT m.scope, pool, pairs, coalesce(found_floor_1, 0) AS found_floor_1 FROM m LEFT JOIN a USING (scope)"
)
def bm25_small_pool(spark, sf):
    c = active(spark, sf)
    n = lexical.counted(asked(spark, sf), c, pool_floor=1)
    sizes = lexical.pool(c).select("scope", F.col("n").alias("pool"))
    return n.groupBy("scope").agg(F.sum("pairs").alias("pairs"), F.sum("found").alias("found_floor_1")).join(sizes, "scope").select("scope", "pool", "pairs", "found_floor_1")


# -- vectors and fusion ------------------------------------------------------------------------------------------------------------------

_VECTORS = r"""x AS (SELECT a.vec_id AS qid, b.vec_id AS id, round(greatest(-1, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 4) AS cosine
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
v AS (SELECT qid, id, cosine, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM x WHERE cosine >= 0.1)"""


def _vector_top(spark, sf, limit: int) -> DataFrame:
    e = table(spark, sf, "embeddings")
    asked_ = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return fusion.vector_top(asked_, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), limit, 0.1)


@query("WITH " + _VECTORS + " SELECT qid, id, rank, cosine FROM v WHERE rank <= 10")
def cosine_topk(spark, sf):
    return _vector_top(spark, sf, 10)


_LANES = (
    "WITH "
    + _bm25()
    + """, cv AS (SELECT k.owner, k.id, e.embedding FROM k JOIN embeddings e ON e.vec_id = CAST(substr(k.id, 3) AS BIGINT) % (SELECT count(*) FROM embeddings) WHERE k.state = 'active'),
qv AS (SELECT qid, owner, e.embedding FROM q JOIN embeddings e ON e.vec_id = CAST(substr(q.qid, 2) AS BIGINT) % (SELECT count(*) FROM embeddings)),
vs AS (SELECT qid, id, round(greatest(-1, least(1, list_cosine_similarity(qv.embedding::DOUBLE[], cv.embedding::DOUBLE[]))), 4) AS cosine FROM qv JOIN cv USING (owner)),
vr AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, id) AS rank FROM vs WHERE cosine >= 0.1),
f0 AS (SELECT coalesce(rk.qid, vr.qid) AS qid, coalesce(rk.id, vr.id) AS id, rk.rank AS lexical_rank, vr.rank AS vector_rank,
  round(coalesce(2.0::DOUBLE / (20.0::DOUBLE + vr.rank), 0) + coalesce(1.0::DOUBLE / (20.0::DOUBLE + rk.rank), 0), 6) AS score FROM rk FULL JOIN vr ON rk.qid = vr.qid AND rk.id = vr.id),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f0)"""
)


def _lanes(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries and cards with the number of their vector (vec), and the vectors."""
    e = table(spark, sf, "embeddings")
    size = e.count()  # cards and queries are dealt out over the whole table of vectors
    number = lambda col, at: F.substr(F.col(col), F.lit(at)).cast("long") % size
    q, c = asked(spark, sf).withColumn("vec", number("qid", 2)), active(spark, sf).withColumn("vec", number("id", 3))
    return q, c, e.select(F.col("vec_id").alias("vec"), F.col("embedding").alias("vector"))


@query(_LANES + " SELECT qid, id, lexical_rank, vector_rank, score, rank FROM f WHERE rank <= 20")
def rrf_fusion(spark, sf):
    return hybrid.fused(*_lanes(spark, sf), 20, 0.1).select("qid", "id", "lexical_rank", "vector_rank", "score", "rank")


@query(_LANES + " SELECT CASE WHEN lexical_rank IS NOT NULL AND vector_rank IS NOT NULL THEN 'both' WHEN vector_rank IS NOT NULL THEN 'vector_only' ELSE 'lexical_only' END AS reason, count(*) AS n FROM f GROUP BY 1")
def hybrid_terminal_reason(spark, sf):
    return hybrid.reasons(*_lanes(spark, sf), 0.1)


# -- selection ------------------------------------------------------------------------------------------------------------------------------

_SEATS = """, s1 AS (SELECT *, coalesce(role = 'turning_point', false) AS tp FROM rk),
s2 AS (SELECT *, tp AND row_number() OVER (PARTITION BY qid ORDER BY tp DESC, occurred_ts DESC NULLS LAST, id) <= 3 AS t FROM s1),
s3 AS (SELECT *, count(*) FILTER (t) OVER (PARTITION BY qid) AS nt, row_number() OVER (PARTITION BY qid, t ORDER BY created_ts DESC NULLS LAST, id) AS rn FROM s2),
s4 AS (SELECT *, NOT t AND rn <= least(2, 8 - nt) AS r FROM s3),
s5 AS (SELECT *, count(*) FILTER (r) OVER (PARTITION BY qid) AS nr, row_number() OVER (PARTITION BY qid, t OR r ORDER BY rank) AS qn FROM s4),
s6 AS (SELECT *, CASE WHEN t THEN 'turning_point' WHEN r THEN 'recent' WHEN qn <= 8 - nt - nr THEN 'query' END AS bucket FROM s5),
seat AS (SELECT qid, id, bucket, score, row_number() OVER (PARTITION BY qid ORDER BY rank) AS final_rank FROM s6 WHERE bucket IS NOT NULL)"""


def _seated(spark, sf) -> DataFrame:
    c = active(spark, sf)
    return selection.seats(lexical.seatable(asked(spark, sf), c)[0])


@query("WITH " + _bm25() + _SEATS + " SELECT qid, id, bucket, score, final_rank FROM seat")
def select_quota(spark, sf):
    return _seated(spark, sf)


@query("WITH " + _bm25() + _SEATS + " SELECT bucket, count(*) AS n, count(DISTINCT qid) AS queries FROM seat GROUP BY bucket")
def injection_histogram(spark, sf):
    return _seated(spark, sf).groupBy("bucket").agg(F.count("*").alias("n"), F.countDistinct("qid").alias("queries"))


@query(
    "WITH "
    + _bm25()
    + """, a AS (SELECT qid, id, 'relevance' AS stage, 0 AS place, rank AS n FROM rk WHERE rank <= 8),
b0 AS (SELECT q.qid, k.id, row_number() OVER (PARTITION BY q.qid ORDER BY k.created_ts DESC NULLS LAST, k.id) AS n FROM q JOIN k ON k.owner = q.owner AND k.state = 'active'
  WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.qid = q.qid AND a.id = k.id)),
ab AS (SELECT * FROM a UNION ALL SELECT qid, id, 'recent', 1, n FROM b0 WHERE n <= 4),
p AS (SELECT qid, id, stage, row_number() OVER (PARTITION BY qid ORDER BY place, n) AS position FROM ab)
SELECT qid, id, stage, position FROM p WHERE position <= 12"""
)
def chain_stages(spark, sf):
    c, q = active(spark, sf), asked(spark, sf)
    relevance = written(lexical.best(q, c, 8).select("qid", "id", "rank"), "relevance")  # both stages read it
    # Up to 8 of the newest may be taken by the first stage already: 12 are enough, whatever it took.
    newest = selection.top_by(c.select("owner", "id", "created_ts"), "owner", [F.desc_nulls_last("created_ts"), F.asc("id")], 12)
    recent = q.select("qid", "owner").join(newest, "owner").select("qid", "id", "rank")
    return selection.chain([("relevance", relevance, 8), ("recent", recent, 4)], 12)


@query("WITH " + _CARDS + ", r AS (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY occurred_ts DESC NULLS LAST, id) AS rank FROM k WHERE state = 'active' AND role = 'turning_point') SELECT owner, id, rank FROM r WHERE rank <= 3")
def role_topk(spark, sf):
    c = active(spark, sf).filter("role = 'turning_point'")
    return selection.top_by(c, "owner", [F.desc_nulls_last("occurred_ts"), F.asc("id")], 3).select("owner", "id", "rank")


@query("WITH " + _CARDS + ", r AS (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY created_ts DESC NULLS LAST, id) AS rank FROM k WHERE state = 'active') SELECT owner, id, rank FROM r WHERE rank <= 4")
def recent_topk(spark, sf):
    return selection.top_by(active(spark, sf), "owner", [F.desc_nulls_last("created_ts"), F.asc("id")], 4).select("owner", "id", "rank")


@query("WITH " + _CARDS + ", r AS (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY coalesce(importance, 0) DESC, id) AS rank FROM k WHERE state = 'active') SELECT owner, id, rank FROM r WHERE rank <= 60")
def importance_index(spark, sf):
    return selection.top_by(active(spark, sf), "owner", [F.desc(F.coalesce("importance", F.lit(0.0))), F.asc("id")], 60).select("owner", "id", "rank")


_MARKERS = ("health", "doctor", "medic", "salud", "médic", "arzt", "ärzt", "médecin", "医生", "健康")


@query(
    "WITH "
    + _CARDS
    + ",\n"
    + _ASKED
    + ", g AS (SELECT qid, owner, len(list_filter(["
    + ", ".join(f"'{m}'" for m in _MARKERS)
    + """], lambda m: contains(lower(text), m))) > 0 AS allowed FROM q)
SELECT qid, allowed, count(*) FILTER (allowed OR NOT coalesce(is_sensitive, false)) AS visible, count(*) FILTER (NOT allowed AND coalesce(is_sensitive, false)) AS hidden
FROM g JOIN k ON k.owner = g.owner AND k.state = 'active' GROUP BY qid, allowed"""
)
def sensitive_gate(spark, sf):
    q = asked(spark, sf).select("qid", "owner", selection.sensitive_allowed(F.col("text"), _MARKERS).alias("allowed"))
    per = active(spark, sf).groupBy("owner").agg(F.count("*").alias("n"), F.count_if(F.coalesce("is_sensitive", F.lit(False))).alias("s"))
    return q.join(per, "owner").select("qid", "allowed", F.when(F.col("allowed"), F.col("n")).otherwise(F.col("n") - F.col("s")).alias("visible"), F.when(F.col("allowed"), F.lit(0).cast("long")).otherwise(F.col("s")).alias("hidden"))


# -- lifecycle, relations, pages --------------------------------------------------------------------------------------------------------------


@query("WITH " + _CARDS + " SELECT state, count(*) AS n FROM k GROUP BY state")
def lifecycle_status(spark, sf):
    return lifecycle.with_status(cards(spark, sf)).groupBy("state").agg(F.count("*").alias("n"))


@query("WITH " + _CARDS + " SELECT id, owner, coalesce(mount, 'agent-private') AS mount, state FROM k WHERE coalesce(mount, 'agent-private') IN ('agent-private', 'family-shared') AND state IN ('active', 'archived')")
def scoped_cards(spark, sf):
    c = lifecycle.scoped(cards(spark, sf), ["agent-private", "family-shared"], ["active", "archived"])
    return c.select("id", "owner", F.coalesce("mount", F.lit("agent-private")).alias("mount"), "state")


@query(
    "WITH "
    + _CARDS
    + """, cur AS (SELECT owner, min(id) AS cursor FROM k WHERE state = 'active' GROUP BY owner),
p AS (SELECT k.owner, k.id, k.bucket AS group_label, row_number() OVER (PARTITION BY k.owner ORDER BY k.id) AS n FROM k JOIN cur USING (owner) WHERE state = 'active' AND k.id > cursor),
m AS (SELECT owner, max(n) > 20 AS has_more FROM p GROUP BY owner)
SELECT owner, id, group_label, n, has_more FROM p JOIN m USING (owner) WHERE n <= 20"""
)
def browse_page(spark, sf):
    c = active(spark, sf)
    cursors = c.groupBy("owner").agg(F.min("id").alias("cursor"))
    return lifecycle.page(c, cursors, 20).select("owner", "id", F.col("bucket").alias("group_label"), "n", "has_more")


@query("WITH " + _CARDS + " SELECT tenant, count(*) AS total, count(*) FILTER (state = 'archived') AS archived, count(*) FILTER (state = 'superseded') AS superseded FROM k GROUP BY tenant")
def export_counts(spark, sf):
    return lifecycle.export_counts(cards(spark, sf), "tenant")


@query(
    "WITH "
    + _CARDS
    + """, f AS (SELECT owner, trim(bucket) AS name, min(id) AS place FROM k WHERE state = 'active' AND trim(coalesce(bucket, '')) <> '' GROUP BY ALL)
SELECT owner AS scope, string_agg(name, '、' ORDER BY place, name) AS names, count(*) AS n FROM f GROUP BY owner"""
)
def bucket_vocab(spark, sf):
    return lifecycle.vocabulary(active(spark, sf).select(F.col("owner").alias("scope"), F.col("bucket").alias("name"), F.col("id").alias("place")), 1_000_000)


@query(
    "WITH "
    + _CARDS
    + """, e AS (SELECT owner, id, unnest(threads) AS name FROM k WHERE state = 'active'),
f AS (SELECT owner, trim(name) AS name, min(id) AS place FROM e WHERE trim(name) <> '' GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY place, name) AS n FROM f)
SELECT owner AS scope, string_agg(name, '、' ORDER BY n) AS names, count(*) AS n FROM g WHERE n <= 40 GROUP BY owner"""
)
def thread_vocab(spark, sf):
    return lifecycle.vocabulary(active(spark, sf).select(F.col("owner").alias("scope"), F.explode("threads").alias("name"), F.col("id").alias("place")), 40)


@query(
    "WITH "
    + _CARDS
    + r""", d AS (SELECT *, state <> 'active' OR coalesce(archived, false) AS retired, substr(trim(regexp_replace(coalesce(summary, ''), '\s+', ' ', 'g')), 1, 120) AS line FROM k),
src AS (SELECT tenant AS set_scope, owner, id, threads, supersedes, anchor_memory_ids FROM k WHERE role = 'turning_point'),
ex AS (SELECT owner, id AS source_id, unnest(anchor_memory_ids) AS id, 'anchor' AS relation, 0 AS strength FROM src
  UNION ALL SELECT owner, id, unnest(supersedes), 'supersedes', 1 FROM src),
th AS (SELECT DISTINCT a.owner, a.id AS source_id, b.id, 'thread' AS relation, 2 AS strength FROM (SELECT owner, id, unnest(threads) AS t FROM src) a JOIN (SELECT owner, id, unnest(threads) AS t FROM d) b ON a.owner = b.owner AND a.t = b.t AND a.t <> ''),
al AS (SELECT x.owner, source_id, x.id, relation, strength, line, retired, coalesce(status, 'active') AS st FROM (SELECT * FROM ex UNION ALL SELECT * FROM th) x JOIN d ON d.owner = x.owner AND d.id = x.id WHERE line <> ''),
be AS (SELECT owner, source_id, id, line, arg_min(relation, strength) AS relation, any_value(retired) AS retired, any_value(st) AS st FROM al GROUP BY owner, source_id, id, line),
ok AS (SELECT * FROM be WHERE (NOT retired OR (relation <> 'thread' AND st = 'superseded')) AND NOT EXISTS (SELECT 1 FROM src WHERE src.owner = be.owner AND src.id = be.id)),
fi AS (SELECT owner, id, line, min((CASE WHEN relation = 'thread' THEN 1 ELSE 0 END, source_id, relation)) AS y FROM ok GROUP BY ALL),
nu AS (SELECT owner AS set_id, id, y[2] AS source_id, y[3] AS relation, line AS summary, row_number() OVER (PARTITION BY owner ORDER BY y[1], id) AS rank FROM fi)
SELECT set_id, id, source_id, relation, summary, rank FROM nu WHERE rank <= 6"""
)
def related_one_hop(spark, sf):
    c = cards(spark, sf).withColumn("scope", F.col("owner"))
    return related.one_hop(c.filter("role = 'turning_point'").withColumn("set_id", F.col("owner")), c)


# -- text --------------------------------------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]')) AS BIGINT) AS substantive, CAST(len(regexp_extract_all(coalesce(text, ''), '[一-鿿]')) AS BIGINT) AS cjk, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+(?:''[A-Za-z]+)*')) AS BIGINT) AS latin, substr(sha256(coalesce(text, '')), 1, 12) AS fingerprint FROM documents")
def text_counts(spark, sf):
    cjk, latin = X.language_units(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", X.substantive_len(F.col("text")).cast("long").alias("substantive"), cjk.cast("long").alias("cjk"), latin.cast("long").alias("latin"), X.fingerprint(F.col("text")).alias("fingerprint"))


_PLACEHOLDER = r"""CASE WHEN s = '' THEN 'empty' WHEN regexp_full_match(s, '[\[{(<【〔（《][^\[\]]{0,40}[\]})>】〕）》]') THEN 'bracket_placeholder'
  WHEN regexp_full_match(lower(s), '(?:n/?a|none|null|nil|todo|tbd|placeholder|summary|content|unknown|无|暂无|空|摘要|内容)[.。!！…]*') THEN 'placeholder_word'
  WHEN NOT regexp_matches(s, '[\p{L}\p{N}]') THEN 'no_substantive_chars' ELSE 'content' END"""


@query(r"WITH t AS (SELECT trim(regexp_replace(regexp_replace(coalesce(text, ''), '^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+', ''), '[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$', '')) AS s FROM documents) SELECT " + _PLACEHOLDER + " AS reason, count(*) AS n FROM t GROUP BY 1")
def placeholder_gate(spark, sf):
    d = table(spark, sf, "documents", "text")
    return d.select(F.coalesce(X.placeholder_reason(F.col("text")), F.lit("content")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "WITH "
    + _CARDS
    + r""", d AS (SELECT regexp_replace(lower(coalesce(summary, '')), '[^\p{L}\p{N}\p{M}]+', '', 'g') AS key, id FROM k)
SELECT sha256(key) AS key_hash, min(id) AS keeper, count(*) - 1 AS dropped FROM d GROUP BY key"""
)
def first_wins_dedupe(spark, sf):
    d = cards(spark, sf).select(X.dedupe_key(F.col("summary")).alias("key"), "id")
    return budgets.first_wins(d, "key", ["id"]).select(F.sha2("key", 256).alias("key_hash"), F.col("id").alias("keeper"), (F.col("seen") - 1).alias("dropped"))


@query(
    "WITH "
    + _CARDS
    + r""", p AS (SELECT a.id AS old_id, b.id AS new_id, lower(coalesce(a.summary, '')) AS x, lower(coalesce(b.summary, '')) AS y FROM k a JOIN k b ON b.id = a.superseded_by),
g AS (SELECT old_id, new_id, list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS bx, list_distinct(list_transform(range(1, length(y)), lambda i: substr(y, i, 2))) AS bz FROM p)
SELECT old_id, new_id, round(CASE WHEN len(list_distinct(list_concat(bx, bz))) > 0 THEN len(list_intersect(bx, bz)) / len(list_distinct(list_concat(bx, bz)))::DOUBLE ELSE 0 END, 6) AS jaccard FROM g"""
)
def bigram_jaccard(spark, sf):
    c = cards(spark, sf)
    pairs = c.select(F.col("id").alias("old_id"), F.col("summary").alias("x"), F.col("superseded_by").alias("new_id")).join(c.select(F.col("id").alias("new_id"), F.col("summary").alias("y")), "new_id")
    return pairs.select("old_id", "new_id", F.round(X.bigram_jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query(
    "WITH "
    + _TURNS
    + r""", v AS (SELECT owner, sum(len(regexp_extract_all(text, '[一-鿿]')))::BIGINT AS cjk, sum(len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)*')))::BIGINT AS latin FROM turns GROUP BY owner)
SELECT owner, cjk + latin AS units, CASE WHEN cjk + latin < 12 THEN NULL WHEN greatest(cjk, latin) / (cjk + latin)::DOUBLE < 0.62 THEN NULL WHEN cjk > latin THEN 'zh-Hans' ELSE 'en' END AS written,
  CASE WHEN cjk + latin < 12 THEN 0.0 ELSE round(greatest(cjk, latin) / (cjk + latin)::DOUBLE, 3) END AS confidence FROM v"""
)
def language_vote(spark, sf):
    owners = table(spark, sf, "conversations", "cid", "owner").dropDuplicates(["cid"]).withColumnRenamed("cid", "conv")
    cjk, latin = X.language_units(F.col("text"))
    v = turns(spark, sf).join(owners, "conv").groupBy("owner").agg(F.sum(cjk).alias("cjk"), F.sum(latin).alias("latin"))
    units = F.col("cjk") + F.col("latin")
    sure = F.greatest("cjk", "latin") / units
    enough = (units >= C.MIN_UNITS) & (sure >= C.MIN_CONFIDENCE)
    return v.select("owner", units.alias("units"), F.when(enough, F.when(F.col("cjk") > F.col("latin"), "zh-Hans").otherwise("en")).alias("written"), F.when(units < C.MIN_UNITS, 0.0).otherwise(F.round(sure, 3)).alias("confidence"))


@query(
    r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), b AS (SELECT doc_id, x, str_split(regexp_replace(x, '[^\[\]{}]', '', 'g'), '') AS ch FROM t),
d AS (SELECT doc_id, x, list_transform(ch, lambda c: CASE WHEN c IN ('{', '[') THEN 1 WHEN c IN ('}', ']') THEN -1 ELSE 0 END) AS s FROM b),
m AS (SELECT doc_id, x, coalesce(least(0, list_min(list_transform(range(1, len(s) + 1), lambda i: list_sum(list_slice(s, 1, i))))), 0) AS low FROM d)
SELECT doc_id, CAST(low AS BIGINT) AS least_depth, low < 0 AND (contains(x, '":') OR regexp_matches(x, '[}\]]\s*[}\]]')) AS torn FROM m"""
)
def torn_json(spark, sf):
    x = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", X.least_depth(x).cast("long").alias("least_depth"), X.torn_json(x).alias("torn"))


@query(
    "WITH "
    + _CARDS
    + r""" SELECT id, array_to_string(cues, '|') AS cues, CAST(len(cues) AS BIGINT) AS n FROM k"""
)
def retrieval_cues(spark, sf):
    c = X.cues(F.col("retrieval_cues"))
    return cards(spark, sf).select("id", F.array_join(c, "|").alias("cues"), F.size(c).cast("long").alias("n"))


# -- budgets, windows, batches ------------------------------------------------------------------------------------------------------------------


@query("WITH " + _ASKED + " SELECT qid AS conv, text, n_turns FROM q")
def last4_window(spark, sf):
    return budgets.last_turns(turns(spark, sf))


@query(
    "WITH "
    + _CARDS
    + r""", z AS (SELECT owner, id, coalesce(importance, 0) AS imp, trim(regexp_replace(coalesce(summary, ''), '\s+', ' ', 'g')) AS s, trim(coalesce(bucket, '')) AS b FROM k WHERE state = 'active'),
n AS (SELECT owner, id, imp, '- ' || id || ': ' || CASE WHEN b <> '' THEN '[' || b || '] ' ELSE '' END || CASE WHEN length(s) > 60 THEN substr(s, 1, 59) || '…' ELSE s END AS line FROM z WHERE s <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY imp DESC, id) AS place FROM n),
u AS (SELECT *, sum(length(line) + CASE WHEN place > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY place) AS used FROM r)
SELECT owner AS scope, count(*) AS kept, CAST(max(used) AS BIGINT) AS chars FROM u WHERE used <= 2000 GROUP BY owner"""
)
def budgeted_index(spark, sf):
    c = active(spark, sf).filter(X.collapse(F.coalesce("summary", F.lit(""))) != "")
    place = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc(F.coalesce("importance", F.lit(0.0))), F.asc("id")))
    c = c.withColumn("place", place).filter("place <= 2000")  # no line is empty, so no more fit: the window keeps just these
    lines = c.select(F.col("owner").alias("scope"), "place", budgets.index_line(F.col("id"), F.col("bucket"), F.col("summary"), 60).alias("line"))
    return budgets.within_budget(lines, 2000).groupBy("scope").agg(F.count("*").alias("kept"), F.max("used").alias("chars"))


@query(
    "WITH "
    + _TURNS
    + """, o AS (SELECT cid AS scope, turn AS place, text, coalesce(sum(length(text)) OVER (PARTITION BY cid ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM turns)
SELECT scope, place, start, scope || ':b' || start || ':' || substr(sha256(text), 1, 16) AS batch_key FROM o"""
)
def batch_offsets(spark, sf):
    parts = turns(spark, sf).select(F.col("conv").alias("scope"), F.col("turn").alias("place"), "text")
    return budgets.offsets(parts).select("scope", "place", "start", "batch_key")


_CHUNKS = r"""WITH RECURSIVE c AS (SELECT doc_id, coalesce(text, '') AS text, 0::BIGINT AS part, 0::BIGINT AS start, 0::BIGINT AS size FROM documents WHERE coalesce(text, '') <> ''
  UNION ALL SELECT doc_id, text, part + 1, start + size, CASE WHEN length(text) - start - size <= 6000 OR strpos(reverse(substr(text, start + size + 3001, 3000)), chr(10)) = 0 THEN least(6000, length(text) - start - size)
    ELSE 6000 - strpos(reverse(substr(text, start + size + 3001, 3000)), chr(10)) + 1 END FROM c WHERE start + size < length(text)),
p AS (SELECT doc_id, part - 1 AS part, start, substr(text, start + 1, size) AS chunk FROM c WHERE part > 0)
"""


@query(_CHUNKS + "SELECT doc_id, part, start, length(chunk) AS chars, sha256(chunk) AS digest FROM p")
def chunk_material(spark, sf):
    return budgets.chunks(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", "part", "start", F.length("chunk").cast("long").alias("chars"), F.sha2("chunk", 256).alias("digest"))


# -- maintenance ----------------------------------------------------------------------------------------------------------------------------------

_SHAPES = (
    "WITH "
    + _CARDS
    + """, b AS (SELECT owner AS scope, substr(sha256(id), 1, 3) AS bucket, count(*) FILTER (state = 'active') AS cards, count(*) FILTER (coalesce(trim(source), '') <> 'memory_dream') AS seeds,
  sha256(string_agg(CASE WHEN coalesce(trim(source), '') <> 'memory_dream' THEN sha256(id || '|' || coalesce(source, '') || '|' || coalesce(created_at, '') || '|' || coalesce(occurred_at, '')) END, chr(10) ORDER BY id)) AS digest FROM k GROUP BY ALL),
g AS (SELECT scope, sum(cards)::BIGINT AS card_count, sum(seeds)::BIGINT AS seed_count, substr(sha256(coalesce(string_agg(CASE WHEN seeds > 0 THEN digest END, chr(10) ORDER BY bucket), '')), 1, 32) AS signature FROM b GROUP BY scope)"""
)


@query(_SHAPES + " SELECT scope, card_count, seed_count, signature FROM g")
def garden_signature(spark, sf):
    return maintenance.shapes(cards(spark, sf))


_BEFORE = _SHAPES[_SHAPES.index("b AS (SELECT owner AS scope") :].replace("b AS (SELECT owner", "b2 AS (SELECT owner", 1).replace("FROM k GROUP BY ALL", "FROM k WHERE NOT coalesce(archived, false) GROUP BY ALL").replace("g AS (SELECT scope", "g2 AS (SELECT scope").replace("FROM b GROUP BY scope", "FROM b2 GROUP BY scope")


@query(
    _SHAPES
    + ", "
    + _BEFORE
    + """, j AS (SELECT g.*, coalesce(g2.signature, '') AS last, greatest(0, g.seed_count - greatest(0, coalesce(g2.seed_count, 0))) AS new_cards FROM g LEFT JOIN g2 USING (scope))
SELECT scope, CASE WHEN card_count <= 0 THEN 'no_memory_cards' WHEN last <> '' AND last = signature THEN 'already_dreamed' WHEN new_cards < 10 THEN 'not_enough_new_cards' ELSE 'due' END AS reason, new_cards,
  'dream:' || substr(sha256(last || '|' || signature || '|' || seed_count), 1, 32) AS key FROM j"""
)
def maintenance_verdict(spark, sf):
    """Which gardens are due, against a ledger of the last run: what they were before the cards that are archived now came."""
    c = cards(spark, sf)
    before = maintenance.shapes(c.filter(~F.coalesce("archived", F.lit(False))))
    return maintenance.verdicts(maintenance.shapes(c), before.select("scope", F.col("signature").alias("last_signature"), F.col("seed_count").alias("last_seed_count")))


def _backlog(spark, sf) -> DataFrame:
    """Cards that changed since their review: reviewed are those that were never updated after."""
    c = cards(spark, sf)
    reviewed = c.filter("updated_at is null").select("id", maintenance.version(c).alias("version"))
    return maintenance.pending(c, reviewed)


@query("WITH " + _CARDS + " SELECT id, created_at FROM k WHERE updated_at IS NOT NULL")
def pending_cards(spark, sf):
    return _backlog(spark, sf).select("id", "created_at")


@query(
    "WITH "
    + _CARDS
    + """, p AS (SELECT owner, id, threads, row_number() OVER (PARTITION BY owner ORDER BY coalesce(created_at, ''), id) AS n FROM k WHERE updated_at IS NOT NULL),
th AS (SELECT DISTINCT owner, unnest(threads) AS t FROM p WHERE n <= 5),
sa AS (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY id) AS n FROM (SELECT DISTINCT x.owner, x.id FROM (SELECT owner, id, unnest(threads) AS t FROM k) x JOIN th ON th.owner = x.owner AND th.t = x.t)),
im AS (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY coalesce(importance, 0) DESC, id) AS n FROM k),
al AS (SELECT owner, id, 0 AS kk, n, 'backlog' AS step FROM p WHERE n <= 5 UNION ALL SELECT owner, id, 1, n, 'thread' FROM sa UNION ALL SELECT owner, id, 2, n, 'related' FROM im WHERE n <= 10 UNION ALL SELECT owner, id, 3, n, 'backlog' FROM p),
mi AS (SELECT owner, id, min((kk, n, step)) AS x FROM al GROUP BY ALL),
pl AS (SELECT owner, id, x[3] AS step, row_number() OVER (PARTITION BY owner ORDER BY x[1], x[2], id) AS place FROM mi)
SELECT owner, id, step, place FROM pl WHERE place <= 10"""
)
def maintenance_batch(spark, sf):
    c = cards(spark, sf)
    important = selection.top_by(c, "owner", [F.desc(F.coalesce("importance", F.lit(0.0))), F.asc("id")], 10)
    return maintenance.batches(c, _backlog(spark, sf), important.select("owner", "id", "rank"), 10)


@query("WITH " + _CARDS + ", n AS (SELECT owner, count(*) FILTER (state <> 'active') AS retiring, count(*) AS active FROM k GROUP BY owner) SELECT owner, retiring, active, retiring >= 10 AND retiring > active * 0.8 AS blown FROM n")
def blast_fuse(spark, sf):
    n = lifecycle.with_status(cards(spark, sf)).groupBy("owner").agg(F.count_if(F.col("state") != "active").alias("retiring"), F.count("*").alias("active"))
    return n.withColumn("blown", maintenance.fuse_blown(F.col("retiring"), F.col("active")))


@query(
    r"""WITH t AS (SELECT owner, 'cards' AS tab, id AS key, unnest(['summary', 'content']) AS field, unnest([summary, content]) AS text FROM cards
  UNION ALL SELECT owner, 'mutations', feed_seq::VARCHAR, unnest(['card.summary', 'card.content', 'changes.summary', 'changes.content', 'reason']),
    unnest([card.summary, card.content, changes['summary'], changes['content'], reason]) FROM mutations),
i AS (SELECT DISTINCT coalesce(owner, '') AS owner, trim(id) AS id FROM (SELECT owner, id FROM cards UNION ALL SELECT owner, card.id FROM mutations) WHERE length(trim(id)) >= 8)
SELECT tab, key, field, min(i.id) AS id FROM t JOIN i ON i.owner = coalesce(t.owner, '') AND contains(t.text, i.id) GROUP BY tab, key, field"""
)
def id_leak(spark, sf):
    """(tab, key, field, id) of card texts, stored or in the feed, in which a card id of the same owner stands."""
    c, m = table(spark, sf, "cards"), table(spark, sf, "mutations")
    fields = lambda **x: F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(v).alias("text")) for k, v in x.items()])).alias("x")
    stored = c.select("owner", F.lit("cards").alias("tab"), F.col("id").alias("key"), fields(summary="summary", content="content"))
    said = {"card.summary": "card.summary", "card.content": "card.content", "changes.summary": "changes.summary", "changes.content": "changes.content", "reason": "reason"}
    fed = m.select("owner", F.lit("mutations").alias("tab"), F.col("feed_seq").cast("string").alias("key"), fields(**said))
    ids = c.select("owner", "id").unionAll(m.select("owner", "card.id"))
    return maintenance.leaked_ids(stored.unionAll(fed).select("owner", "tab", "key", "x.*"), ids, ("tab", "key", "field"))


_FEED = "f AS (SELECT DISTINCT ON (feed_seq) *, CASE WHEN trim(coalesce(op, '')) = '' THEN 'add' ELSE lower(trim(op)) END AS o FROM mutations)"


@query(
    "WITH "
    + _FEED
    + """, s AS (SELECT coalesce(mount, 'agent-private') AS mount, strftime(arrived_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS new_seeds FROM f WHERE o IN ('add', 'supersede') AND coalesce(card.source, '') <> 'memory_dream' GROUP BY ALL)
SELECT mount, day, new_seeds, CAST(sum(new_seeds) OVER (PARTITION BY mount ORDER BY day) AS BIGINT) AS generation FROM s"""
)
def seed_generations(spark, sf):
    m = table(spark, sf, "mutations").dropDuplicates(["feed_seq"])
    op = F.when(F.trim(F.coalesce("op", F.lit(""))) == "", "add").otherwise(F.lower(F.trim("op")))
    feed = m.select(F.coalesce("mount", F.lit("agent-private")).alias("mount"), F.date_format("arrived_at", "yyyy-MM-dd").alias("day"), op.alias("op"), F.col("card.source").alias("source"))
    return maintenance.seed_generations(feed)


@query(
    "WITH "
    + _FEED
    + """, g AS (SELECT idempotency_key, min(feed_seq) AS first_seq, count(*) - 1 AS repeats, count(DISTINCT o || '|' || coalesce(CASE WHEN o = 'add' THEN card.id WHEN o = 'supersede' THEN target_ids[1] ELSE record_id END, '')) > 1 AS conflict FROM f GROUP BY idempotency_key)
SELECT * FROM g"""
)
def idempotent_replay(spark, sf):
    from cardloom.operators.change_feed import tidy

    m = tidy(table(spark, sf, "mutations").dropDuplicates(["feed_seq"]))
    digest = F.concat_ws("|", "op_", F.coalesce("record_", F.lit("")))
    return m.groupBy("idempotency_key").agg(F.min("feed_seq").alias("first_seq"), (F.count("*") - 1).alias("repeats"), (F.countDistinct(digest) > 1).alias("conflict"))


@query(
    "WITH "
    + _FEED
    + """ SELECT CASE WHEN o NOT IN ('add', 'update', 'supersede', 'archive', 'delete', 'promote', 'no_op') THEN 'unknown_op' WHEN o IN ('add', 'supersede') AND card.id IS NULL THEN 'card_missing'
  WHEN o = 'supersede' AND len(coalesce(target_ids, [])) = 0 THEN 'target_missing' WHEN o IN ('update', 'archive', 'delete', 'promote') AND record_id IS NULL THEN 'record_missing'
  WHEN o = 'delete' AND requested_by IS NULL THEN 'requester_missing' WHEN o = 'promote' AND to_mount IS NULL THEN 'mount_missing' ELSE 'valid' END AS verdict, count(*) AS n FROM f GROUP BY 1"""
)
def mutation_validation(spark, sf):
    from cardloom.operators.change_feed import OPS, tidy

    m = tidy(table(spark, sf, "mutations").dropDuplicates(["feed_seq"]))
    op = F.col("op_")
    verdict = (
        F.when(~op.isin(*OPS, "no_op"), "unknown_op")
        .when(op.isin("add", "supersede") & F.col("card.id").isNull(), "card_missing")
        .when((op == "supersede") & (F.coalesce(F.size("target_ids"), F.lit(0)) <= 0), "target_missing")
        .when(op.isin("update", "archive", "delete", "promote") & F.col("record_id").isNull(), "record_missing")
        .when((op == "delete") & F.col("requested_by").isNull(), "requester_missing")
        .when((op == "promote") & F.col("to_mount").isNull(), "mount_missing")
        .otherwise("valid")
    )
    return m.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


# -- quality --------------------------------------------------------------------------------------------------------------------------------------


def _judged(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results of a search by summary in the owner's garden; truth: the card itself, as 'should' the others of its bucket, and as
    'must_not' sensitive ones. A card without summary should find nothing."""
    c = active(spark, sf)
    asked_ = c.filter("role = 'turning_point'").select(F.col("id").alias("qid"), "owner", F.col("summary").alias("text"), "bucket")
    results = written(lexical.best(asked_, c, 8).select("qid", "id", "rank"), "results")  # read twice
    must = asked_.select("qid", F.col("qid").alias("id"), F.lit("must").alias("label"))
    # Of the others only those that were found count: labels are given to results, no bucket is paired with itself.
    found = results.join(asked_.select("qid", "bucket"), "qid").join(c.select("id", F.col("bucket").alias("its"), "is_sensitive"), "id")
    label = F.when(F.coalesce("is_sensitive", F.lit(False)), "must_not").when(F.col("bucket") == F.col("its"), "should")
    others = found.filter("qid <> id").select("qid", "id", label.alias("label")).filter("label is not null")
    blank = X.strip(F.coalesce("text", F.lit(""))) == ""
    return results, must.unionByName(others), asked_.select("qid", blank.alias("expect_empty"), F.coalesce("bucket", F.lit("")).alias("category"))


_JUDGED = (
    "WITH "
    + _bm25().replace("q AS (SELECT cid AS qid, any_value(owner) AS owner", "q0 AS (SELECT cid AS qid, any_value(owner) AS owner").replace(
        "pool AS (SELECT * FROM k", "q AS (SELECT id AS qid, owner, summary AS text, bucket FROM k WHERE state = 'active' AND role = 'turning_point'),\npool AS (SELECT * FROM k", 1
    )
    + """, tr AS (SELECT qid, qid AS id, 'must' AS label FROM q UNION ALL SELECT q.qid, k.id, CASE WHEN coalesce(k.is_sensitive, false) THEN 'must_not' ELSE 'should' END FROM q JOIN k ON k.owner = q.owner AND (k.bucket = q.bucket OR coalesce(k.is_sensitive, false)) AND k.state = 'active' AND k.id <> q.qid),
j AS (SELECT rk.qid, rk.rank, tr.label FROM rk LEFT JOIN tr ON tr.qid = rk.qid AND tr.id = rk.id WHERE rk.rank <= 8),
a AS (SELECT qid, count(*) AS returned, count(*) FILTER (label = 'must' AND rank <= 5) AS got, count(*) FILTER (label IN ('must', 'should') AND rank <= 3) AS good, count(*) FILTER (rank <= 3) AS shown,
  min(rank) FILTER (label = 'must') AS first, count(*) FILTER (label = 'must_not') AS bad FROM j GROUP BY qid),
e AS (SELECT q.qid, coalesce(q.bucket, '') AS category, round(coalesce(got, 0) / 1.0::DOUBLE, 6) AS recall, round(CASE WHEN coalesce(shown, 0) > 0 THEN good / shown::DOUBLE END, 6) AS precision,
  round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank, coalesce(bad, 0) AS violations, trim(coalesce(q.text, '')) = '' AND coalesce(returned, 0) = 0 AS right_empty, coalesce(returned, 0) = 0 AS false_empty FROM q LEFT JOIN a USING (qid))"""
)


@query(_JUDGED + " SELECT qid, recall, precision, reciprocal_rank, violations, right_empty, false_empty FROM e")
def retrieval_metrics(spark, sf):
    results, truth, asked_ = _judged(spark, sf)
    return metrics.per_query(results, truth, asked_)


@query(_JUDGED + " SELECT category, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(reciprocal_rank), 6) AS reciprocal_rank, sum(violations)::BIGINT AS violations, count(*) FILTER (right_empty) AS right_empty, count(*) FILTER (false_empty) AS false_empty FROM e GROUP BY category")
def metrics_by_category(spark, sf):
    results, truth, asked_ = _judged(spark, sf)
    return metrics.summary(metrics.per_query(results, truth, asked_).join(asked_.select("qid", "category"), "qid"), "category")


# -- sessions --------------------------------------------------------------------------------------------------------------------------------------


@query(
    """WITH g AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)
SELECT user_id, count(*) FILTER (before IS NULL OR ts - before >= INTERVAL 15 MINUTE) AS sessions, count(*) AS n FROM g GROUP BY user_id"""
)
def idle_sessions(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = e.groupBy("user_id", F.session_window("ts", C.SESSION_TTL)).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))




_sql_list = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


def _units_sql(name: str, rows: str) -> str:
    """CTE `name` (key, owner, kind, unit): the units of rows (key, owner, x), as `evidence.units` has them."""
    stop, generic, phrases = _sql_list(evidence.STOP), _sql_list(evidence.GENERIC), _sql_list(evidence.GENERIC_PHRASES)
    return rf"""{name}_w AS (SELECT DISTINCT key, owner, unnest(regexp_extract_all(x, '[a-z0-9_]{{2,}}')) AS unit FROM {rows}),
{name}_h AS (SELECT key, owner, unnest(regexp_extract_all(regexp_replace(x, '[{evidence.STOP_CHARS}]', ' ', 'g'), '[一-鿿]{{2,}}')) AS r FROM {rows}),
{name}_g AS (SELECT DISTINCT key, owner, unnest(flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, greatest(1, length(r) - n + 2)), lambda k: substr(r, k, n))))) AS unit FROM {name}_h),
{name}_r AS (SELECT key, owner, regexp_extract_all(r, '[a-z0-9_]+') AS ws FROM (SELECT key, owner, unnest(regexp_extract_all(x, '[a-z0-9_]+(?:[ \t\n\x0b\f\r_\-]+[a-z0-9_]+)+')) AS r FROM {rows})),
{name}_l AS (SELECT DISTINCT key, owner, unnest(flatten(list_transform([2, 3, 4, 5], lambda n: list_transform(range(1, greatest(1, len(ws) - n + 2)), lambda k: list_slice(ws, k, k + n - 1))))) AS part FROM {name}_r),
{name} AS (SELECT key, owner, CASE WHEN list_contains({generic}, unit) THEN 'weak' ELSE 'rare' END AS kind, unit FROM {name}_w WHERE NOT list_contains({stop}, unit) AND (length(unit) >= 3 OR list_contains({generic}, unit))
  UNION ALL SELECT key, owner, 'phrase', unit FROM {name}_g WHERE NOT list_contains({phrases}, unit)
  UNION ALL SELECT key, owner, 'phrase', array_to_string(part, ' ') FROM {name}_l WHERE NOT list_contains({stop}, part[1]) AND NOT list_contains({stop}, part[-1]) AND len(list_filter(part, lambda w: length(w) > 1 AND NOT list_contains({stop}, w) AND NOT list_contains({generic}, w))) > 0
  UNION ALL SELECT key, owner, 'weak', unnest(list_filter({phrases}, lambda p: contains(x, p))) FROM {rows})"""


def _pairs_of(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i, 2)))"


_LEGACY = (
    "WITH "
    + _CARDS
    + ",\n"
    + _ASKED
    + ", qx AS (SELECT qid AS key, owner, lower(coalesce(text, '')) AS x FROM q), cx AS (SELECT id AS key, owner, lower(coalesce(text, '')) AS x FROM k WHERE state = 'active'),\n"
    + _units_sql("qu", "qx")
    + ",\n"
    + _units_sql("cu", "cx")
    + rf""", n0 AS (SELECT qu.key AS qid, cu.key AS id, count(*) FILTER (kind = 'phrase' AND length(replace(unit, ' ', '')) >= 4) AS e, count(*) FILTER (kind = 'phrase') AS p, count(*) FILTER (kind = 'rare') AS r, count(*) FILTER (kind = 'weak') AS w0,
  count(*) FILTER (kind = 'weak' AND (regexp_matches(unit, '[a-z0-9_]') OR length(unit) >= 2)) AS s FROM qu JOIN cu USING (owner, kind, unit) GROUP BY ALL),
n1 AS (SELECT n0.*, qx.x AS qt, cx.x AS ct FROM n0 JOIN qx ON qx.key = qid JOIN cx ON cx.key = id WHERE p > 0 OR r > 0 OR s >= 2),
n2 AS (SELECT *, CASE WHEN p = 0 AND r = 1 AND w0 = 0 AND len(list_intersect(list_filter(regexp_extract_all(qt, '[一-鿿]'), lambda c: NOT contains('{evidence.STOP_CHARS}', c)), regexp_extract_all(ct, '[一-鿿]'))) > 0 THEN 1 ELSE w0 END AS w,
  CASE WHEN p = 0 AND r = 0 THEN coalesce(len(list_intersect({_pairs_of('qt')}, {_pairs_of('ct')})) / nullif(len(list_distinct(list_concat({_pairs_of('qt')}, {_pairs_of('ct')}))), 0)::DOUBLE, 0) ELSE 0 END AS b FROM n1),
n3 AS (SELECT qid, id, CASE WHEN e > 0 THEN [0.86 + least(0.08, 0.02 * e), 3, 1] WHEN p > 0 THEN [0.68 + least(0.12, 0.03 * p), 3, 2] WHEN r >= 2 THEN [0.52 + least(0.12, 0.03 * r), 2, 3] WHEN r = 1 AND w > 0 THEN [0.36, 2, 4] WHEN r = 1 THEN [0.28, 1, 5]
  WHEN s >= 3 OR s >= 2 AND b >= 0.12 THEN [least(0.42, 0.24 + 0.04 * s + least(0.06, b)), 2, 6] ELSE [0, 1, 7] END::DOUBLE[] AS v FROM n2)
SELECT qid, id, round(v[1], 4) AS score, CASE v[2] WHEN 3 THEN 'strong' ELSE 'medium' END AS confidence, ['entity_phrase_match', 'phrase_match', 'multiple_rare_terms', 'rare_term_with_support', 'single_rare_term', 'multiple_weak_terms', ''][v[3]::INT] AS reason
FROM n3 WHERE round(v[1], 4) >= {evidence.MIN_RELEVANCE} AND v[2] >= 2"""
)


@query(_LEGACY)
def legacy_relevance(spark, sf):
    return evidence.relevance(asked(spark, sf), active(spark, sf))


@query(_CHUNKS + "SELECT doc_id AS scope, part AS place, start, doc_id || ':b' || start || ':' || substr(sha256(chunk), 1, 16) AS batch_key FROM p WHERE part = 1")
def import_next_batch(spark, sf):
    plan = importing.plan(table(spark, sf, "documents", "doc_id", "text"))
    done = plan.filter("place = 0").select("batch_key")
    return importing.next_batch(plan, done).select("scope", "place", "start", "batch_key")


@query(
    "WITH "
    + _bm25()
    + """, a AS (SELECT q.qid, k.id, k.importance FROM q JOIN k ON k.owner = q.owner AND k.state = 'active'),
b AS (SELECT a.qid, a.id, rk.rank, row_number() OVER (PARTITION BY a.qid ORDER BY coalesce(importance, 0) DESC, a.id) AS w FROM a LEFT JOIN rk ON rk.qid = a.qid AND rk.id = a.id),
s AS (SELECT *, CASE WHEN rank <= 15 THEN 0 WHEN w <= 20 THEN 1 WHEN rank IS NOT NULL THEN 2 ELSE 3 END AS step FROM b),
o AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY step, CASE WHEN step IN (0, 2) THEN rank ELSE w END, id) AS place FROM s)
SELECT qid, id, place FROM o WHERE place <= 20"""
)
def import_index(spark, sf):
    c, q = active(spark, sf), asked(spark, sf)
    ranked = lexical.best(q, c, 20)  # no place is left for a rank beyond: there are 20 weighty cards, or they are all
    weighty = selection.top_by(c, "owner", [F.desc(F.coalesce("importance", F.lit(0.0))), F.asc("id")], 20).select("owner", "id", F.col("rank").alias("w"))
    return importing.index_pick(ranked, q.select("qid", "owner").join(weighty, "owner"), 20)
