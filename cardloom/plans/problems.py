"""Queries of the general data problems: timestamps, change feed, hierarchies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.operators import change_feed, hierarchy, timestamps
from cardloom.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Cards whose occurred_at and created_at are both instants, the former the later."""
    return timestamps.written_before_it_happened(table(spark, sf, "cards"), table(spark, sf, "gardens"))


def p1_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Every card's occurred_at and created_at as one UTC instant or a date (written as ISO)."""
    found = timestamps.card_instants(table(spark, sf, "cards"), table(spark, sf, "gardens"))
    return found.withColumns({c: F.col(c).cast("string") for c in ("occurred_at_date", "created_at_date")})


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each record that exists at the end of the feed and the key of the last change that counted for it."""
    return change_feed.replay(table(spark, sf, "mutations")).records().select("record_id", "idempotency_key")


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    """The records as they stand at the end of the feed."""
    return change_feed.replay(table(spark, sf, "mutations")).records().withColumn("revision", F.col("revision").cast("long"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every card with a link and the card where the way up ends."""
    return hierarchy.roots(table(spark, sf, "cards", "id", "superseded_by", "supersedes"))


def p6_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Path, depth, root and number of descendants of every linked card, with circles reported."""
    return hierarchy.paths(table(spark, sf, "cards", "id", "superseded_by", "supersedes")).withColumn("path", F.array_join("path", "/"))


def p6_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every descendant of every linked card, with its distance. As large as that is: n^2 / 2 rows for a chain of n cards."""
    return hierarchy.closure(hierarchy.forest(hierarchy.parents(table(spark, sf, "cards", "id", "superseded_by", "supersedes"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_normalised, p2_found, p2_records, p6_found, p6_paths, p6_descendants)}

_INSTANTS = r"""WITH g AS (SELECT owner, coalesce(nullif(trim(tz), ''), 'UTC') AS tz, regexp_full_match(lower(coalesce(locale, '')), 'en([-_](us|ph))?') AS us FROM gardens),
v AS (SELECT DISTINCT c.id, k.col, trim(k.raw) AS v, coalesce(g.tz, 'UTC') AS tz, coalesce(g.us, false) AS us FROM cards c LEFT JOIN g USING (owner), LATERAL (SELECT unnest(['o', 'c']) AS col, unnest([c.occurred_at, c.created_at]) AS raw) k),
p AS (SELECT *, regexp_extract(v, '^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2}(?:\.\d+)?)? ?(?:(Z|[+-]\d{2}:?\d{2})|\[?([A-Z]{3,4}|[A-Za-z]+/[A-Za-z_]+)\]?)?$', ['d', 'hm', 's', 'off', 'zone']) AS iso,
  regexp_extract(v, '^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z$', ['y', 'm', 'd', 'h', 'mi', 's']) AS pk,
  regexp_extract(v, '^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) ([+-]\d{4})$', ['t', 'off']) AS mail,
  regexp_extract(v, '^(\d{2})[/.](\d{2})[/.](\d{4}) (\d{2}:\d{2})(?: ([AP]M))?$', ['a', 'b', 'y', 'hm', 'half']) AS loc,
  regexp_extract(v, '^(\d{4})年(\d{1,2})月(\d{1,2})日 (\d{2}:\d{2})$', ['y', 'm', 'd', 'hm']) AS zh FROM v),
w AS (SELECT id, col, v, tz, CASE WHEN iso.d <> '' THEN try_cast(iso.d || ' ' || iso.hm || CASE WHEN iso.s <> '' THEN iso.s ELSE ':00' END AS TIMESTAMP)
    WHEN pk.y <> '' THEN try_cast(pk.y || '-' || pk.m || '-' || pk.d || ' ' || pk.h || ':' || pk.mi || ':' || pk.s AS TIMESTAMP)
    WHEN mail.t <> '' THEN try_strptime(mail.t, '%d %b %Y %H:%M:%S')
    WHEN loc.half <> '' THEN try_strptime(CASE WHEN us THEN loc.a || ' ' || loc.b ELSE loc.b || ' ' || loc.a END || ' ' || loc.y || ' ' || loc.hm || ' ' || loc.half, '%m %d %Y %I:%M %p')
    WHEN loc.y <> '' THEN try_strptime(CASE WHEN us THEN loc.a || ' ' || loc.b ELSE loc.b || ' ' || loc.a END || ' ' || loc.y || ' ' || loc.hm, '%m %d %Y %H:%M')
    WHEN zh.y <> '' THEN try_cast(zh.y || '-' || lpad(zh.m, 2, '0') || '-' || lpad(zh.d, 2, '0') || ' ' || zh.hm || ':00' AS TIMESTAMP) END AS wall,
  CASE WHEN iso.off <> '' THEN iso.off WHEN mail.off <> '' THEN mail.off WHEN pk.y <> '' THEN 'Z' WHEN iso.zone IN ('UTC', 'GMT') THEN 'Z' WHEN iso.zone = 'CET' THEN '+0100' WHEN iso.zone = 'CEST' THEN '+0200' WHEN iso.zone = 'EST' THEN '-0500' WHEN iso.zone = 'EDT' THEN '-0400'
    WHEN iso.zone = 'PST' THEN '-0800' WHEN iso.zone = 'PDT' THEN '-0700' END AS off, CASE WHEN contains(iso.zone, '/') THEN iso.zone ELSE tz END AS region FROM p),
e AS (SELECT id, col, CASE WHEN regexp_full_match(v, '\d{10}') THEN CAST(v AS BIGINT) * 1000000 WHEN regexp_full_match(v, '\d{13}') THEN CAST(v AS BIGINT) * 1000
    WHEN off = 'Z' THEN epoch_us(wall) WHEN off IS NOT NULL THEN epoch_us(wall) - (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END) * (CAST(substr(off, 2, 2) AS BIGINT) * 60 + CAST(right(off, 2) AS BIGINT)) * 60000000
    WHEN timezone(region, timezone(region, wall) - INTERVAL 1 HOUR) = wall THEN epoch_us(timezone(region, wall) - INTERVAL 1 HOUR) ELSE epoch_us(timezone(region, wall)) END AS us FROM w)
"""
_LINKS = r"""WITH RECURSIVE c AS (SELECT DISTINCT ON (id) id, superseded_by, supersedes FROM cards WHERE id IS NOT NULL),
ids AS (SELECT lower(trim(id)) AS ref, min(id) AS other FROM c GROUP BY 1),
links AS (SELECT c.id AS child, ids.other AS parent, 0 AS kind FROM c JOIN ids ON ids.ref = lower(trim(c.superseded_by))
  UNION ALL SELECT ids.other, x.id, 1 FROM (SELECT id, unnest(supersedes) AS s FROM c) x JOIN ids ON ids.ref = lower(trim(x.s))),
par AS (SELECT child, arg_min(parent, (kind, parent)) AS parent FROM links GROUP BY child),
"""
_FEED = r"""WITH RECURSIVE f AS (SELECT DISTINCT ON (feed_seq) *, CASE WHEN trim(coalesce(op, '')) = '' THEN 'add' ELSE regexp_replace(lower(trim(op)), '[\s-]+', '_', 'g') END AS o, trim(expected_revision) AS x FROM mutations),
h AS (SELECT *, coalesce(idempotency_key, 'feed_seq:' || feed_seq) AS k, CASE WHEN o = 'add' THEN card.id WHEN o = 'supersede' THEN coalesce(target_ids[1], record_id) ELSE record_id END AS rec,
  CASE WHEN coalesce(x, '') = '' THEN 0 ELSE try_cast(regexp_extract(x, '(\d{1,18})', 1) AS BIGINT) END AS rev FROM f),
ch AS (SELECT * FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY k ORDER BY feed_seq) = 1)
  WHERE o IN ('add', 'update', 'supersede', 'archive', 'delete', 'promote') AND rec IS NOT NULL AND rev IS NOT NULL),
best AS (SELECT rec, rev, o = 'add' AS is_add, arg_min({'seq': feed_seq, 'o': o, 'k': k, 'new': card.id}, feed_seq) AS c FROM ch GROUP BY ALL),
walk AS (SELECT DISTINCT rec, 0::BIGINT AS rev, false AS ok FROM ch UNION
  SELECT x.rec, x.rev, x.ok FROM (SELECT unnest(list_concat([{'rec': w.rec, 'rev': w.rev + 1, 'ok': c.o <> 'delete'}], CASE WHEN c.o = 'supersede' AND c.new IS NOT NULL THEN [{'rec': c.new, 'rev': 1::BIGINT, 'ok': true}] ELSE [] END)) AS x
    FROM walk w JOIN best b ON b.rec = w.rec AND b.rev = w.rev AND b.is_add = NOT w.ok)),
own AS (SELECT w.rec, w.rev + 1 AS rev, c.seq, c.o, c.k, c.new FROM walk w JOIN best b ON b.rec = w.rec AND b.rev = w.rev AND b.is_add = NOT w.ok),
done AS (SELECT rec, rev, arg_min({'seq': seq, 'k': k, 'o': o}, seq) AS d FROM (SELECT rec, rev, seq, k, o FROM own UNION ALL SELECT new, 1, seq, k, 'start' FROM own WHERE o = 'supersede' AND new IS NOT NULL) GROUP BY rec, rev),
tip AS (SELECT rec, max(rev) AS rev, arg_max(ok, rev) AS ok FROM walk GROUP BY rec)
"""

SQL: dict[str, str] = {
    "p1_found": _INSTANTS + "SELECT o.id FROM (SELECT id, us FROM e WHERE col = 'o') o JOIN (SELECT id, us FROM e WHERE col = 'c') c ON o.id = c.id WHERE o.us > c.us",
    "p1_normalised": _INSTANTS
    + r""", d AS (SELECT id, col, CASE WHEN regexp_full_match(v, '\d{4}-\d{2}-\d{2}') THEN try_cast(v AS DATE)
    WHEN regexp_full_match(v, '\d{4}年\d{1,2}月\d{1,2}日') THEN try_cast(regexp_replace(v, '(\d{4})年(\d{1,2})月(\d{1,2})日', '\1-\2-\3') AS DATE)
    WHEN regexp_full_match(v, '\d{2}[/.]\d{2}[/.]\d{4}') THEN try_strptime(CASE WHEN us THEN v[4:5] || v[1:2] ELSE v[1:2] || v[4:5] END || v[7:10], '%d%m%Y')::DATE END AS date FROM v)
SELECT DISTINCT o.id, make_timestamp(o.us) AS occurred_at_utc, od.date::VARCHAR AS occurred_at_date, make_timestamp(c.us) AS created_at_utc, cd.date::VARCHAR AS created_at_date
FROM (SELECT id, us FROM e WHERE col = 'o') o JOIN (SELECT id, us FROM e WHERE col = 'c') c USING (id) JOIN (SELECT * FROM d WHERE col = 'o') od USING (id) JOIN (SELECT * FROM d WHERE col = 'c') cd USING (id)""",
    "p2_found": _FEED + "SELECT tip.rec AS record_id, d.k AS idempotency_key FROM tip JOIN done ON done.rec = tip.rec AND done.rev = tip.rev WHERE tip.ok",
    "p2_records": _FEED
    + r""", s AS (SELECT done.rec, done.rev, d.k AS key, h.*, d.o IN ('add', 'start') AS fresh, coalesce(h.o = 'update', false) AS upd FROM done JOIN h ON h.feed_seq = done.d.seq),
v AS (SELECT rec, arg_max(key, rev) AS idempotency_key, arg_max({'v': written_at AT TIME ZONE 'UTC'}, rev).v AS updated_at,
  arg_max({'v': tenant}, rev) FILTER (fresh).v AS tenant, arg_max({'v': owner}, rev) FILTER (fresh).v AS owner, arg_max({'v': card.source}, rev) FILTER (fresh).v AS source,
  arg_max({'v': CASE WHEN fresh THEN mount ELSE to_mount END}, rev) FILTER (fresh OR o = 'promote').v AS mount,
  arg_max({'v': CASE WHEN fresh THEN card.summary ELSE changes['summary'] END}, rev) FILTER (fresh OR upd AND map_contains(changes, 'summary')).v AS summary,
  arg_max({'v': CASE WHEN fresh THEN card.content ELSE changes['content'] END}, rev) FILTER (fresh OR upd AND map_contains(changes, 'content')).v AS content,
  arg_max({'v': CASE WHEN fresh THEN card.bucket ELSE changes['bucket'] END}, rev) FILTER (fresh OR upd AND map_contains(changes, 'bucket')).v AS bucket,
  arg_max({'v': CASE WHEN fresh THEN card.importance ELSE try_cast(changes['importance'] AS DOUBLE) END}, rev) FILTER (fresh OR upd AND map_contains(changes, 'importance')).v AS importance,
  arg_max({'v': NOT fresh}, rev) FILTER (fresh OR o IN ('archive', 'supersede')).v AS archived,
  arg_max({'v': CASE WHEN NOT fresh THEN reason END}, rev) FILTER (fresh OR o IN ('archive', 'supersede')).v AS archive_reason,
  arg_max({'v': CASE WHEN NOT fresh THEN card.id END}, rev) FILTER (fresh OR o = 'supersede').v AS superseded_by FROM s GROUP BY rec)
SELECT v.rec AS record_id, v.* EXCLUDE (rec), tip.rev AS revision FROM v JOIN tip ON tip.rec = v.rec WHERE tip.ok""",
    "p6_found": _LINKS
    + r"""walk AS (SELECT id, id AS cur, [id] AS path, false AS ring FROM (SELECT child AS id FROM par UNION SELECT parent FROM par)
  UNION ALL SELECT w.id, p.parent, CASE WHEN list_contains(w.path, p.parent) THEN list_slice(w.path, list_position(w.path, p.parent), len(w.path)) ELSE list_append(w.path, p.parent) END, list_contains(w.path, p.parent)
  FROM walk w JOIN par p ON p.child = w.cur WHERE NOT w.ring)
SELECT id, CASE WHEN ring THEN list_min(path) ELSE cur END AS root_id FROM walk w WHERE ring OR NOT EXISTS (SELECT 1 FROM par WHERE par.child = w.cur)""",
    "p6_paths": _LINKS
    + r"""walk AS (SELECT id, id AS cur, [id] AS path, NULL::VARCHAR[] AS ring FROM (SELECT child AS id FROM par UNION SELECT parent FROM par)
  UNION ALL SELECT w.id, p.parent, CASE WHEN list_contains(w.path, p.parent) THEN w.path ELSE list_append(w.path, p.parent) END, CASE WHEN list_contains(w.path, p.parent) THEN list_slice(w.path, list_position(w.path, p.parent), len(w.path)) END
  FROM walk w JOIN par p ON p.child = w.cur WHERE w.ring IS NULL),
full_ AS (SELECT id, path, ring FROM walk w WHERE ring IS NOT NULL OR NOT EXISTS (SELECT 1 FROM par WHERE par.child = w.cur)),
up AS (SELECT id, ring, CASE WHEN ring IS NULL THEN path ELSE list_slice(path, 1, greatest(1, len(path) - len(ring) + 1)) END AS path FROM full_),
below AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(list_slice(path, 2, len(path))) AS a FROM up) GROUP BY a)
SELECT up.id, par.parent AS parent_id, CASE WHEN ring IS NULL THEN path[-1] ELSE list_min(ring) END AS root_id, CAST(len(path) - 1 AS BIGINT) AS depth, array_to_string(list_reverse(path), '/') AS path,
  coalesce(below.n, 0) AS descendants, ring IS NOT NULL AND list_contains(ring, up.id) AS on_circle FROM up LEFT JOIN par ON par.child = up.id LEFT JOIN below ON below.id = up.id""",
}
SQL["p6_descendants"] = SQL["p6_paths"][: SQL["p6_paths"].index(",\nbelow AS")] + " SELECT unnest(list_slice(path, 2, len(path))) AS ancestor, id AS descendant, CAST(unnest(range(1, len(path))) AS BIGINT) AS distance FROM up"
