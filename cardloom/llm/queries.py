"""Queries of the subpackage llm, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm import bpe, language, near_duplicates, packing, pii, reading_level
from cardloom.sources.tables import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of cards whose summary and content share at least 70 % of their words."""
    return near_duplicates.near_pairs(near_duplicates.card_texts(table(spark, sf, "cards", "id", "summary", "content")))


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each card's class of near-duplicates and its number of links."""
    return near_duplicates.classes(near_duplicates.card_texts(table(spark, sf, "cards", "id", "summary", "content")))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Cards and conversations with a missing or wrong label, and foreign lines, with the right language."""
    return language.wrong_labels(language.languages(*_labelled(spark, sf)))


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf, "cards", "id", "lang", "summary", "content"), table(spark, sf, "conversations", "cid", "locale", "window")


def p4_languages(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every card, window, foreign line and foreign sentence of a card, with confidence."""
    return language.languages(*_labelled(spark, sf), segments=True)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """(tab, rec_id, text) of cards and specifics; rows delivered twice once."""
    cards = table(spark, sf, "cards").select(F.lit("cards").alias("tab"), F.col("id").alias("rec_id"), F.col("content").alias("text"))
    return cards.unionAll(table(spark, sf, "specifics").select(F.lit("specifics"), "id", "window"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every span of personal data in cards.content and specifics.window."""
    return pii.personal_data(_texts(spark, sf), table(spark, sf, "given_names"))


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The texts with typed placeholders."""
    texts = _texts(spark, sf)
    return pii.scan(texts, pii.lexicon(texts, table(spark, sf, "given_names"))).select("tab", "rec_id", "redacted").distinct()


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and ids of every document by byte_bpe_50k."""
    return bpe.encode(table(spark, sf, "documents", "doc_id", "text"))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in a container of each budget."""
    return packing.pack(bpe.token_counts(table(spark, sf, "documents", "doc_id", "text")), table(spark, sf, "budgets"))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers of each budget are."""
    return packing.fill(p8_pack(spark, sf))


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Reading level of every document."""
    return reading_level.levels(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "reading_labels", "doc_id", "level"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents at the most demanding level."""
    return p9_levels(spark, sf).filter("level = 4").select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_classes, p4_found, p4_languages, p5_found, p5_redacted, p7_ids, p8_pack, p8_fill, p9_found, p9_levels)}
_SETS = r"""WITH RECURSIVE t AS (SELECT DISTINCT id, concat_ws(' ', summary, content) AS x FROM cards WHERE id IS NOT NULL),
w AS (SELECT DISTINCT id, unnest(regexp_extract_all(regexp_replace(lower(x), '([㐀-䶿一-鿿])', ' \1 ', 'g'), '([\p{L}\p{N}]+)', 1)) AS word FROM t),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
s AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS s FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY ALL)
"""
_NEAR = """SELECT id_a, id_b FROM s JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE s * 10 >= 7 * (a.n + b.n - s)"""
SQL: dict[str, str] = {
    "p3_found": _SETS + _NEAR,
    "p3_classes": _SETS
    + f""", near AS ({_NEAR}), sets AS (SELECT id, list_sort(list(word)) AS ws FROM w GROUP BY id),
rep AS (SELECT ws, min(id) AS rep, count(*) AS n_copies FROM sets GROUP BY ws), m AS (SELECT id, rep, n_copies FROM sets JOIN rep USING (ws)),
e AS (SELECT DISTINCT a.rep AS u, b.rep AS v FROM near JOIN m a ON a.id = id_a JOIN m b ON b.id = id_b WHERE a.rep <> b.rep), both_ AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT DISTINCT rep AS u, rep AS v FROM m UNION SELECT r.u, both_.v FROM r JOIN both_ ON both_.u = r.v)
SELECT m.id, (SELECT min(v) FROM r WHERE r.u = m.rep) AS class_id, (SELECT count(*) FROM both_ WHERE both_.u = m.rep) AS n_links, n_copies FROM m""",
}
