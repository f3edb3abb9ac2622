"""Rows of replies that are checked as a table: candidates of an import, and cards brought to the present form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.functions.labels import clean_labels, default_bucket, format_error, soft_field_reason, summary_rejection
from cardloom.functions.replies import LABEL_CHARS, MOST_THREADS, SUMMARY_CHARS, salvage
from cardloom.functions.text import collapse, strip
from cardloom.functions.timeparse import canonical_time
from cardloom.operators.curation import migrated


def _listed(name: str, fields: tuple[str, ...], lists: tuple[str, ...] = ()):
    """An Arrow function from a reply to the objects of its list `name`, each field as text, and an error."""
    row = T.StructType([*(T.StructField(f, T.StringType()) for f in fields), *(T.StructField(f, T.ArrayType(T.StringType())) for f in lists)])

    def of(raw: str | None) -> tuple[list[dict], str | None]:
        doc, error = salvage(raw)
        if error:
            return [], error
        rows = doc.get(name)
        if not isinstance(rows, list):
            return [], f"missing_{name}_list"
        text = lambda v: v if isinstance(v, str) else None if v is None else str(v)
        many = lambda v: [text(x) for x in v if x is not None] if isinstance(v, list) else []
        return [{**{f: text(r.get(f)) for f in fields}, **{f: many(r.get(f)) for f in lists}} for r in rows if isinstance(r, dict)], None

    @F.pandas_udf(T.StructType([T.StructField("rows", T.ArrayType(row)), T.StructField("error", T.StringType())]))
    def parse(raw: pd.Series) -> pd.DataFrame:
        found = [of(r) for r in raw]
        return pd.DataFrame({"rows": [x for x, _ in found], "error": [e for _, e in found]})

    return parse


CANDIDATE_CHARS, EVIDENCE_CHARS = 300, 200
ABOUT = ("person", "relationship")


def candidates_of_replies(replies: DataFrame, strict: bool = True) -> DataFrame:
    """replies: key, raw. The candidates of an import's replies (key, place, about, summary, evidence, occurred_at), and one row with an
    error for a reply without any that may be used: unreadable, or with refused summaries (`strict`: any, else if none is left)."""
    parsed = replies.select("key", _listed("candidates", ("summary", "evidence", "about", "occurred_at"))("raw").alias("p"))
    rows = parsed.select("key", F.col("p.error").alias("error"), F.posexplode_outer("p.rows").alias("place", "c")).select("key", "error", "place", "c.*")
    line = lambda c, n: F.substring(collapse(F.coalesce(F.col(c), F.lit(""))), 1, n)
    rows = rows.withColumns({"summary": line("summary", CANDIDATE_CHARS), "evidence": F.nullif(line("evidence", EVIDENCE_CHARS), F.lit("")), "occurred_at": F.nullif(canonical_time(F.col("occurred_at")), F.lit(""))})
    about = F.lower(collapse(F.coalesce("about", F.lit(""))))
    rows = rows.withColumns({"about": F.when(about.isin(*ABOUT), about).otherwise("person"), "why": F.when(F.col("place").isNotNull(), summary_rejection(F.col("summary")))})
    whys = F.transform(F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.struct("place", "why")))), lambda x: x["why"])
    each = rows.groupBy("key").agg(F.max("error").alias("unread"), whys.alias("whys"), F.count_if(F.col("place").isNotNull() & F.col("why").isNull()).alias("good"))
    bad = F.size("whys") > 0
    refused = F.when(bad, format_error(F.col("whys"))) if strict else F.when(bad & (F.col("good") == 0), format_error(F.col("whys"), after_retry=True))
    each = each.select("key", F.coalesce("unread", refused).alias("failed"))
    kept = rows.join(each, "key").filter("failed is null and place is not null and why is null")
    fields = ["about", "summary", "evidence", "occurred_at"]
    errors = each.filter("failed is not null").select("key", F.col("failed").alias("error"), F.lit(None).cast("int").alias("place"), *[F.lit(None).cast("string").alias(f) for f in fields])
    return kept.select("key", F.lit(None).cast("string").alias("error"), "place", *fields).unionByName(errors)


def upgrades_of_replies(replies: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """replies: key, raw; allowed: key, id. (upgrades, unmigrated): the first usable upgrade of each allowed card, its labels clean, and
    the allowed cards for which none came back: these are still to be done, whatever else the reply held."""
    parsed = replies.select("key", _listed("upgrades", ("id", "bucket", "summary", "content"), ("threads",))("raw").alias("p"))
    rows = parsed.select("key", F.posexplode("p.rows").alias("place", "u")).select("key", "place", "u.*")
    rows = rows.withColumns({"id": strip("id"), "summary": F.substring(strip(F.coalesce("summary", F.lit(""))), 1, SUMMARY_CHARS), "content": strip(F.coalesce("content", F.lit("")))})
    dirty = lambda c: F.coalesce(soft_field_reason(F.col(c)).isNotNull(), F.lit(False))
    rows = rows.filter(((F.col("summary") != "") | (F.col("content") != "")) & ~dirty("summary") & ~dirty("content"))
    text = F.concat_ws("\n", "summary", "content")
    threads = F.slice(F.transform("threads", lambda t: F.substring(strip(t), 1, LABEL_CHARS)), 1, MOST_THREADS)
    rows = rows.withColumn("l", clean_labels(F.substring(strip(F.coalesce("bucket", F.lit(""))), 1, LABEL_CHARS), threads, text))
    leak = F.array_contains("l.reasons", "bucket_protocol_leak")
    rows = rows.select("key", "place", "id", F.when(leak, default_bucket(text)).otherwise(F.col("l.bucket")).alias("bucket"), F.col("l.threads").alias("threads"), "summary", "content")
    first, left = migrated(rows, allowed, "key")
    return rows.join(first, ["key", "id", "place"]).drop("place"), left
