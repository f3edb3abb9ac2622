"""Cards from files, and other records as cards."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.functions.text import none_if_blank

CARD = (
    "id string, tenant string, owner string, mount string, summary string, content string, bucket string, threads array<string>, "
    "retrieval_cues array<string>, importance double, pulse double, occurred_at string, created_at string, updated_at string, role string, "
    "is_sensitive boolean, source string, archived boolean, status string, superseded_by string, supersedes array<string>, anchor_memory_ids array<string>"
)


def cards_from_json(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Cards of a JSON-lines file, or with `whole` of one array or one {"cards": [...]} per file. Unknown fields are left out."""
    if not whole:
        return spark.read.schema(CARD).json(path)
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    array = F.from_json("value", f"array<struct<{CARD}>>")
    wrapped = F.from_json("value", f"struct<cards:array<struct<{CARD}>>>")["cards"]
    return text.select(F.inline(F.when(F.col("value").startswith("["), array).otherwise(wrapped)))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def open_cards(spark: SparkSession, source: str) -> DataFrame:
    """Cards from an address: parquet:, json: (lines), jsons: (whole files), memory: (a temporary view) or sqlite: (one table `cards`)."""
    url = urlparse(source)
    place = (url.netloc + url.path) if url.scheme != "memory" else (url.netloc or url.path.lstrip("/"))
    if url.scheme in ("parquet", "orc"):
        return spark.read.format(url.scheme).load(place)
    if url.scheme in ("json", "jsons"):
        return cards_from_json(spark, place, url.scheme == "jsons")
    if url.scheme == "memory":
        return spark.table(place)
    if url.scheme == "sqlite":
        return sqlite_cards(spark, place)
    raise ValueError(f"unknown kind of source: {source}")


def sqlite_cards(spark: SparkSession, path: str, parts: int = 1) -> DataFrame:
    """Cards of a store that keeps each as one JSON text (tenant, owner, id, doc). `parts` ranges of rowid are read by as many tasks."""
    bounds = spark.range(parts, numPartitions=parts)

    def read(frames):
        import sqlite3

        import pandas as pd

        for pdf in frames:
            for k in pdf["id"]:
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    rows = db.execute("SELECT tenant, owner, id, doc FROM cards WHERE rowid % ? = ?", (parts, int(k))).fetchall()
                yield pd.DataFrame(rows, columns=["tenant", "owner", "id", "doc"])

    raw = bounds.mapInPandas(read, "tenant string, owner string, id string, doc string")
    doc = F.from_json("doc", CARD)
    return raw.select(doc.alias("d"), "tenant", "owner", "id").select(F.col("d").withField("tenant", F.col("tenant")).withField("owner", F.col("owner")).withField("id", F.col("id")).alias("d")).select("d.*")


def first_filled(fields: list[str]) -> Column:
    """The first field that is not blank."""
    return F.coalesce(*[none_if_blank(F.col(f).cast("string")) for f in fields], F.lit(None).cast("string"))


def all_filled(fields: list[str]) -> Column:
    """All fields that are not blank, one after another."""
    return F.concat_ws(" ", *[none_if_blank(F.col(f).cast("string")) for f in fields])


def as_cards(records: DataFrame, id_field: str, summary: list[str], searchable: list[str], private: list[str] = [], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Records of a host as cards: summary, search_text, private_text (searched, never shown), and the columns in `keep`."""
    return records.select(F.col(id_field).cast("string").alias("id"), first_filled(summary).alias("summary"), all_filled(searchable).alias("search_text"), all_filled(private).alias("private_text"), *keep)
