"""Prefix budgets, batches, windows of turns and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import constants as C
from cardloom.functions.text import collapse, strip


def index_line(id_: Column, bucket: Column, summary: Column, clip: int) -> Column:
    """One line of a card index: the id as it is, the bucket in brackets, the summary cut to `clip` characters with an ellipsis."""
    line = collapse(F.coalesce(summary, F.lit("")))
    cut = F.when(F.length(line) > clip, F.concat(F.substring(line, 1, max(0, clip - 1)), F.lit("…"))).otherwise(line)
    name = collapse(F.coalesce(bucket, F.lit("")))
    return F.concat(F.lit("- "), strip(id_), F.lit(": "), F.when(name != "", F.concat(F.lit("["), name, F.lit("] "))).otherwise(""), cut)


def within_budget(lines: DataFrame, budget: int, scope: str = "scope", place: str = "place") -> DataFrame:
    """lines: scope, place, line. The longest prefix of each scope whose lines, joined by line breaks, fit into `budget` characters."""
    by = Window.partitionBy(scope).orderBy(place)
    cost = F.length("line") + (F.row_number().over(by) > 1).cast("int")
    used = F.sum("cost").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lines.withColumn("cost", cost).withColumn("used", used).filter(F.col("used") <= budget).drop("cost")


def last_turns(turns: DataFrame, n: int = 4) -> DataFrame:
    """turns: conv, turn, text. (conv, text): the last `n` non-blank turns, one per line."""
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("turn")))
    kept = turns.filter(strip(F.coalesce("text", F.lit(""))) != "").withColumn("n", place).filter(F.col("n") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return kept.groupBy("conv").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("n_turns"))


def turns_of(windows: DataFrame) -> DataFrame:
    """windows: conv, text with one turn per line. (conv, turn from 1, speaker, text), clock times and speaker labels taken off."""
    lines = windows.select("conv", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    label = r"^\s*(?:\[?\d{1,2}:\d{2}\]?\s*)?([^:：]{1,24})[:：]\s*"
    speaker = F.regexp_extract("line", label, 1)
    return lines.select("conv", (F.col("at") + 1).cast("long").alias("turn"), speaker.alias("speaker"), F.regexp_replace("line", label, "").alias("text"))


def offsets(parts: DataFrame, scope: str = "scope", place: str = "place") -> DataFrame:
    """parts: scope, place, text. Adds `start`, the characters before each part, and a key of scope, start and content."""
    by = Window.partitionBy(scope).orderBy(place)
    before = F.coalesce(F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    df = parts.withColumn("start", before)
    key = F.concat(F.col(scope).cast("string"), F.lit(":b"), F.col("start").cast("string"), F.lit(":"), F.substring(F.sha2("text", 256), 1, 16))
    return df.withColumn("batch_key", key)


def first_wins(rows: DataFrame, key: str, order: list[str], scope: str | None = None, most: int = C.MOST_CANDIDATES) -> DataFrame:
    """The first row of each key in an order, at most `most` per scope. The first is found with partial aggregation, so a key may be hot."""
    others = [c for c in rows.columns if c not in (key, *order)]
    groups = [key] if scope is None else [scope, key]
    packed = F.min_by(F.struct(*[c for c in others if c not in groups], *order), F.struct(*order)).alias("row") if others or order else None
    kept = rows.groupBy(*groups).agg(packed, F.count("*").alias("seen")).select(*groups, "row.*", "seen")
    if scope is None:
        return kept
    place = F.row_number().over(Window.partitionBy(scope).orderBy(*order))
    return kept.withColumn("place", place.cast("long")).filter(F.col("place") <= most)


def chunk_text(text: str, size: int = C.BATCH_CHARS) -> list[str]:
    """Pieces of at most `size` characters, cut after the last line break in the second half of each, if there is one."""
    out, at = [], 0
    size = max(1, size)
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            cut = text.rfind("\n", at + size // 2, end)
            if cut > at:
                end = cut + 1
        out.append(text[at:end])
        at = end
    return out


def chunks(documents: DataFrame, size: int = C.BATCH_CHARS) -> DataFrame:
    """documents: doc_id, text. (doc_id, part from 0, start, chunk); no chunk for null or empty texts. No shuffle."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                at = 0
                for k, c in enumerate(chunk_text(t or "", size)):
                    rows.append((d, k, at, c))
                    at += len(c)
            yield pd.DataFrame(rows, columns=["doc_id", "part", "start", "chunk"])

    return documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, part bigint, start bigint, chunk string")
