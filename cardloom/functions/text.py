"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without blanks at both ends, of any script."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def none_if_blank(x: Column) -> Column:
    return F.when(strip(x) != "", x)


def terms(x: Column) -> Column:
    """Words of letters and digits in lower case; each Chinese character by itself. An empty array for null."""
    spaced = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"([一-鿿])", " $1 ")
    return F.regexp_extract_all(spaced, F.lit(r"([\p{L}\p{N}]+)"), 1)


def match_text(search_text: Column | None, parts: list[Column], lists: list[Column]) -> Column:
    """The text that queries are matched against: search_text if given, else the distinct non-empty parts, one per line."""
    pieces = F.concat(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), *[F.coalesce(a, F.expr("cast(array() as array<string>)")) for a in lists])
    joined = F.array_join(F.array_distinct(F.filter(pieces, lambda p: p != "")), "\n")
    return joined if search_text is None else F.coalesce(none_if_blank(search_text), joined)


def substantive_len(x: Column) -> Column:
    """Letters and digits of any script."""
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(r"[\p{L}\p{N}]"))


def placeholder_reason(x: Column) -> Column:
    """Why a text is a placeholder and no content: empty, bracketed, a filler word, or without letters; null for content."""
    s = strip(F.coalesce(x, F.lit("")))
    return (
        F.when(s == "", "empty")
        .when(s.rlike(r"^[\[{(<【〔（《][^\[\]]{0,40}[\]})>】〕）》]$"), "bracket_placeholder")
        .when(F.lower(s).rlike(r"^(?:n/?a|none|null|nil|todo|tbd|placeholder|summary|content|unknown|无|暂无|空|摘要|内容)[.。!！…]*$"), "placeholder_word")
        .when(substantive_len(s) == 0, "no_substantive_chars")
    )


def least_depth(x: Column) -> Column:
    """Lowest point of the bracket balance, quotes ignored."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("low"))
    chars = F.split(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\[\]{}]", ""), "")

    def step(acc: Column, ch: Column) -> Column:
        d = acc["d"] + F.when(ch.isin("{", "["), 1).when(ch.isin("}", "]"), -1).otherwise(0)
        return F.struct(d.alias("d"), F.least(acc["low"], d).alias("low"))

    return F.aggregate(chars, start, step, lambda acc: acc["low"])


def torn_json(x: Column) -> Column:
    """Whether a text looks like the torn end of JSON: it closes what it did not open, and has a key or two closings in a row."""
    return (least_depth(x) < 0) & (F.contains(x, F.lit('":')) | x.rlike(r"[}\]]\s*[}\]]"))


def hard_field_reason(x: Column, strong: list[str] = [], weak: list[str] = []) -> Column:  # noqa: B006
    """Pollution of a summary or content: one strong pattern, or two weak signs (the torn end of JSON is one)."""
    signs = [torn_json(x).cast("int"), *(x.rlike(p).cast("int") for p in weak)]
    count = reduce(lambda a, b: a + b, signs)
    out = F.when(count >= 2, "multi_weak_leak")
    for p in reversed(strong):
        out = F.when(x.rlike(p), "strong_signal").otherwise(out)
    return F.when(strip(F.coalesce(x, F.lit(""))) != "", out)


def card_rejection(summary: Column, content: Column, strong: list[str] = [], weak: list[str] = [], least: int = 2) -> Column:  # noqa: B006
    """The first reason to reject a card's text; null if both fields hold real content."""
    name = lambda field, reason: F.when(reason.isNotNull(), F.concat(F.lit(f"{field}_"), reason))
    return F.coalesce(
        name("summary", placeholder_reason(summary)),
        name("content", placeholder_reason(content)),
        F.when(hard_field_reason(summary, strong, weak).isNotNull(), "summary_protocol_leak"),
        F.when(hard_field_reason(content, strong, weak).isNotNull(), "content_protocol_leak"),
        F.when(substantive_len(summary) < least, "summary_too_short"),
        F.when(substantive_len(content) < least, "content_too_short"),
    )


def bigrams(x: Column) -> Column:
    """Distinct pairs of neighbouring characters, in lower case."""
    low = F.lower(F.coalesce(x, F.lit("")))
    n = F.length(low)
    return F.when(n < 2, F.expr("cast(array() as array<string>)")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(2)))))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Shared of all bigrams of two texts; 0 if neither has any."""
    x, y = bigrams(a), bigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def dedupe_key(x: Column) -> Column:
    """Lower case, without anything but letters, digits and marks."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+", "")


def fingerprint(x: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(F.coalesce(x, F.lit("")), 256), 1, n)


def cues(values: Column) -> Column:
    """Retrieval cues: white space collapsed, of 1 to 120 characters, distinct, the first five."""
    clean = F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), lambda v: collapse(v))
    return F.slice(F.array_distinct(F.filter(clean, lambda v: v.isNotNull() & F.length(v).between(1, 120))), 1, 5)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x.try_cast("double"), F.lit(0.0))))


def importance(level: Column, legacy: Column) -> Column:
    """A level of 1 to 5 as a fifth of it; any other as the older value in 0 to 1."""
    return F.when(level.between(1, 5), level / 5.0).otherwise(clamp01(legacy))


def clip(x: Column, n: int) -> Column:
    return F.substring(collapse(x), 1, n)


def split_names(x: Column) -> Column:
    """A list of names on one line: between '、', ',', '/' or new lines."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), r"[、,/\n]+"), strip), lambda v: v != "")


def language_units(x: Column) -> tuple[Column, Column]:
    """(Chinese characters, Latin words)."""
    t = F.coalesce(x, F.lit(""))
    return F.regexp_count(t, F.lit(r"[一-鿿]")), F.regexp_count(t, F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)*"))
