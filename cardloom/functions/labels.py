"""Labels of cards and speakers: buckets by language, names, soft fields, residual tokens, and the language of a garden."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions.text import collapse, hard_field_reason, placeholder_reason, split_names, strip, substantive_len, torn_json

#: Buckets that both languages have, and short forms of the Chinese ones.
COMMON_BUCKETS = (
    ("工作", "Work"), ("目标与成长", "Goals & growth"), ("家庭", "Family"), ("朋友", "Friends"), ("宠物", "Pets"), ("我们的关系", "Our relationship"), ("情绪与安抚", "Feelings & comfort"),
    ("偏好与边界", "Preferences & boundaries"), ("个性与价值观", "Personality & values"), ("健康", "Health"), ("爱好", "Interests"), ("金钱", "Money"), ("饮食", "Food"), ("地点与旅行", "Places & travel"),
)
BUCKET_ALIASES = {
    "preferences": "偏好与边界", "boundaries": "偏好与边界", "goals": "目标与成长", "growth": "目标与成长", "relationship": "我们的关系", "feelings": "情绪与安抚",
    "emotions": "情绪与安抚", "comfort": "情绪与安抚", "personality": "个性与价值观", "values": "个性与价值观", "places": "地点与旅行", "travel": "地点与旅行",
}
#: Names that mean no name, the signs around one, and labels of speakers.
NO_NAMES, AROUND = ("ta", "user", "用户"), " `\"'“”‘’「」『』。，,.;；:：!！?？"
UNKNOWN_PERSON, CALL_RECORD, SELF = "对方", "通话记录", "我"
DEFAULT_LOCALE = "zh-Hans"
_HAN = "[一-鿿]"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for p in pairs.items() for x in p))


def is_chinese(text: Column) -> Column:
    return F.coalesce(text.rlike(_HAN), F.lit(False))


def bucket_in_language(bucket: Column, text: Column) -> Column:
    """A common bucket in the language of the card's text; any other bucket as it is, blanks at its ends aside."""
    to_zh = {en: zh for zh, en in COMMON_BUCKETS}
    to_en = {zh: en for zh, en in COMMON_BUCKETS}
    short_zh = {**{en.casefold(): zh for zh, en in COMMON_BUCKETS}, **BUCKET_ALIASES}
    short_en = {k: to_en[v] for k, v in short_zh.items()}
    b = strip(F.coalesce(bucket, F.lit("")))
    named = lambda exact, short: F.coalesce(F.try_element_at(_map(exact), b), F.try_element_at(_map(short), F.lower(b)), b)
    return F.when(is_chinese(text), named(to_zh, short_zh)).otherwise(named(to_en, short_en))


def default_bucket(text: Column) -> Column:
    """The bucket of a card without one, in the language of its text; Chinese for a blank text."""
    return F.when((strip(F.coalesce(text, F.lit(""))) != "") & ~is_chinese(text), "Uncategorized").otherwise("未分类")


def bucket_languages(names: Column) -> tuple[Column, Column]:
    """(names with Chinese characters, names with Latin letters alone) of a line of names. An observation, no ground for a decision."""
    parts = split_names(names)
    return F.size(F.filter(parts, lambda n: n.rlike(_HAN))), F.size(F.filter(parts, lambda n: ~n.rlike(_HAN) & n.rlike("[A-Za-z]")))


def clean_name(name: Column) -> Column:
    """A name that someone may be called by; 'TA' where it is none."""
    edge = "[" + "".join("\\" + c if c in "\"'.?" else c for c in AROUND) + "]+"
    n = F.regexp_replace(collapse(F.coalesce(name, F.lit(""))), f"^{edge}|{edge}$", "")
    return F.when((n == "") | F.lower(n).isin(*NO_NAMES), "TA").otherwise(n)


def speaker_label(role: Column, user: Column, assistant: Column) -> Column:
    """What a line of a transcript is headed by: never the role itself."""
    r, name, other = F.lower(strip(F.coalesce(role, F.lit("")))), clean_name(user), collapse(F.coalesce(assistant, F.lit("")))
    return F.when(r == "voice_call_record", CALL_RECORD).when((r == "user") & (name == "TA"), UNKNOWN_PERSON).when(r == "user", name).when(other == "", SELF).otherwise(other)


def user_tokens(fields: list[Column], threads: Column) -> Column:
    """How often visible fields still say 'user'."""
    pattern = F.lit(r"用户|(?i:\buser\b)")
    said = reduce(lambda a, b: a + b, [F.regexp_count(F.coalesce(f, F.lit("")), pattern) for f in fields])
    each = F.transform(F.coalesce(threads, F.expr("cast(array() as array<string>)")), lambda t: F.regexp_count(F.coalesce(t, F.lit("")), pattern))
    return said + F.aggregate(each, F.lit(0), lambda a, n: a + n)


def soft_field_reason(x: Column, strong: list[str] = [], weak: list[str] = []) -> Column:  # noqa: B006
    """Pollution of a label: any strong or weak sign (labels are cheap to lose)."""
    out = F.when(torn_json(x), "torn_json_tail")
    for k, p in reversed(list(enumerate(weak))):
        out = F.when(x.rlike(p), f"weak_{k}").otherwise(out)
    for p in reversed(strong):
        out = F.when(x.rlike(p), "strong_signal").otherwise(out)
    return F.when(strip(F.coalesce(x, F.lit(""))) != "", out)


def bucket_reason(x: Column, denied: tuple[str, ...] = (), strong: list[str] = [], weak: list[str] = []) -> Column:  # noqa: B006
    """Pollution of a bucket: one of the denied names, or as of any label."""
    name = strip(F.coalesce(x, F.lit("")))
    soft = soft_field_reason(name, strong, weak)
    return F.when(name.isin(*denied), "known_taxonomy_residue").otherwise(soft) if denied else soft


def clean_labels(bucket: Column, threads: Column, text: Column, denied: tuple[str, ...] = ()) -> Column:
    """struct(bucket, threads, reasons): polluted labels emptied or left out, the bucket in the text's language, and why, in order."""
    b = strip(F.coalesce(bucket, F.lit("")))
    empty, leak = placeholder_reason(b), bucket_reason(b, denied)
    bad = F.when(b == "", None).when(empty.isNotNull(), F.concat(F.lit("bucket_"), empty)).when(leak.isNotNull(), "bucket_protocol_leak")
    named = F.when(bad.isNull() & (b != ""), F.when(strip(F.coalesce(text, F.lit(""))) != "", bucket_in_language(b, text)).otherwise(b)).otherwise("")
    trimmed = F.filter(F.transform(F.coalesce(threads, F.expr("cast(array() as array<string>)")), lambda t: strip(F.coalesce(t, F.lit("")))), lambda t: t != "")
    why = lambda t: F.when(placeholder_reason(t).isNotNull(), F.concat(F.lit("threads_"), placeholder_reason(t))).when(soft_field_reason(t).isNotNull(), "threads_protocol_leak")
    reasons = F.concat(F.array_compact(F.array(bad)), F.array_compact(F.transform(trimmed, why)))
    return F.struct(named.alias("bucket"), F.filter(trimmed, lambda t: why(t).isNull()).alias("threads"), reasons.alias("reasons"))


def converged_bucket(bucket: Column, known: Column, locale: Column) -> Column:
    """A bucket in the spelling that is known already: letter case and blanks aside the first such of `known` (an array); of a listing of
    common buckets the first, of a pair in both languages the one of `locale`. Nothing else is guessed."""
    common = [x for p in COMMON_BUCKETS for x in p]
    name = strip(F.coalesce(bucket, F.lit("")))
    parts = F.filter(F.transform(F.split(name, "[、，,]"), strip), lambda p: p != "")
    name = F.when((F.size(parts) > 1) & F.forall(parts, lambda p: p.isin(*common)), F.get(parts, F.lit(0))).otherwise(name)
    halves = F.filter(F.transform(F.split(name, "/"), strip), lambda p: p != "")
    pairs = {f"{a}/{b}": i for i, (zh, en) in enumerate(COMMON_BUCKETS) for a, b in ((zh, en), (en, zh))}
    at = F.when(F.size(halves) == 2, F.try_element_at(F.create_map(*(F.lit(x) for p in pairs.items() for x in p)), F.array_join(halves, "/")))
    side = lambda k: F.element_at(F.array(*(F.lit(p[k]) for p in COMMON_BUCKETS)), at + 1)
    name = F.when(at.isNotNull(), F.when(strip(F.coalesce(locale, F.lit(""))) == "en", side(1)).otherwise(side(0))).otherwise(name)
    fold = lambda x: F.lower(collapse(F.coalesce(x, F.lit(""))))
    same = F.filter(F.coalesce(known, F.expr("cast(array() as array<string>)")), lambda k: (fold(k) != "") & (fold(k) == fold(name)))
    return F.when(name == "", name).otherwise(F.coalesce(strip(F.get(same, F.lit(0))), name))


def garden_language(explicit: Column, established: Column, cjk: Column, latin: Column, locale: Column, least_units: int, least_share: float, default: str = DEFAULT_LOCALE) -> Column:
    """struct(locale, basis, evidence_units, confidence): the first of what the owner chose, what the garden has, what is written in it
    (Chinese characters against Latin words), the client's locale and the default. What a garden's own cards say never counts."""
    units = cjk + latin
    share = F.when(units > 0, F.greatest(cjk, latin) / units)
    written = F.when((units >= least_units) & (share >= least_share), F.when(cjk > latin, default).otherwise("zh-Hans" if default == "en" else "en"))
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    of = lambda value, basis, n, sure: F.struct(value.alias("locale"), F.lit(basis).alias("basis"), n.cast("long").alias("evidence_units"), sure.cast("double").alias("confidence"))
    none, one = F.lit(0), F.lit(1.0)
    return (
        F.when(some(explicit), of(explicit, "explicit_preference", none, one))
        .when(some(established), of(established, "established_language", none, one))
        .when(written.isNotNull(), of(written, "writing_language", units, F.round(share, 3)))
        .when(some(locale), of(locale, "client_locale", units, F.lit(0.0)))
        .otherwise(of(F.lit(default), "default", units, F.lit(0.0)))
    )


def summary_rejection(summary: Column, least: int = 2) -> Column:
    """Why the summary of an import candidate is refused; null for a good one."""
    placeholder = placeholder_reason(summary)
    return (
        F.when(placeholder.isNotNull(), F.concat(F.lit("summary_"), placeholder))
        .when(hard_field_reason(summary).isNotNull(), "summary_protocol_leak")
        .when(substantive_len(summary) < least, "summary_too_short")
    )


def format_error(reasons: Column, after_retry: bool = False) -> Column:
    """The first three distinct reasons (an array) behind one code."""
    prefix = "invalid_card_content_after_retry" if after_retry else "invalid_card_content"
    seen = F.slice(F.array_distinct(F.filter(reasons, lambda r: r.isNotNull() & (r != ""))), 1, 3)
    return F.when(F.size(seen) > 0, F.concat(F.lit(f"{prefix}:"), F.array_join(seen, ","))).otherwise(prefix)


def retryable(error: Column, raw: Column) -> Column:
    """Whether a reply that could not be read deserves one more call: bad content, bad JSON, or nothing but blanks."""
    code = F.element_at(F.split(F.coalesce(error, F.lit("")), ":"), 1)
    return code.isin("invalid_card_content", "json_decode_error") | ((code == "no_json_object") & F.coalesce(strip(raw) == "", F.lit(False)))


