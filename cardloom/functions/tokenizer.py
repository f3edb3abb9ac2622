"""The default tokenizer of retrieval: NFC, case folding, identifiers whole, accented words whole, Chinese characters and pairs.

Texts whose letters are ASCII, accented Latin or CJK in composed form, as nearly all are, are cut by JVM patterns; only others (combining
marks, other scripts, letters whose folding is not their lower case) pass through Python, in Arrow batches.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scripts written without blanks, Latin letters beyond ASCII, and particles that form no pair with a neighbour.
CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"
LATIN = "À-ÖØ-öø-ɏḀ-ỿⱠ-Ɀ꜠-ꟿꬰ-꭯"
PARTICLES = "的了着吗呢吧啊呀嘛么"
#: Letters that the JVM patterns may meet: composed, and folded by lower case alone.
_PLAIN = "a-zA-ZÀ-ÖØ-Þà-öø-įĲ-ňŊ-žƀ-ƺḀ-ẕẠ-ỿ0-9㐀-䶿一-鿿"


@lru_cache(maxsize=1)
def _marks() -> str:
    """All combining marks, as ranges of a character class."""
    points = [k for k in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(k))[0] == "M"]
    starts = [k for k in points if unicodedata.category(chr(k - 1))[0] != "M"]
    ends = [k for k in points if unicodedata.category(chr(min(k + 1, sys.maxunicode)))[0] != "M"]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends))


@lru_cache(maxsize=1)
def _pattern() -> re.Pattern:
    """One alternative for each kind of token: a CJK run; ASCII words joined by single signs, each of them whole; a word of Latin letters;
    a word of another script. A mark belongs to the letter before it."""
    m = _marks()
    ascii_word = rf"[a-z0-9]++(?![{LATIN}{m}])"
    latin = rf"(?:[a-z0-9{LATIN}][{m}]*)+"
    other = rf"(?:[^\W_a-z0-9{LATIN}{CJK}{m}][{m}]*)+"
    return re.compile(rf"([{CJK}]+)|{ascii_word}(?:[-_./]{ascii_word})*|{latin}|{other}")


def tokenize(text: str | None) -> list[str]:
    """Tokens of a text; none for null or blank text. Chinese characters come singly and in pairs without particles."""
    if not text:
        return []
    out: list[str] = []
    for m in _pattern().finditer((text if text.isascii() else unicodedata.normalize("NFC", text)).casefold()):
        han = m.group(1)
        out += [m.group()] if han is None else [*han, *(a + b for a, b in zip(han, han[1:]) if a not in PARTICLES and b not in PARTICLES)]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens(text: pd.Series) -> pd.Series:
    """`tokenize` as an Arrow function of columns."""
    return text.map(tokenize)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _tokens_if_any(text: pd.Series) -> pd.Series:
    """The same, but null for null."""
    return text.map(tokenize, na_action="ignore")


def terms(text: Column) -> Column:
    """The tokens of a column, in no particular order, each as often as it occurs; an empty array for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    word = "[a-z0-9]++(?![à-öø-ɏḀ-ỿ])"
    words = F.regexp_extract_all(low, F.lit(rf"({word}(?:[-_./]{word})*|[a-z0-9à-öø-ɏḀ-ỿ]+)"), 1)
    single = F.regexp_extract_all(low, F.lit("([㐀-䶿一-鿿])"), 1)
    pairs = F.regexp_extract_all(low, F.lit(rf"(?=([㐀-䶿一-鿿&&[^{PARTICLES}]]{{2}}))"), 1)
    odd = text.rlike(rf"[\p{{L}}\p{{N}}\p{{M}}&&[^{_PLAIN}]]")
    return F.coalesce(_tokens_if_any(F.when(odd, text)), F.concat(words, single, pairs))
