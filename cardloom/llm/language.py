"""The language of texts and of lines, with a confidence.

One unigram model per language over the pieces of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces, by a forward algorithm; words do not share pieces, so a text's likelihood is the product over its words
and each distinct word is scored once per worker. The piece probabilities are fitted by expectation maximisation over those same
segmentations, on a bounded sample of rows whose label names a language; rows that the first fit contradicts are left out of the second.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ("de", "en", "es", "fr", "zh")
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bound of the training sample: rows per language.
TRAIN_ROWS = 300
#: Log-likelihoods are divided by this before they become probabilities: words of a text are not independent.
TEMPER = 3.0
#: A line is foreign if it is so much likelier (in log units) in another language than in that of most lines.
MARGIN = 3.0
_SMOOTH = 4.0
#: Words up to this length need no scaling: no sum over their segmentations leaves the range of numbers.
_SHORT = 24
REMEMBERED = 500_000

#: Names of the languages in labels, besides codes with a region or script.
_NAMES = {
    "en": ("en", "eng", "english", "anglais", "englisch", "inglés", "英语", "英文"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "chinesisch", "chinois", "chino", "中文", "汉语"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "德语"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "法语"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "spanisch", "espagnol", "西班牙语"),
}


def label_language(label: Column) -> Column:
    """The language that a label names, by its first part (before '-' or '_', letter case and blanks aside); null for any other."""
    head = F.lower(F.trim(F.regexp_extract(F.trim(label), r"^([^\-_\s(]+)", 1)))
    names = F.create_map(*(F.lit(x) for code, words in _NAMES.items() for w in words for x in (w, code)))
    return F.try_element_at(names, head)


_UNITS = re.compile(r"[一-鿿㐀-䶿]|[^\W\d_一-鿿㐀-䶿]+")


def units(text: str) -> list[str]:
    """Words in lower case, each Chinese character by itself; digits, signs and marks do not count."""
    return _UNITS.findall(text.lower())


def _marked(unit: str) -> str:
    return unit if "㐀" <= unit[0] <= "鿿" else "▁" + unit


def _unknown(char: str) -> str:
    return "<han>" if "㐀" <= char <= "鿿" else "<latin>" if char.isalpha() and ord(char) < 0x250 else "<other>"


def load_pieces(path: str = VOCABULARY) -> frozenset[str]:
    """The vocabulary's pieces of letters, in lower case; one mark of a word's beginning at most."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = set()
    for k in range(sp.get_piece_size()):
        p = sp.id_to_piece(k).lower()
        if not sp.is_byte(k) and not sp.is_control(k) and not sp.is_unknown(k) and (p.lstrip("▁").isalpha() or p == "▁") and p.count("▁") <= 1:
            out.add(p)
    return frozenset(out)


def _lattice(unit: str, pieces: frozenset[str], longest: int) -> list[tuple[int, int, str]]:
    """Edges (from, to, piece) of all segmentations; a character that is no piece has an edge of its kind."""
    s = _marked(unit)
    edges = []
    for i in range(len(s)):
        single = s[i] in pieces
        edges += [(i, j, s[i:j]) for j in range(i + 1, min(len(s), i + longest) + 1) if s[i:j] in pieces]
        if not single:
            edges.append((i, i + 1, _unknown(s[i])))
    return edges


class Model:
    """log probabilities of pieces by language: a dict piece -> array of len(LANGUAGES); `floor` for pieces never seen."""

    def __init__(self, pieces: frozenset[str], table: dict[str, np.ndarray], floor: np.ndarray):
        self.pieces, self.table, self.floor = pieces, table, floor
        self.longest = max(map(len, pieces), default=1)
        self.index: dict[str, int] = {}
        self.rows = np.empty((1024, len(LANGUAGES)))

    def __getstate__(self):
        return {"table": self.table, "floor": self.floor, "pieces": self.pieces}

    def __setstate__(self, state):
        self.__init__(state["pieces"], state["table"], state["floor"])

    def score(self, unit: str) -> np.ndarray:
        """log of the summed probability of all segmentations of a unit of any length, by language."""
        size = len(_marked(unit))
        alpha = np.zeros((size + 1, len(LANGUAGES)))
        alpha[0] = 1.0
        scale = np.zeros(len(LANGUAGES))
        done = 0
        for i, j, piece in _lattice(unit, self.pieces, self.longest):
            if i > done and i % 24 == 0:  # long words: keep the numbers in range; no edge so far leads further than the longest piece
                reached = alpha[i : i + self.longest]
                top = reached.max(axis=0)
                top = np.where(top > 0, top, 1.0)
                reached /= top
                scale += np.log(top)
                done = i
            alpha[j] += alpha[i] * self.table.get(piece, self.floor)
        return np.log(np.maximum(alpha[size], 1e-300)) + scale

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood by text and language, number of units by text)."""
        index, flat, sizes = self.index, [], np.zeros(len(texts), dtype=np.int64)
        if len(index) > REMEMBERED:
            index.clear()
        for k, t in enumerate(texts):
            if not t:
                continue
            found = units(t)
            sizes[k] = len(found)
            for u in found:
                at = index.get(u)
                if at is None:
                    at = index[u] = len(index)
                    if at >= len(self.rows):
                        self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                    self.rows[at] = self.score(u)
                flat.append(at)
        sums = np.zeros((len(texts) + 1, len(LANGUAGES)))
        if flat:
            ends = np.cumsum(sizes)
            total = np.vstack([np.zeros(len(LANGUAGES)), np.cumsum(self.rows[np.array(flat)], axis=0)])
            sums[:-1] = total[ends] - total[ends - sizes]
        return sums[:-1], sizes


def posterior(scores: np.ndarray) -> np.ndarray:
    x = scores / TEMPER
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _expected(edges: list[tuple[int, int, str]], weight: list[float]) -> list[float]:
    """The expected number of times each edge is used, over all segmentations; in long words the sums are scaled to stay in range."""
    size = edges[-1][1]
    if size <= _SHORT:
        a, b = [0.0] * (size + 1), [0.0] * (size + 1)
        a[0] = b[size] = 1.0
        for (i, j, _), w in zip(edges, weight):
            a[j] += a[i] * w
        for k in range(len(edges) - 1, -1, -1):
            i, j, _ = edges[k]
            b[i] += weight[k] * b[j]
        return [a[i] * w * b[j] / a[size] for (i, j, _), w in zip(edges, weight)]
    a, level = [0.0] * (size + 1), [0.0] * (size + 1)  # a[i] * exp(level[i]) is the sum up to i
    a[0] = 1.0
    for (i, j, _), w in zip(edges, weight):
        if a[i] and (a[i] < 1e-150 or a[i] > 1e150):
            level[i], a[i] = level[i] + math.log(a[i]), 1.0
        a[j], level[j] = (a[i] * w, level[i]) if not a[j] else (a[j] + a[i] * w * math.exp(min(700.0, level[i] - level[j])), level[j])
    b, back = [0.0] * (size + 1), [0.0] * (size + 1)
    b[size] = 1.0
    used = [0.0] * len(edges)
    whole = math.log(a[size]) + level[size] if a[size] > 0 else None
    for k in range(len(edges) - 1, -1, -1):
        i, j, _ = edges[k]
        if b[j] and (b[j] < 1e-150 or b[j] > 1e150):
            back[j], b[j] = back[j] + math.log(b[j]), 1.0
        if whole is not None and a[i] and b[j]:
            used[k] = a[i] * weight[k] * b[j] * math.exp(level[i] + back[j] - whole) if abs(level[i] + back[j] - whole) < 300 else math.exp(math.log(a[i]) + math.log(weight[k]) + math.log(b[j]) + level[i] + back[j] - whole)
        b[i], back[i] = (weight[k] * b[j], back[j]) if not b[i] else (b[i] + weight[k] * b[j] * math.exp(min(700.0, back[j] - back[i])), back[i])
    return used


def _fit(counts: dict[str, Counter], pieces: frozenset[str], rounds: int = 3) -> Model:
    """Expectation maximisation over all segmentations; every language is smoothed towards the pool of all."""
    longest = max(map(len, pieces), default=1)
    lattices = {u: _lattice(u, pieces, longest) for c in counts.values() for u in c}
    probs: dict[str, dict[str, float]] = {lang: {} for lang in LANGUAGES}
    start = lambda piece: 0.5 ** (8 + 4 / len(piece))
    for _ in range(rounds):
        expected = {lang: defaultdict(float) for lang in LANGUAGES}
        for lang in LANGUAGES:
            p, e = probs[lang], expected[lang]
            for unit, n in counts[lang].items():
                edges = lattices[unit]
                for (_, _, x), v in zip(edges, _expected(edges, [p.get(x, 1e-7) if p else start(x) for _, _, x in edges])):
                    e[x] += v * n
        pool: dict[str, float] = defaultdict(float)
        for e in expected.values():
            size = sum(e.values()) or 1.0
            for x, v in e.items():
                pool[x] += v / size / len(LANGUAGES)
        base = 1e-7
        for lang, e in expected.items():
            size = sum(e.values())
            probs[lang] = {x: (e.get(x, 0.0) + _SMOOTH * (0.5 * pool[x] + base)) / (size + _SMOOTH) for x in pool}
    table = {x: np.array([probs[lang][x] for lang in LANGUAGES]) for x in probs[LANGUAGES[0]]}
    sizes = np.array([max(1.0, sum(v.values())) if (v := counts[lang]) else 1.0 for lang in LANGUAGES])
    return Model(pieces, table, 0.02 / (sizes + 2000.0))


def train(rows: list[tuple[str, str]], pieces: frozenset[str]) -> Model:
    """Fit on (language, text); then again without the rows that the first fit contradicts."""

    def counts(rows: list[tuple[str, str]]) -> dict[str, Counter]:
        out = {lang: Counter() for lang in LANGUAGES}
        for lang, text in rows:
            out[lang].update(units(text))
        return out

    rows = sorted(rows)
    model = _fit(counts(rows), pieces, rounds=2)
    scores, _ = model.scores([t for _, t in rows])
    kept = [r for r, k in zip(rows, scores.argmax(axis=1)) if LANGUAGES[k] == r[0]]
    return _fit(counts(kept), pieces)


def model_of(labelled: DataFrame, vocabulary: str = VOCABULARY) -> Model:
    """The model fitted on at most TRAIN_ROWS rows per language of `labelled` (label, text): those of the least hashes among the distinct
    (language, text), so the same for the same table and for any number of copies of it.

    The labels alone are counted first; that tells how small a hash must be for enough rows to remain, and texts are read for these.
    """
    named = labelled.select(label_language(F.col("label")).alias("lang"), "text").filter("lang is not null and text <> ''")
    many = {r.lang: r.n for r in labelled.select(label_language(F.col("label")).alias("lang")).filter("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = {lang: min(1.0, 4 * TRAIN_ROWS / n) for lang, n in many.items()}
    rows: dict[str, list[tuple[int, str]]] = {}
    while share:
        below = reduce(lambda a, b: a | b, ((F.col("lang") == lang) & (F.col("h") <= int(-(2**63) + v * (2**64 - 1)) if v < 1 else F.col("lang") == lang) for lang, v in share.items()))
        few = named.withColumn("h", F.xxhash64("text")).filter(below).distinct()
        place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
        for r in few.withColumn("n", place).filter(F.col("n") <= TRAIN_ROWS).collect():
            rows.setdefault(r.lang, []).append((r.h, r.text))
        share = {lang: min(1.0, 8 * v) for lang, v in share.items() if v < 1 and len(rows.get(lang, ())) < TRAIN_ROWS}
        for lang in share:
            rows.pop(lang, None)
    return train([(lang, text) for lang, found in rows.items() for _, text in found], load_pieces(vocabulary))


def of_texts(texts: DataFrame, model: Model) -> DataFrame:
    """texts: rec_id, text, label. Adds lang and confidence; both null for a text without letters (null and blank ones too)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, sizes = model.scores(batch.column(1).to_pylist())
            p = posterior(scores)
            best = p.argmax(axis=1)
            lang = [LANGUAGES[k] if n else None for k, n in zip(best, sizes)]
            sure = pa.array(p[np.arange(len(best)), best], mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), sure], names=["rec_id", "label", "lang", "confidence"])

    return texts.select("rec_id", "text", "label").mapInArrow(run, "rec_id string, label string, lang string, confidence double")


_SPEAKER = re.compile(r"^\s*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?\s*)?[^:：\n]{1,24}[:：]\s*")


def turns(text: str) -> list[str]:
    """The lines of a window, without speaker labels and clock times."""
    return [_SPEAKER.sub("", line, count=1) for line in text.split("\n")]


_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n")


def sentences(text: str) -> list[str]:
    """The sentences of a text."""
    return _SENTENCE.split(text)


def of_windows(windows: DataFrame, model: Model, cut: Callable[[str], list[str]] = turns) -> DataFrame:
    """windows: rec_id, text, label; `cut` makes segments of a text, by default its lines. One row per text (line_no 0: the language of
    most segments, that of the more text where two have as many) and one per segment in another language (line_no from 1), with confidence.

    A segment without letters has no language and no vote; a text without any has null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, texts)])
            scores, sizes = model.scores([x for t in texts for x in t])
            p = posterior(scores) if len(scores) else scores
            row, number, lang, sure = [], [], [], []
            for k in range(len(texts)):
                here = ends[k] + np.flatnonzero(sizes[ends[k] : ends[k + 1]])
                if not len(here):
                    row.append(k), number.append(0), lang.append(None), sure.append(None)
                    continue
                best = scores[here].argmax(axis=1)
                votes = np.bincount(best, minlength=len(LANGUAGES)) + np.bincount(best, sizes[here], len(LANGUAGES)) / (1 + sizes[here].sum())
                main = int(votes.argmax())
                row.append(k), number.append(0), lang.append(LANGUAGES[main]), sure.append(float(p[here, main].mean()))
                for x, b in zip(here[(best != main)], best[best != main]):
                    if scores[x, b] - scores[x, main] > MARGIN:
                        row.append(k), number.append(int(x - ends[k] + 1)), lang.append(LANGUAGES[b]), sure.append(float(p[x, b]))
            at = pa.array(row, pa.int64())
            arrays = [batch.column(0).take(at), batch.column(2).take(at), pa.array(number, pa.int64()), pa.array(lang, pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["rec_id", "label", "line_no", "lang", "confidence"])

    return windows.select("rec_id", "text", "label").mapInArrow(run, "rec_id string, label string, line_no bigint, lang string, confidence double")


def languages(cards: DataFrame, conversations: DataFrame, vocabulary: str = VOCABULARY, segments: bool = False) -> DataFrame:
    """(tab, rec_id, line_no, lang, confidence, label): the language of every card and window, and of every foreign line; with `segments`
    of every foreign sentence of a card too.

    A card's language is that of its content, or of its summary where the content has no letters. Rows delivered twice count once.
    """
    letters = F.regexp_count(F.col("content"), F.lit(r"\p{L}")) > 0
    rows = cards.select(F.col("id").alias("rec_id"), F.when(letters, F.col("content")).otherwise(F.col("summary")).alias("text"), F.col("lang").alias("label"))
    windows = conversations.select(F.col("cid").alias("rec_id"), F.col("window").alias("text"), F.col("locale").alias("label"))
    model = model_of(rows.select("label", "text").unionAll(windows.select("label", "text")), vocabulary)
    a = of_texts(rows, model).select(F.lit("cards").alias("tab"), "rec_id", F.lit(0).cast("long").alias("line_no"), "lang", "confidence", "label")
    b = of_windows(windows, model).select(F.lit("conversations").alias("tab"), "rec_id", "line_no", "lang", "confidence", "label")
    if segments:
        parts = of_windows(rows, model, sentences).filter("line_no > 0")
        a = a.unionAll(parts.select(F.lit("cards").alias("tab"), "rec_id", "line_no", "lang", "confidence", "label"))
    return a.unionAll(b)


def wrong_labels(found: DataFrame) -> DataFrame:
    """Of `languages`: the rows whose label names no language or another one, and the foreign lines."""
    named = label_language(F.col("label"))
    wrong = F.col("lang").isNotNull() & ((F.col("line_no") > 0) | ~F.coalesce(named == F.col("lang"), F.lit(False)))
    return found.filter(wrong).select("tab", "rec_id", "line_no", "lang").distinct()
