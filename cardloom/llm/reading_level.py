"""Reading level of documents by a Rasch model of readers and documents, whose difficulty comes from the words that occur in them.

Readers 1 to 3 are the persons, with abilities tau_1 < tau_2 < tau_3; documents are the items. A reader copes with a document with
probability sigmoid(tau_k - theta_d); a document's grade says which readers do not (grade > k). A document's difficulty theta_d is the
mean of the difficulties b_w of its word occurrences (a linear logistic test model), so that documents nobody graded are on the same scale.

Fit, by alternation over the graded documents (a bounded sample of labelled rows):
1. start: every occurrence of a word in a graded document is a response to that word, sigmoid(tau_k - b_w); Newton steps for all b_w
   given tau and for tau given b, on counts that the tasks add up;
2. then in turn the abilities (Newton, given theta), the documents (theta, given b) and the words: one step along the gradient that the
   tasks add up over their documents, scaled by a bound of the curvature and lengthened as far as the penalised likelihood rises.
The likelihood rises in every round; the fit ends when it rises by less than TOLERANCE of itself, before the words learn slips of graders.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.session import written

#: Bound of the fit: graded documents (those of the least hashed ids). The words are all words of these.
MOST_GRADED = 12_000
LEVELS = 4
LEAST_CHARS = 200
#: Standard deviations of the prior of b_w: as an item of its own, and as a part of a document's mean.
PRIOR_ALONE, PRIOR = 4.0, 60.0
TOLERANCE, MOST_ROUNDS = 0.02, 40
_K = np.arange(1, LEVELS)
_EVEN = np.log(_K / (LEVELS - _K))
_WORD = re.compile(r"[一-鿿㐀-䶿]|[^\W\d_一-鿿㐀-䶿]+")


def terms(text: str) -> list[str]:
    """Words in lower case; of Chinese text, each character with the one that follows."""
    words = _WORD.findall(text.lower())
    if text.isascii():
        return words
    out = []
    for k, w in enumerate(words):
        if "㐀" <= w[0] <= "鿿" and k + 1 < len(words) and "㐀" <= words[k + 1][0] <= "鿿":
            w += words[k + 1]
        out.append(w)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class Model:
    """Difficulties of words, abilities of readers (the thresholds between levels), and the likelihood after each round of the fit."""

    def __init__(self, words: list[str], difficulty: np.ndarray, abilities: np.ndarray, likelihood: list[float]):
        self.index = {w: k + 1 for k, w in enumerate(words)}
        self.difficulty = np.concatenate([[0.0], difficulty])
        self.abilities, self.likelihood = abilities, likelihood

    def theta(self, text: str) -> float:
        """The mean difficulty of the text's word occurrences; words that no graded document has count as average."""
        at = np.fromiter(map(self.index.get, terms(text), repeat(0)), dtype=np.int64, count=-1)
        return float(self.difficulty[at].mean()) if len(at) else 0.0

    def level(self, text: str | None) -> tuple[float, int] | None:
        """(theta, level 1 to 4); None for a null text or one under LEAST_CHARS characters."""
        if text is None or len(text) < LEAST_CHARS:
            return None
        t = self.theta(text)
        return t, 1 + int((t > self.abilities).sum())


def _likelihood(theta: np.ndarray, tau: np.ndarray, fails: np.ndarray, b: np.ndarray) -> float:
    """Penalised log-likelihood; fails: by document and reader, the share of grades by which the reader does not cope."""
    x = theta[:, None] - tau
    return float((fails * x - np.logaddexp(0, x)).sum() - (b @ b) / (2 * PRIOR**2))


def _abilities(theta: np.ndarray, tau: np.ndarray, fails: np.ndarray, weight: np.ndarray | None = None, steps: int = 3) -> np.ndarray:
    """Newton steps for tau given theta; a reader with whom all or none cope stays where the scale has no end."""
    w = np.ones(len(theta)) if weight is None else weight
    for _ in range(steps):
        p = _sigmoid(theta[:, None] - tau)
        rise = (w[:, None] * (p - fails)).sum(0) - 1e-3 * tau
        tau = tau + np.clip(rise / ((w[:, None] * p * (1 - p)).sum(0) + 1e-3), -1, 1)
    return tau


def _words_alone(counts: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(b, tau) of the words as items. counts: by word, occurrences and those beyond each reader."""
    n, beyond = counts[:, 0], counts[:, 1:]
    b, tau = np.zeros(len(n)), np.array(_EVEN)
    shares = beyond / np.maximum(n, 1)[:, None]
    for _ in range(rounds):
        for _ in range(2):
            p = _sigmoid(b[:, None] - tau)
            rise = (beyond - n[:, None] * p).sum(1) - b / PRIOR_ALONE**2
            b = b + np.clip(rise / ((n[:, None] * p * (1 - p)).sum(1) + 1 / PRIOR_ALONE**2), -2, 2)
        tau = _abilities(b, tau, shares, n, 1)
    return b, tau


class _Graded:
    """The graded documents as packed rows (doc, fails, word numbers, shares), spread over the cluster; what the tasks add up."""

    def __init__(self, documents: DataFrame, grades: DataFrame):
        beyond = [F.avg((F.col("level") > k).cast("double")) for k in range(1, LEVELS)]
        graded = grades.filter(F.col("level").between(1, LEVELS)).groupBy("doc_id").agg(F.array(*beyond).alias("fails"))
        graded = F.broadcast(graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_GRADED))
        texts = documents.select("doc_id", "text").filter(F.length("text") >= LEAST_CHARS).join(graded, "doc_id").dropDuplicates(["doc_id"])
        texts = written(texts.select("text", "fails"), "graded")

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column(0).to_pylist() for w in terms(t)}), pa.string())], names=["word"])

        self.words = sorted(r.word for r in texts.select("text").mapInArrow(distinct, "word string").distinct().collect())
        index = {w: k for k, w in enumerate(self.words)}

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, share, size = [], [], []
                for t in batch.column(0).to_pylist():
                    c = Counter(terms(t))
                    n = sum(c.values())
                    at.append([index[w] for w in c])
                    share.append([v / n for v in c.values()])
                    size.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float64())), pa.array(size, pa.int64())], names=["fails", "at", "share", "size"])

        self.rows = written(texts.select("text", "fails").mapInArrow(pack, "fails array<double>, at array<int>, share array<double>, size bigint").withColumn("doc", F.monotonically_increasing_id()), "graded-words")

    def _each(self, part: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> list:
        """`part` of (batch, document of each entry, word, share, fails) over all packed rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    at, share = batch.column("at"), batch.column("share")
                    doc = np.repeat(np.arange(batch.num_rows), np.asarray(at.value_lengths()))
                    fails = np.asarray(batch.column("fails").flatten()).reshape(batch.num_rows, LEVELS - 1)
                    yield part(batch, doc, np.asarray(at.flatten()), np.asarray(share.flatten()), fails)

        return self.rows.mapInArrow(run, schema).collect()

    def counts(self) -> np.ndarray:
        """By word: its occurrences, and those beyond each reader."""
        size = len(self.words)

        def part(batch, doc, at, share, fails):
            n = share * np.asarray(batch.column("size"))[doc]
            sums = np.stack([np.bincount(at, n, size), *(np.bincount(at, n * fails[doc, k], size) for k in range(LEVELS - 1))])
            return pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["x"])

        return sum((np.frombuffer(r.x).reshape(LEVELS, size) for r in self._each(part, "x binary")), np.zeros((LEVELS, size))).T

    def means(self, *vectors: np.ndarray) -> np.ndarray:
        """By document, in the order of doc: the fails, and the mean of each vector over its occurrences."""

        def part(batch, doc, at, share, fails):
            found = [np.bincount(doc, share * v[at], batch.num_rows) for v in vectors]
            return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(np.column_stack([fails, *found]).tolist(), pa.list_(pa.float64()))], names=["doc", "x"])

        return np.array([r.x for r in sorted(self._each(part, "doc bigint, x array<double>"), key=lambda r: r.doc)]).reshape(-1, LEVELS - 1 + len(vectors))

    def slopes(self, b: np.ndarray, tau: np.ndarray) -> np.ndarray:
        """By word: the slope of the likelihood in b_w, and a bound of its curvature (means are convex: a share of a document's)."""
        size = len(b)

        def part(batch, doc, at, share, fails):
            theta = np.bincount(doc, share * b[at], batch.num_rows)
            miss = (fails - _sigmoid(theta[:, None] - tau)).sum(1)
            sums = np.stack([np.bincount(at, share * miss[doc], size), np.bincount(at, share * ((LEVELS - 1) / 4), size)])
            return pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["x"])

        return sum((np.frombuffer(r.x).reshape(2, size) for r in self._each(part, "x binary")), np.zeros((2, size)))


def _stretch(theta: np.ndarray, fails: np.ndarray, tau: np.ndarray) -> tuple[float, np.ndarray]:
    """(factor, tau): by how much to stretch the start's scale, on which words stand, for whole documents. Newton, both at once in turn."""
    a = 1.0
    for _ in range(25):
        p = _sigmoid(a * theta[:, None] - tau)
        rise, curve = ((fails - p) * theta[:, None]).sum() - 1e-3 * a, (p * (1 - p) * theta[:, None] ** 2).sum() + 1e-3
        a = max(1e-3, a + float(np.clip(rise / curve, -2, 2)))
        tau = _abilities(a * theta, tau, fails, steps=1)
    return a, tau


def fit(documents: DataFrame, grades: DataFrame) -> Model:
    """Fit on the graded documents; `grades`: doc_id, level (1 to 4), any number per document. Without any, every text is average."""
    graded = _Graded(documents, grades)
    if not graded.words:
        return Model([], np.zeros(0), np.array(_EVEN), [])
    counts = graded.counts()
    b, tau = _words_alone(counts)
    b = b - (b @ counts[:, 0]) / counts[:, 0].sum()
    found = graded.means(b)
    fails, theta = found[:, :-1], found[:, -1]
    factor, tau = _stretch(theta, fails, tau)
    b, theta = b * factor, theta * factor
    ll = [_likelihood(theta, tau, fails, b)]
    while len(ll) <= MOST_ROUNDS:
        tau = _abilities(theta, tau, fails)
        slope, curve = graded.slopes(b, tau)
        step = (slope - b / PRIOR**2) / (curve + 1 / PRIOR**2)
        along = graded.means(step)[:, -1]
        now, k = max((_likelihood(theta + k * along, tau, fails, b + k * step), k) for k in (0, 1, 2, 4, 8, 16, 32, 64))
        b, theta = b + k * step, theta + k * along
        ll.append(now)
        if ll[-1] - ll[-2] < TOLERANCE * abs(ll[-2]):
            break
    return Model(graded.words, b, np.sort(_abilities(theta, tau, fails)), ll)


def _thetas(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, theta, level); both null for a text without a level."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.level(t) for t in batch.column(1).to_pylist()]
            theta = pa.array([f and f[0] for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), theta, pa.array([f and f[1] for f in found], pa.int32())], names=["doc_id", "theta", "level"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, theta double, level int")


def levels(documents: DataFrame, grades: DataFrame) -> DataFrame:
    """(doc_id, theta, level) of every document; theta and level are null for null texts and those under LEAST_CHARS characters.

    Without grades the abilities are where the logit scale has them, and every text is in the middle.
    """
    return _thetas(documents, fit(documents, grades))
