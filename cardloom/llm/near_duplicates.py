"""Near-duplicate texts: pairs of word sets that share at least a given part of the words that either has.

A text is its set of words. Its fingerprint has 143 bits: each word flips one. Two fingerprints differ in at most as many
bits as the sets differ in words, so a pair of similarity t and sizes a, b lies within (1 - t) / (1 + t) * (a + b) bits: the search
radius, at which no pair is lost. Fingerprints meet in shards, one for each of many keys (bands) of least hashed words, so that a text
is in several shards and those of neighbours overlap (a pair at the wanted similarity shares no shard with probability MISSED, a closer one
with less). The more sets there are, the more words make a key and the more keys there are (`plan`): shards of unrelated texts stay small,
and MISSED is the same. Every shard of two texts or more is a vantage-point tree: its fingerprints are parted by their Hamming distance to
a vantage point, the triangle inequality prunes, and only the rims on both sides of a boundary are compared across it. What remains is
compared exactly, word by word. A shard that is larger than SHARD_ROWS is cut into blocks, and each two blocks meet in a shard of their own;
which shards are that large is told by a sample of the sets, and only how the work is dealt out depends on it.

What is shuffled for a text and shard is a record of 32 bytes: key, size and 15 bits, twice 64 bits, and the set's 64-bit digest. Records
travel in blobs, one for each bucket of keys, and in rounds of at most AT_ONCE bands, so that the shuffle files of one round are there at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.session import written

MISSED = 4.2e-5
#: So many words make a key; another one from each of these numbers of sets on.
ROWS, MORE = 4, (700_000, 6_000_000, 22_000_000)
#: Bands of a round, and records of a bucket.
AT_ONCE, BUCKET = 13, 50_000
SHARD_ROWS = 200_000
#: One in so many sets is counted to find large shards.
COUNTED = 64
#: Twelve bits tell a set's size: as it is below 2,048, above within 0.3 %; from half a million words on, sizes are not told apart.
_EXACT, _FINE = 2048, 256
_LOW = np.concatenate([np.arange(_EXACT), np.floor(_EXACT * 2 ** (np.arange(_EXACT) / _FINE))])
_HIGH = np.concatenate([np.arange(_EXACT), np.ceil(_EXACT * 2 ** ((np.arange(_EXACT) + 1) / _FINE))])
_HIGH[-1] = np.inf
#: Distances fit into 20 bits; so many pairs are compared at once.
_FAR, _WIDE, _PAIRS = (1 << 20) - 1, 1 << 20, 1 << 20
#: Ids with one and the same set of words are paired in blocks of so many.
COPIES = 1000
#: Words whose least hashes are found at once.
_WORDS = 150_000
_RECORD = np.dtype([("key", "<u4"), ("g", "<i4"), ("f", "<u8"), ("e", "<u8"), ("d", "<i8")])
_WORD = re.compile(r"[一-鿿㐀-䶿]|[^\W_一-鿿㐀-䶿]+")
_REMEMBERED = 150_000


def words(text: str) -> list[str]:
    """Runs of letters or digits in lower case; each Chinese character is a word of its own."""
    return _WORD.findall(text.lower())


def _size_code(n: np.ndarray) -> np.ndarray:
    """The twelve bits of sizes."""
    large = _EXACT + np.floor(_FINE * np.log2(np.maximum(n, _EXACT) / _EXACT) + 1e-9).astype(np.int64)
    return np.where(n < _EXACT, n, np.minimum(large, 2 * _EXACT - 1))


def plan(sets: int, least: float) -> tuple[int, int]:
    """Words of a key and number of bands for so many sets: a pair at similarity `least` is in no common shard with probability MISSED."""
    rows = ROWS + sum(sets > n for n in MORE)
    return rows, math.ceil(math.log(MISSED) / math.log1p(-min(least**rows, 1 - 1e-9)))


class _Index(dict):
    """Words to their numbers; an unknown one gets the next."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Hasher:
    """Words to 64-bit hashes, remembered by a worker."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.hash = np.empty(4096, dtype=np.uint64)

    def lookup(self, found: list[str]) -> np.ndarray:
        first = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, found), dtype=np.int64, count=len(found))
        if len(self.index) > first:
            while len(self.index) > len(self.hash):
                self.hash = np.concatenate([self.hash, np.empty_like(self.hash)])
            self.hash[first : len(self.index)] = [xxhash.xxh64_intdigest(w) for w in islice(self.index, first, None)]
        return self.hash[at]


_hasher = _Hasher()


def _sketch(lists: list[set[str]]) -> dict[str, np.ndarray]:
    """For each set of words, none of them empty: size, digest and fingerprint; the hashes of all in a row."""
    if len(_hasher.index) > _REMEMBERED:
        _hasher.clear()
    count = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    start = np.cumsum(count) - count
    h = _hasher.lookup([w for x in lists for w in x])
    bit = (h >> np.uint64(40)) % np.uint64(143)
    flip = np.uint64(1) << (bit & np.uint64(63))
    third = lambda k: np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, flip, np.uint64(0)), start)
    return {
        "count": count,
        "hashes": h,
        "d1": np.add.reduceat(h, start),
        "f1": third(0),
        "f2": third(1),
        "f3": third(2),
    }


def sketches(texts: DataFrame) -> DataFrame:
    """texts: id, text. (id, d, words, f, e, g) of the texts with words.

    The digest d stands for the word set: of n different sets, n * n / 2^65 pairs are expected to share one. f and e
    have 64 bits each of the fingerprint, g the size and the other 15.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                lists = [set(words(t)) if t else () for t in part.column(1).to_pylist()]
                keep = [k for k, x in enumerate(lists) if x]
                if not keep:
                    continue
                s = _sketch([lists[k] for k in keep])
                long = lambda x: pa.array(x.astype(np.int64))
                ends = np.concatenate([[0], np.cumsum(s["count"])]).astype(np.int32)
                g = pa.array((_size_code(s["count"]) << 15 | s["f3"].astype(np.int64)).astype(np.int32))
                arrays = [part.column(0).take(pa.array(keep)), long(s["d1"]), pa.ListArray.from_arrays(pa.array(ends), long(s["hashes"])), long(s["f1"]), long(s["f2"]), g]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "d", "words", "f", "e", "g"])

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, d bigint, words array<bigint>, f bigint, e bigint, g int")


class _Bands:
    """Shard keys of word sets: those of the bands from `first` on, before `last`, each of the least of `rows` hashes of the words."""

    def __init__(self, first: int, last: int, rows: int):
        drawn = np.random.default_rng(7).integers(0, 2**63, (last, 2, rows), dtype=np.uint64)[first:]  # a band's are the same in any round
        a, b = drawn[:, 0], drawn[:, 1]
        self.a, self.b, self.shape = a.reshape(-1) | np.uint64(1), b.reshape(-1), (last - first, rows)
        self.mix = np.random.default_rng(8).integers(0, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        self.salt = np.arange(first + 1, last + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def least(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Least hashes of the sets, whose words' hashes end at `ends`."""
        known, at = np.unique(h, return_inverse=True)
        table = np.empty((len(known), len(self.a)), dtype=np.uint32)
        for k in range(0, len(known), 4096):
            table[k : k + 4096] = (known[k : k + 4096, None] * self.a + self.b) >> np.uint64(32)
        out, start = np.empty((len(ends), len(self.a)), dtype=np.uint32), 0
        for k, end in enumerate(ends.tolist()):
            table.take(at[start:end], axis=0).min(axis=0, out=out[k])
            start = end
        return out

    def keys(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(sets, bands) of 32 bits."""
        out, first, start = np.empty((len(ends), self.shape[0]), dtype=np.uint32), 0, 0
        while first < len(ends):  # so many sets that the table of their words stays small
            last = max(first + 1, int(np.searchsorted(ends, start + _WORDS, side="right")))
            cuts = range(start, int(ends[last - 1]), _WORDS) if last == first + 1 else [start]
            least = [self.least(h[c : c + _WORDS], np.minimum(ends[first:last] - c, _WORDS)) if len(cuts) > 1 else self.least(h[c : ends[last - 1]], ends[first:last] - c) for c in cuts]
            low = np.minimum.reduce(least).reshape(last - first, *self.shape)
            mixed = np.broadcast_to(self.salt, low.shape[:2]).copy()
            for r in range(self.shape[1]):
                mixed += low[:, :, r] * self.mix[r]
            out[first:last] = (mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            first, start = last, int(ends[last - 1])
        return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's end."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].view(np.uint64), ends[1:] - ends[0]


class _Forest:
    """Fingerprints of a task: one vantage-point tree for every shard, all trees grown level by level together."""

    def __init__(self, f1: np.ndarray, f2: np.ndarray, f3: np.ndarray, code: np.ndarray, least: float):
        self.f1, self.f2, self.f3, self.least = f1, f2, f3.astype(np.uint16), least
        self.low, self.high = _LOW[code], _HIGH[code]
        self.reach = (1 - least) / (1 + least) * self.high
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.compared = 0

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = np.bitwise_count(self.f1[a] ^ self.f1[b])
        d += np.bitwise_count(self.f2[a] ^ self.f2[b])
        d += np.bitwise_count(self.f3[a] ^ self.f3[b])
        return d

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Keep those of the pairs (a, b) whose fingerprints and sizes allow the similarity; returns the distances."""
        self.compared += len(a)
        d = self.distance(a, b)
        ok = np.flatnonzero(d <= self.reach[a] + self.reach[b] + 1e-6)
        if len(ok):
            a, b = a[ok], b[ok]
            ok = (self.high[a] >= self.least * self.low[b] - 1e-6) & (self.high[b] >= self.least * self.low[a] - 1e-6)
            self.left.append(a[ok])
            self.right.append(b[ok])
        return d

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        """As `near`, of which those pairs are kept whose first 64 bits alone allow it."""
        ok = np.flatnonzero(np.bitwise_count(self.f1[a] ^ self.f1[b]) <= self.reach[a] + self.reach[b] + 1e-6)
        self.compared += len(a) - len(ok)
        self.near(a[ok], b[ok])

    def search(self, shard: np.ndarray) -> None:
        """All near pairs of rows with one value of `shard`, which is sorted.

        In a node whose sizes differ by more than the similarity allows the vantage point is the empty set (a size is the distance to
        it), else the first row. The node is parted at the median distance; a pair is compared across the boundary only if its two
        distances differ by no more than the radius: the triangle inequality rules out the rest. Parts go on as nodes of the next level.
        """
        at, node = np.arange(len(shard)), np.cumsum(np.concatenate([[0], (shard[1:] != shard[:-1]).astype(np.int64)])) if len(shard) else shard
        apart = np.minimum((1 - self.least) / self.least * self.high + 1, _FAR)  # no similar set differs in more words
        largest = np.minimum(self.high / self.least + 1e-6, _FAR)
        while len(at):
            alive = np.bincount(node)[node] > 1
            at, node = at[alive], node[alive]
            if not len(at):
                break
            head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            which = np.repeat(np.arange(len(head)), np.diff(np.concatenate([head, [len(node)]])))
            hollow = np.maximum.reduceat(self.low[at], head) * self.least > np.minimum.reduceat(self.high[at], head)
            vantage = at[head][which]
            rest = np.ones(len(at), bool)
            rest[head[~hollow]] = False
            at, vantage, which = at[rest], vantage[rest], which[rest]
            d = self.low[at].astype(np.int64)
            own = np.flatnonzero(~hollow[which])
            for k in range(0, len(own), _PAIRS):
                part = own[k : k + _PAIRS]
                d[part] = self.near(at[part], vantage[part])
            order = np.argsort(which * _WIDE + d, kind="stable")
            at, d, which = at[order], d[order], which[order]
            size = np.bincount(which, minlength=len(head))
            start = np.cumsum(size) - size
            outside = np.arange(len(at)) - start[which] >= ((size + 1) // 2)[which]
            inner = np.flatnonzero(~outside)
            first = (start + (size + 1) // 2)[which[inner]]
            rim = np.where(hollow[which[inner]], largest[at[inner]], d[inner] + apart[at[inner]]).astype(np.int64)
            many = np.maximum(np.searchsorted(which * _WIDE + d, which[inner] * _WIDE + np.minimum(rim, _FAR), side="right") - first, 0)
            total = np.cumsum(many)
            k = 0
            while k < len(inner) and total[-1]:
                upto = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + _PAIRS, side="right")))
                m = many[k:upto]
                a = np.repeat(at[inner[k:upto]], m)
                b = np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[k:upto], m)
                if len(a):
                    self.across(a, at[b])
                k = upto
            node = which * 2 + outside
            node = np.cumsum(np.concatenate([[0], (node[1:] != node[:-1]).astype(np.int64)])) if len(node) else node


def _records(sets: DataFrame, bands: _Bands, buckets: int, large: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(bucket, rows): the records of the sets for each band, in blobs. large: sorted keys of large shards, and their numbers of blocks."""

    def of(batch: pa.RecordBatch) -> np.ndarray:
        d = batch.column("d").to_numpy()
        once = np.unique(d, return_index=True)[1]
        if len(once) < len(d):
            batch = batch.take(pa.array(once))
        out = np.empty((batch.num_rows, bands.shape[0]), dtype=_RECORD)
        out["key"] = bands.keys(*_lists(batch.column("words")))
        for n in ("g", "f", "e", "d"):
            out[n] = batch.column(n).to_numpy().view(_RECORD[n])[:, None]
        out = out.reshape(-1)
        if not len(large[0]):
            return out
        at = np.minimum(np.searchsorted(large[0], out["key"]), len(large[0]) - 1)
        cut = large[0][at] == out["key"]
        apart, blocks = out[cut], large[1][at[cut]]
        side = (apart["d"].view(np.uint64) % blocks.astype(np.uint64)).astype(np.int64)
        parts = [out[~cut]]
        for other in range(int(blocks.max(initial=0))):  # block by block, each pair of which is a shard
            ok = (other < blocks) & (other != side)
            met = apart[ok]
            i, j = np.minimum(side[ok], other).astype(np.uint64), np.maximum(side[ok], other).astype(np.uint64)
            mixed = (met["key"] + (i << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + j * np.uint64(0xD6E8FEB86659FD93)
            met["key"] = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
            parts.append(met)
        return np.concatenate(parts)

    def blobs(rows: np.ndarray) -> pa.RecordBatch:
        bucket = ((rows["key"].astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
        rows = rows[np.argsort(bucket, kind="stable")]
        count = np.bincount(bucket, minlength=buckets)
        which = np.flatnonzero(count)
        ends = np.concatenate([[0], np.cumsum(count[which])]) * _RECORD.itemsize
        data = pa.BinaryArray.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(rows)])
        return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), data], names=["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                held.append(of(batch.slice(at, 10_000)))
                if sum(map(len, held)) > 600_000:
                    yield blobs(np.concatenate(held))
                    held = []
        if held:
            yield blobs(np.concatenate(held))

    return sets.select("d", "words", "f", "e", "g").mapInArrow(run, "bucket int, rows binary")


def _near(rows: np.ndarray, least: float) -> pa.RecordBatch:
    """Near pairs (x, y) of digests, x < y, of the records that share a key; a pair may be there more than once."""
    order = np.argsort(rows["key"])
    key = rows["key"][order]
    same = key[1:] == key[:-1]
    order = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    rows = rows[order[np.lexsort((rows["d"][order], rows["key"][order]))]]
    rows = rows[np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["d"][1:] != rows["d"][:-1])])[: len(rows)]]
    g, d = rows["g"].astype(np.int64), np.ascontiguousarray(rows["d"])
    trees = _Forest(np.ascontiguousarray(rows["f"]), np.ascontiguousarray(rows["e"]), g & 0x7FFF, g >> 15 & 0xFFF, least)
    trees.search(rows["key"].astype(np.int64))
    x, y = (np.concatenate([*side, np.empty(0, np.int64)]).astype(np.int64) for side in (trees.left, trees.right))
    x, y = np.minimum(d[x], d[y]), np.maximum(d[x], d[y])
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(x)]
    return pa.RecordBatch.from_arrays([pa.array(x[new]), pa.array(y[new])], names=["x", "y"])


def _search(records: DataFrame, least: float) -> DataFrame:
    """Near pairs of `_records`: blobs of a bucket meet, sorted by bucket within partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        bucket = -1
        for batch in batches:
            if not batch.num_rows:
                continue
            which, column = batch.column(0).to_numpy(), batch.column(1)
            wide = pa.types.is_large_binary(column.type)
            ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
            first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            for a, b in zip(first, [*first[1:], len(which)]):
                if which[a] != bucket and held:
                    yield _near(np.concatenate(held), least)
                    held = []
                bucket = which[a]
                held.append(np.frombuffer(column.buffers()[2], _RECORD, (ends[b] - ends[a]) // _RECORD.itemsize, ends[a]).copy())
        if held:
            yield _near(np.concatenate(held), least)

    return records.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "x bigint, y bigint")


def _large(sets: DataFrame, bands: _Bands) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the shards of more than SHARD_ROWS sets, sorted, and the number of blocks of each; by a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(bands.keys(*_lists(batch.column(0))).reshape(-1).astype(np.int64))], names=["key"])

    sample = sets.filter(F.pmod("d", F.lit(COUNTED)) == 0).dropDuplicates(["d"]).select("words").mapInArrow(run, "key bigint")
    counted = sample.groupBy("key").agg((F.count("*") * COUNTED).alias("size")).filter(F.col("size") > SHARD_ROWS)
    found = sorted((r.key, -(-r.size // (SHARD_ROWS // 2))) for r in counted.collect())
    return np.array([k for k, _ in found], dtype=np.uint32), np.array([n for _, n in found], dtype=np.int64)


def _apart(df: DataFrame, name: str) -> DataFrame:
    """`written`; shuffle files of it stay until the driver collects what refers to them, which it is told to do."""
    out = written(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """Pairs (x, y), x < y, of digests of `sketches` whose word sets have a Jaccard similarity of at least `least`."""
    n = sets.count()
    rows, bands = plan(n, least)
    large = _large(sets, _Bands(0, bands, rows)) if n > SHARD_ROWS else (np.empty(0, np.uint32), np.empty(0, np.int64))
    rounds = -(-bands // AT_ONCE)
    cuts = [bands * k // rounds for k in range(rounds + 1)]
    found = None
    for first, last in zip(cuts, cuts[1:]):
        part = _apart(_search(_records(sets, _Bands(first, last, rows), n * (last - first) // BUCKET + 1, large), least).distinct(), "near-in-bands")
        found = part if found is None else found.unionAll(part)
    found = _apart(found.distinct(), "near-pairs")
    ends = found.select(F.col("x").alias("d")).unionAll(found.select("y")).distinct()
    texts = _apart(sets.select("d", "words").join(ends, "d", "left_semi").groupBy("d").agg(F.first("words").alias("words")), "near-words")
    both = found.join(texts.select(F.col("d").alias("x"), F.col("words").alias("wx")), "x").join(texts.select(F.col("d").alias("y"), F.col("words").alias("wy")), "y")
    both = both.select("x", "y", F.size(F.array_intersect("wx", "wy")).alias("s"), (F.size("wx") + F.size("wy")).alias("n"))
    return both.filter(F.col("s") >= F.lit(least) * (F.col("n") - F.col("s")) - 1e-9).select("x", "y")


def card_texts(cards: DataFrame) -> DataFrame:
    """(id, text): summary and content together."""
    return cards.select("id", F.concat_ws(" ", "summary", "content").alias("text")).filter("id is not null")


def near_pairs(texts: DataFrame, least: float = 0.7) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of different ids whose texts are as similar. Texts without words are in no pair.

    A row delivered twice counts once; an id with several texts pairs with each. Identical word sets are compared once.
    """
    sets = written(sketches(texts), "word-sets")
    members = sets.select("id", "d").distinct()
    a, b = members.select(F.col("id").alias("u"), F.col("d").alias("x")), members.select(F.col("id").alias("v"), F.col("d").alias("y"))
    between = similar_sets(sets, least).join(a, "x").join(b, "y").select("u", "v")
    within = _copies(members)
    pairs = between.unionAll(within).filter("u <> v")
    return pairs.select(F.least("u", "v").alias("id_a"), F.greatest("u", "v").alias("id_b")).distinct()


def _copies(members: DataFrame) -> DataFrame:
    """(u, v): all pairs of ids (u < v) with the same digest. A digest of many ids is cut into blocks, each two of which meet in a task."""
    blocks = members.groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select("d", F.ceil(F.col("n") / COPIES).cast("int").alias("blocks"))
    each = members.join(blocks, "d").withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("d", "id", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    a, b = each.select("d", "i", "j", F.col("id").alias("u"), "side"), each.select("d", "i", "j", F.col("id").alias("v"), F.col("side").alias("side_v"))
    return a.join(b, ["d", "i", "j"]).filter((F.col("u") < F.col("v")) & ((F.col("i") == F.col("j")) | (F.col("side") != F.col("side_v")))).select("u", "v")


def classes(texts: DataFrame, least: float = 0.7) -> DataFrame:
    """One row per text with words: id, class_id (the smallest id that a chain of similar texts leads to), n_links, n_copies.

    n_links counts the other word sets that are similar, n_copies the ids with the same set of words. Copies are not paired.
    """
    sets = written(sketches(texts), "word-sets")
    groups = sets.select("id", "d").distinct().groupBy("d").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies"))
    groups = written(groups, "copies")
    a, b = groups.select(F.col("d").alias("x"), F.col("rep").alias("u")), groups.select(F.col("d").alias("y"), F.col("rep").alias("v"))
    edges = written(similar_sets(sets, least).join(a, "x").join(b, "y").select("u", "v"), "links")
    both = edges.unionAll(edges.select("v", "u"))
    links = both.groupBy(F.col("u").alias("rep")).agg(F.count("*").alias("n_links"))
    label = components(edges)
    out = groups.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").join(links, "rep", "left")
    out = out.select("d", F.coalesce("component", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies")
    return sets.select("id", "d").distinct().join(out, "d").select("id", "class_id", "n_links", "n_copies")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of the edges (u, v), each named by its smallest node.

    Each round every node takes the smallest label around it and then the label of its label, so that chains halve. Labels only fall,
    so the rounds end; they go on until no label moves.
    """
    both = written(edges.unionAll(edges.select("v", "u")).distinct(), "edges")
    label = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")), "labels")
    while True:
        around = both.join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        lower = label.join(around, "u").select("u", F.least("c", "m").alias("m"), "c")
        hop = lower.select(F.col("u").alias("m"), F.col("m").alias("t"))
        after = written(lower.join(hop, "m").select("u", F.least("m", "t").alias("c"), (F.least("m", "t") < F.col("c")).alias("moved")), "labels")
        label = after.select("u", "c")
        if not after.filter("moved").limit(1).count():
            break
    return label.select(F.col("u").alias("node"), F.col("c").alias("component"))
