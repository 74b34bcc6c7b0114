"""Held-out texts inside a corpus (problem 6), by SimHash windows and multi-index Hamming blocks.

Items and documents are read as windows of ``width`` words. A window is the set of its word shingles, repeats told apart by their number, and its
fingerprint is the 64-bit SimHash of that set. The index of the items divides fingerprints into BLOCKS blocks of bits. Two fingerprints
within RADIUS bits differ in at most RADIUS // BLOCKS bits in one of the blocks (pigeonhole), so looking up each block of a
document's window with every change of so many bits finds all items' windows within the radius. Those are then verified by the exact weighted
similarity of their shingles (sum of the lesser counts over sum of the greater).

The radius is chosen for windows of 13 words and five-word shingles: at a similarity of 0.8 one shingle of nine differs, which flips 8.8 bits on average and more than
15 in one window of a hundred. The rest, pairs that are similar but farther apart than the radius, is found exactly by a prefix filter: similar
windows of m shingles share at least some number c, and then, in any one order, the first m - c + 1 of the one share a shingle with
the first m - c + 1 of the other. Before either, a document's window with fewer than c shingles of the items is passed over; it can't be similar to any.

Words are cut and hashed by SQL functions; numpy makes sets and fingerprints over the flat hashes of a batch. The index goes to the executors as a
broadcast of at most ``most_windows`` windows, built once in each worker; more items are searched in parts of that size, one after the other, by the same code.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import bounded, mix64
from ..shared import cut

WORD = r"[\\p{L}\\p{N}]+"
#: 13 words: the length of a passage that counts as leaked
WIDTH, SHINGLE = 13, 5
MOST_WINDOWS = 2_000_000
BLOCKS, RADIUS = 4, 15
_BITS = 64 // BLOCKS
_SLICE, _PAIRS = 1 << 16, 1 << 17


def words(text: Column) -> Column:
    """The words of a text, in lower case; an empty array for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.expr(f"'{WORD}'"), F.lit(0)), F.lower)


def _least_common(width: int, shingle: int, similarity: float) -> int:
    """How many shingles two windows of that similarity have in common at least; one more than a window has if none can be so similar."""
    m = width - shingle + 1
    return next((c for c in range(1, m + 1) if c / (2 * m - c) >= similarity), m + 1)


def _shingles(hashes: np.ndarray, shingle: int) -> np.ndarray:
    """The shingle that begins at each of the flat word hashes."""
    each = np.zeros(max(0, len(hashes) - shingle + 1), dtype=np.uint64)
    for i in range(shingle):
        each = mix64(each * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(each) + i])
    return each


def _sets(each: np.ndarray, start: np.ndarray, per: int) -> np.ndarray:
    """A row for each window: its ``per`` shingles in order, the second, third ... copy of one as elements of their own."""
    out = np.sort(each[start[:, None] + np.arange(per)], axis=1)
    copy = np.zeros(out.shape, dtype=np.uint64)
    for j in range(1, per):
        copy[:, j] = np.where(out[:, j] == out[:, j - 1], copy[:, j - 1] + np.uint64(1), np.uint64(0))
    again = copy > 0
    out[again] = mix64(out[again] + copy[again] * np.uint64(0xD6E8FEB86659FD93))
    return np.sort(out, axis=1)


def _windows(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The flat word hashes; flat start, row and word offset of every window that lies inside one row."""
    hashes = lists.flatten().to_numpy().view(np.uint64)
    size = lists.value_lengths().to_numpy().astype(np.int64)
    if len(hashes) < width:
        return hashes, *(np.zeros(0, np.int64) for _ in range(3))
    row = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
    return hashes, at, row[at], at - (np.cumsum(size) - size)[row[at]]


def _prints(sets: np.ndarray) -> np.ndarray:
    """SimHash of each row of shingles: a bit is set if it is in more than half of them."""
    out = np.empty(len(sets), dtype=np.uint64)
    for at in range(0, len(sets), _SLICE):  # bounds the memory of the 64 sums
        part = np.ascontiguousarray(sets[at : at + _SLICE])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), part.shape[1], 8), axis=2)
        out[at : at + len(part)] = np.packbits(bits.sum(axis=1, dtype=np.int32) > part.shape[1] // 2, axis=1).view(np.uint64).ravel()
    return out


def _block(prints: np.ndarray, i: int) -> np.ndarray:
    """The i-th block of bits, as a number."""
    return (prints >> np.uint64(_BITS * i)).astype(np.int64) & ((1 << _BITS) - 1)


def _changes(most: int) -> np.ndarray:
    """Every change of at most ``most`` bits of a block."""
    return np.array([sum(1 << b for b in bits) for n in range(most + 1) for bits in combinations(range(_BITS), n)], dtype=np.int64)


def _distinct(w: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once; x below n."""
    pairs = np.unique(w * n + x)
    return pairs // max(n, 1), pairs % max(n, 1)


def _spans(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Number and place of every element of the ranges, in portions that bound the memory of the pairs looked at."""
    ends = np.concatenate([[0], np.cumsum(hi - lo)])
    for first in range(0, int(ends[-1]), _PAIRS):
        at = np.arange(first, min(first + _PAIRS, int(ends[-1])))
        k = np.searchsorted(ends, at, "right") - 1
        yield k, lo[k] + at - ends[k]


class _Index:
    """The items' windows by block of their fingerprints, and by their rarest shingles."""

    def __init__(self, sizes: np.ndarray, hashes: np.ndarray, width: int, shingle: int, common: int):
        self.width, self.shingle, self.common, self.per = width, shingle, common, width - shingle + 1
        held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(hashes))
        flat, start, self.row, self.at = _windows(held, width)
        self.start = start
        each = _shingles(flat, shingle)
        self.plain = np.unique(each)
        self.sets = _sets(each, start, self.per)
        self.prints = _prints(self.sets)
        self.tables = []
        for i in range(BLOCKS):
            keys = _block(self.prints, i)
            self.tables.append((np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << _BITS))]), np.argsort(keys, kind="stable")))
        self.known, inverse, number = np.unique(self.sets, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.known), dtype=np.int64)
        self.rank[np.argsort(number, kind="stable")] = np.arange(len(self.known))
        self.prefix = max(0, self.per - common + 1)
        keys = np.sort(self.rank[inverse.reshape(self.sets.shape)], axis=1)[:, : self.prefix].ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, self.holder = keys[order], order // max(self.prefix, 1)

    def screened(self, each: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The windows with at least ``common`` shingles that are the items'."""
        if not len(self.plain) or not len(start):
            return np.zeros(0, np.int64)
        held = self.plain[np.minimum(np.searchsorted(self.plain, each), len(self.plain) - 1)] == each
        sums = np.concatenate([[0], np.cumsum(held)])
        return np.flatnonzero(sums[start + self.per] - sums[start] >= self.common)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (one of prints, an item's window) within the radius, by the blocks."""
        changes = _changes(RADIUS // BLOCKS)
        w, x = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, (begin, order) in enumerate(self.tables):
            own = _block(prints, i)
            for at in range(0, len(prints), 512):
                value = (own[at : at + 512, None] ^ changes).ravel()
                for k, place in _spans(begin[value], begin[value + 1]):
                    a, b = at + k // len(changes), order[place]
                    near = np.bitwise_count(prints[a] ^ self.prints[b]) <= RADIUS
                    w.append(a[near])
                    x.append(b[near])
        return _distinct(np.concatenate(w), np.concatenate(x), len(self.prints))

    def beyond(self, sets: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that share one of their rarest shingles, and are farther apart than the radius."""
        place = np.minimum(np.searchsorted(self.known, sets), len(self.known) - 1)
        own = np.sort(np.where(self.known[place] == sets, self.rank[place], -1), axis=1)[:, : self.prefix].ravel()
        w, x = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, place in _spans(np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")):
            a, b = k // self.prefix, self.holder[place]
            far = np.bitwise_count(prints[a] ^ self.prints[b]) > RADIUS
            w.append(a[far])
            x.append(b[far])
        return _distinct(np.concatenate(w), np.concatenate(x), len(self.prints))

    def shared(self, sets: np.ndarray, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many shingles the two of each pair have in common."""
        out = np.zeros(len(w), dtype=np.int64)
        for at in range(0, len(w), _PAIRS):
            part = slice(at, at + _PAIRS)
            for j in range(self.per):
                out[part] += (sets[w[part]] == self.sets[x[part], j][:, None]).any(axis=1)
        return out


_built: dict = {}


def _index_of(held, name: str, *settings: int) -> tuple[pa.Table, _Index]:
    """The broadcast items and their index, built once a worker process; only the last one is kept."""
    if name not in _built:
        _built.clear()
        items = held.value
        lists = items.column("hashes").chunk(0)
        _built[name] = items, _Index(lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), *settings)
    return _built[name]


def _texts(lists: pa.ListArray, begin: np.ndarray, width: int) -> pa.ListArray:
    """``width`` words from each flat place on."""
    take = (begin[:, None] + np.arange(width)).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1, dtype=np.int32) * width), lists.flatten().take(pa.array(take)))


def _search(held, name: str, width: int, shingle: int, common: int):
    """Looks every document window up among the items of a broadcast (id, first, words, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, index = _index_of(held, name, width, shingle, common)
        item_ids, item_first, item_words = (items.column(c).chunk(0) for c in ("id", "first", "words"))
        item_first = item_first.to_numpy()
        for batch in bounded(batches, "hashes"):
            hashes, start, row, at = _windows(batch.column("hashes"), width)
            each = _shingles(hashes, shingle)
            near = index.screened(each, start)
            for i in range(0, len(near), _SLICE):
                some = near[i : i + _SLICE]
                sets, inverse = np.unique(_sets(each, start[some], index.per), axis=0, return_inverse=True)  # a passage often stands in many documents
                prints = _prints(sets)
                w, x = (np.concatenate(z) for z in zip(index.within(prints), index.beyond(sets, prints)))
                good = index.shared(sets, w, x) >= common
                w, x = w[good], x[good]
                apart = np.bitwise_count(prints[w] ^ index.prints[x]).astype(np.int32)
                # back to all windows with that set
                members = np.argsort(inverse.ravel(), kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(inverse.ravel(), minlength=len(sets)))])
                for k, place in _spans(ends[w], ends[w + 1]):
                    d, y = some[members[place]], x[k]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id").take(pa.array(row[d])), pa.array(at[d].astype(np.int32)), item_ids.take(pa.array(index.row[y])), pa.array((index.at[y] + item_first[index.row[y]]).astype(np.int32)),
                            pa.array(apart[k]), _texts(batch.column("words"), start[d], width), _texts(item_words, index.start[y], width),
                        ],
                        names=["doc", "doc_at", "item", "item_at", "apart", "dw", "iw"],
                    )

    return run


def _in_parts(items: DataFrame, width: int, most: int) -> list[DataFrame]:
    """Items (id, words) as segments (id, first, words) with all their windows, in parts of at most ``most`` windows."""
    long = max(1, min(1 << 16, most // 4))
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - width), F.lit(long))
    segments = items.filter(F.size("words") >= width).select("id", F.explode(cuts).alias("first"), "words")
    segments = segments.select("id", "first", F.slice("words", F.col("first") + 1, F.lit(long + width - 1)).alias("words"))
    windows = F.sum(F.size("words") - (width - 1))
    parts = max(1, -(-(segments.agg(windows).first()[0] or 0) // most))
    while True:
        numbered = segments.withColumn("part", F.pmod(F.xxhash64("id", "first", "words"), F.lit(parts)))
        if parts == 1 or numbered.groupBy("part").agg(windows.alias("n")).agg(F.max("n")).first()[0] <= most:
            return [numbered.filter(F.col("part") == i).drop("part") for i in range(parts)]
        parts *= 2


def _similarity(a: Column, b: Column, shingle: int, width: int) -> Column:
    """Weighted similarity of two windows of words."""

    def shingles(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(width - shingle + 1)), lambda i: F.array_join(F.slice(w, i, F.lit(shingle)), " "))

    def count(w: Column, x: Column) -> Column:
        return F.size(F.filter(w, lambda y: y == x))

    def ratio(x: Column, y: Column) -> Column:
        less = F.aggregate(F.array_union(x, y), F.lit(0), lambda s, z: s + F.least(count(x, z), count(y, z)))
        return F.transform(F.array(less), lambda n: n / (2 * (width - shingle + 1) - n))[0]

    # the shingles are named by a function over one pair, so they are made once
    return F.transform(F.array(F.struct(shingles(a).alias("x"), shingles(b).alias("y"))), lambda s: ratio(s["x"], s["y"]))[0]


def leaked_windows(
    documents: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text", item_text: str = "text",
    width: int = WIDTH, shingle: int = SHINGLE, similarity: float = 0.8, most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """``doc_id, doc_at, item_id, item_at, apart, similarity, same``: windows of documents that are like windows of items.

    doc_at and item_at count words from 0; apart: the bits in which the fingerprints differ (up to RADIUS the pair comes from the blocks, above from the prefix filter);
    same: the words are equal, one by one. Texts of fewer than ``width`` words, empty and null texts
    have no windows, nor have rows with a null id. Rows repeated whole count once on the items' side and give equal rows on
    the documents'; rows of one id with different texts are texts of their own. No window of that similarity (above 0) is missed. Items of more than ``most_windows`` windows (at least 256) are
    searched in parts. An empty table gives no rows. Other columns are ignored.
    """
    spark = documents.sparkSession

    def prepared(df: DataFrame, id: str, column: str) -> DataFrame:
        return df.filter(F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").cast("long").alias("id"), words(F.col(f"`{column}`")).alias("words"))

    hashed = lambda df, *more: df.select("id", *more, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    docs = hashed(prepared(documents, doc_id, text))
    parts = _in_parts(prepared(items, item_id, item_text).distinct(), width, max(256, most_windows))
    common, found = _least_common(width, shingle, similarity), None
    for i, part in enumerate(parts):
        held = spark.sparkContext.broadcast(hashed(part, "first").toArrow().combine_chunks())  # at most most_windows windows
        # the words of both come along, so nothing is shuffled
        now = docs.mapInArrow(_search(held, f"{spark.sparkContext.applicationId}-{held._jbroadcast.id()}", width, shingle, common), "doc long, doc_at int, item long, item_at int, apart int, dw array<string>, iw array<string>")
        if len(parts) > 1:  # one part at a time on the driver
            now = cut(now, "leaks")
            held.destroy()
        found = now if found is None else found.unionByName(now)
    checked = found.withColumn("same", F.col("dw") == F.col("iw")).withColumn("similarity", F.when(F.col("same"), F.lit(1.0)).otherwise(_similarity(F.col("dw"), F.col("iw"), shingle, width)))
    return checked.filter(F.col("similarity") >= similarity).select(F.col("doc").alias(doc_id), "doc_at", F.col("item").alias(item_id), "item_at", "apart", "similarity", "same")
