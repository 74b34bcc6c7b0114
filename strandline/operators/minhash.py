"""Minhash signatures, sketches and the candidate join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import bounded, flat_bytes, mix64, packed_kmers
from ..shared import cut

#: fixed values: the 64-bit finalizer of MurmurHash3 (public domain)
_MUL_1, _MUL_2, _SHIFT = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
_CODES = np.zeros(256, dtype=np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODES[_b] = _i
#: buckets are counted in so many slots; so many heavy ones have a bit of a LONG
SLOTS, HEAVY = 1 << 16, 62


def murmur64(x: np.ndarray) -> np.ndarray:
    """F17 on uint64."""
    x = (x ^ (x >> _SHIFT)) * _MUL_1
    x = (x ^ (x >> _SHIFT)) * _MUL_2
    return x ^ (x >> _SHIFT)


@F.pandas_udf(T.LongType())
def murmur64_column(x):
    """F17 on a LONG column; the bits are read as unsigned."""
    import pandas as pd

    return pd.Series(murmur64(x.to_numpy(dtype=np.int64).view(np.uint64)).view(np.int64))


def _reverse_complement(kmers: np.ndarray, k: int) -> np.ndarray:
    out = ~kmers
    # letters change places in pairs, then pairs in bytes, then bytes
    for shift, low in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        out = ((out >> np.uint64(shift)) & np.uint64(low)) | ((out & np.uint64(low)) << np.uint64(shift))
    return out.byteswap() >> np.uint64(64 - 2 * k)


def _canonical(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical k-mers inside one row each, their rows, and first and count of the rows that have any."""
    raw, offsets = flat_bytes(batch.column(batch.schema.names.index("seq")))
    length = np.diff(offsets)
    kmers = packed_kmers(_CODES[raw], k)
    row = np.repeat(np.arange(len(length)), length)[: len(kmers)]
    inside = np.arange(len(kmers)) + k <= offsets[1:][row] if len(kmers) else np.zeros(0, dtype=bool)
    kmers, row = kmers[inside], row[inside]
    return np.minimum(kmers, _reverse_complement(kmers, k)), row, *np.unique(row, return_index=True)


def _take(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    return [batch.column(n).take(pa.array(rows)) for n in batch.schema.names if n != "seq"]


def _signatures(k: int, hashes: int, mask: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "seq"):
            kmers, _, rows, first = _canonical(batch, k)
            if not len(rows):
                continue
            keys = np.empty((len(rows), hashes), dtype=np.uint64)
            for h in range(hashes):
                least = np.minimum.reduceat(murmur64(kmers + np.uint64(h)), first)
                keys[:, h] = least & np.uint64(4**k - 1) if mask and k < 32 else least
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(hashes)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([*_take(batch, rows), lists], names=[*(n for n in batch.schema.names if n != "seq"), "keys"])

    return run


def signature_rows(df: DataFrame, ids: list[str], seq: str, k: int = 16, hashes: int = 16, mask: bool = True) -> DataFrame:
    """A1 with a row a text: ``ids, keys``, the key of each hash function in its place."""
    rows = df.select(*ids, F.upper(seq).alias("seq")).filter(F.length("seq") >= k)
    return rows.mapInArrow(_signatures(k, hashes, mask), T.StructType([*(rows.schema[i] for i in ids), T.StructField("keys", T.ArrayType(T.LongType()))]))


def minhash(df: DataFrame, ids: list[str], seq: str, k: int = 16, hashes: int = 16, mask: bool = True) -> DataFrame:
    """A1: ``ids, h, key``: of each text of at least k letters and each hash function the least hash of its canonical k-mers, cut to
    2k bits (unsigned, least first). Letters beside A, C, G and T count as A. k at most 32. Shorter and null texts have no rows.

    A2 is the same with ``mask=False``: repeated k-mers never change a minimum.
    """
    return _entries(signature_rows(df, ids, seq, k, hashes, mask), ids)


def _entries(rows: DataFrame, ids: list[str]) -> DataFrame:
    """``ids, h, key`` of ``ids, keys``."""
    return rows.select(*ids, F.posexplode("keys").alias("h", "key"))


def _sketches(k: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "seq"):
            kmers, row, rows, _ = _canonical(batch, k)
            hashed = murmur64(kmers)
            order = np.lexsort((hashed, row))
            hashed, row = hashed[order], row[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
            hashed, row = hashed[new], row[new]
            begin = np.searchsorted(row, rows)
            keep = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row)))) < n
            count = np.bincount(row[keep], minlength=batch.num_rows)[rows]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(hashed[keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*_take(batch, rows), lists], names=[*(c for c in batch.schema.names if c != "seq"), "sketch"])

    return run


def bottom_sketch(df: DataFrame, ids: list[str], seq: str, k: int, n: int) -> DataFrame:
    """A3: ``ids, sketch``: the n least different hashes of the canonical k-mers of each text, as unsigned numbers in order."""
    rows = df.select(*ids, F.upper(seq).alias("seq")).filter(F.length("seq") >= k)
    return rows.mapInArrow(_sketches(k, n), T.StructType([*(rows.schema[i] for i in ids), T.StructField("sketch", T.ArrayType(T.LongType()))]))


def capped(signatures: DataFrame, most: int | Column, mode: str = "truncate", by: tuple[str, ...] = ("h", "key")) -> DataFrame:
    """Signatures (read_id, h, key) of buckets cut to their first ``most`` reads, or (drop) without larger buckets.

    Only buckets that are too large are ranked, so a bucket of usual size costs one count. by: the key of a bucket; most may be a
    number or a column that is the same throughout a bucket.
    """
    limit = F.lit(most) if isinstance(most, int) else most
    limited = signatures.withColumn("_most", limit)
    large = limited.groupBy(*by).agg(F.count("*").alias("n"), F.max("_most").alias("_most")).filter(F.col("n") > F.col("_most")).select(*by)
    usual = signatures.join(large, [*by], "left_anti")
    if mode == "drop":
        return usual
    # first reads of a large bucket by salted partial ranks: the first of all are among the first of each salt
    salted = limited.join(large, [*by], "left_semi").withColumn("salt", F.pmod(F.xxhash64("read_id"), F.lit(16)))
    part = salted.withColumn("r", F.row_number().over(Window.partitionBy(*by, "salt").orderBy("read_id"))).filter(F.col("r") <= F.col("_most"))
    kept = part.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("read_id"))).filter(F.col("r") <= F.col("_most"))
    return usual.unionByName(kept.select(*signatures.columns))


def _flat_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash function, key and slot of each key of a batch that is not null."""
    lists = batch.column("keys")
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    h = np.arange(len(row)) - (np.cumsum(size) - size)[row]
    values = lists.flatten()
    there = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
    row, h, key = row[there], h[there], values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[there]
    slot = mix64(key.view(np.uint64) + h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return row, h, key, slot.astype(np.int64)


def _slot_counts(rows: DataFrame) -> np.ndarray:
    """Keys by a hash of their bucket: at most SLOTS rows for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_flat_keys(batch)[3], minlength=SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])

    out = np.zeros(SLOTS, dtype=np.int64)
    for r in rows.select("keys").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def _heavy(windows: DataFrame, reads: DataFrame, meetings: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The buckets (h, key) in which most pairs meet, heaviest first: at most HEAVY, each of ``least`` pairs or more."""
    listed = np.zeros(SLOTS, dtype=bool)
    listed[np.argsort(-meetings, kind="stable")[: 4 * HEAVY]] = True
    listed &= meetings >= least
    if not listed.any():
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, h, key, slot = _flat_keys(batch)
            yield pa.RecordBatch.from_arrays([pa.array(x[listed[slot]]) for x in (h.astype(np.int32), key)], names=["h", "key"])

    w, r = (df.select("keys").mapInArrow(run, "h int, key long").groupBy("h", "key").agg(F.count("*").alias(n)) for df, n in ((windows, "w"), (reads, "r")))
    both = w.join(r, ["h", "key"]).withColumn("n", F.col("w").cast("double") * F.col("r")).filter(F.col("n") >= least)
    return [(r["h"], r["key"]) for r in both.orderBy(F.desc("n"), "h", "key").limit(HEAVY).collect()]


def _marked(rows: DataFrame, heavy: list[tuple[int, int]], min_hits: int, large: np.ndarray) -> DataFrame:
    """The ids, ``h, key, mask`` (bits of the row's heavy buckets), ``light`` (0 in a heavy one) and ``large`` (by slot). Each row is left out of its min_hits - 1 heaviest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h, key, slot = _flat_keys(batch)
            bit = np.zeros(len(row), dtype=np.int64)
            for i, (a, b) in enumerate(heavy):
                bit[(h == a) & (key == b)] = 1 << i
            mask = np.zeros(batch.num_rows, dtype=np.int64)
            some = np.flatnonzero(bit)
            np.bitwise_or.at(mask, row[some], bit[some])
            kept = mask.copy()
            for _ in range(min(min_hits - 1, len(heavy))):  # the lowest bit is the heaviest bucket
                kept &= kept - 1
            take = np.flatnonzero((bit == 0) | (kept[row] & bit != 0))
            own = [batch.column(n).take(pa.array(row[take])) for n in ids]
            new = [h[take].astype(np.int32), key[take], mask[row[take]], (bit[take] == 0).astype(np.int32), large[slot[take]]]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, new)], names=[*ids, "h", "key", "mask", "light", "large"])

    ids = [n for n in rows.columns if n != "keys"]
    new = [T.StructField(n, t) for n, t in (("h", T.IntegerType()), ("key", T.LongType()), ("mask", T.LongType()), ("light", T.IntegerType()), ("large", T.BooleanType()))]
    return rows.mapInArrow(run, T.StructType([*(rows.schema[i] for i in ids), *new]))


def _spread_buckets(windows: DataFrame, reads: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_w`` and ``_r``: a bucket with more than ``block`` entries on a side is cut into as many parts as it takes, each met by every part of the other side."""
    by = ["h", "key"]

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.filter("large").groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > block).select(*by, F.ceil(F.col("n") / block).cast("int").alias(name))

    # few keys: each stands for more than ``block`` rows
    cut_keys = parts(windows, "w").join(parts(reads, "r"), by, "full").select(*by, F.coalesce("w", F.lit(1)).alias("w"), F.coalesce("r", F.lit(1)).alias("r"))

    def cut_up(df: DataFrame, own: str, other: str, of: Column) -> DataFrame:
        sized = df.join(F.broadcast(cut_keys), by, "left").withColumn("w", F.coalesce("w", F.lit(1))).withColumn("r", F.coalesce("r", F.lit(1)))
        return sized.withColumn(f"_{own}", F.pmod(of, F.col(own)).cast("int")).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("w", "r")

    return cut_up(windows, "w", "r", F.xxhash64("chrom_id", "pos")), cut_up(reads, "r", "w", F.xxhash64("read_id"))


def _as_rows(signatures: DataFrame, ids: list[str]) -> DataFrame:
    """``ids, keys`` of signatures in either form; a bucket counts once, and a hash function that an id lacks has a null key."""
    if "keys" in signatures.columns:
        return signatures
    held = signatures.groupBy(*ids).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("h", "key")))).alias("m"))
    return held.select(*ids, F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda h: F.try_element_at("m", h)).alias("keys"))


def _met(window_rows: DataFrame, read_rows: DataFrame, min_hits: int, block: int, heavy: int) -> DataFrame:
    """A row for each window, read and bucket in which they are joined, with ``light`` (1 unless the bucket is heavy) and ``both``, the number of heavy buckets they share."""
    counts = _slot_counts(window_rows), _slot_counts(read_rows)
    common = _heavy(window_rows, read_rows, counts[0].astype(float) * counts[1], heavy)
    left, right = (_marked(rows, common, min_hits, count > block) for rows, count in zip((window_rows, read_rows), counts))
    if max(x.max(initial=0) for x in counts) > block:
        left, right = _spread_buckets(left, right, block)
    by = [c for c in ("h", "key", "_w", "_r") if c in left.columns]
    met = left.drop("large").join(right.drop("light", "large").withColumnRenamed("mask", "other"), by)
    return met.withColumn("both", F.bit_count(F.col("mask").bitwiseAND(F.col("other"))))


def candidates(window_signatures: DataFrame, read_signatures: DataFrame, most: int = 65_535, min_hits: int = 4, mode: str = "all", block: int = 8192, heavy: int = 1 << 14, only: Column | None = None) -> DataFrame:
    """``chrom_id, pos, read_id, hits``: windows and reads that meet in at least ``min_hits`` of their buckets.

    Signatures: as from ``signature_rows`` or ``minhash``, a key for each window or read and hash function. mode ``all``: every read of a bucket counts. Two that meet min_hits times also meet
    in a bucket that is not among the min_hits - 1 heaviest of either, so in those they aren't joined: which heavy buckets (of ``heavy`` pairs or more) they share is counted from the bits
    of a mask. A bucket of more than ``block`` entries on either side is joined in parts. ``truncate`` and ``drop`` cut buckets of more than ``most`` reads (J8).
    only: a condition on other columns of the signatures; pairs that don't meet it may be left out.
    """
    at, read = ["chrom_id", "pos"], ["read_id"]
    # made by Python and read more than once
    window_rows, read_rows = cut(_as_rows(window_signatures, at), "window-signatures"), cut(_as_rows(read_signatures, read), "read-signatures")
    if mode != "all":
        left, right = _entries(window_rows, at).filter("key IS NOT NULL"), _entries(read_rows, read).filter("key IS NOT NULL")
        met = left.join(capped(right, most, mode), ["h", "key"])
        return met.groupBy("chrom_id", "pos", "read_id").agg(F.count("*").alias("hits")).filter(F.col("hits") >= min_hits)
    met = _met(window_rows, read_rows, min_hits, block, heavy)
    return (met if only is None else met.filter(only)).groupBy("chrom_id", "pos", "read_id").agg((F.sum("light") + F.max("both")).alias("hits")).filter(F.col("hits") >= min_hits)


def kmer_lists(seq: Column | str, k: int, unique: bool = False) -> Column:
    """A4: the (different) canonical k-mers of a text, in order."""
    from ..functions.sequence import canonical_kmers

    out = canonical_kmers(seq, k)
    return F.array_sort(F.array_distinct(out) if unique else out)
