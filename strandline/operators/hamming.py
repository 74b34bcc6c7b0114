"""Shifted Hamming distance of reads against windows (L13), the best hit of each read (A8), and the mapping plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import BASE_CODE, bounded, flat_bytes
from ..functions.sequence import clean_reads
from ..shared import cut, spread
from .minhash import candidates, signature_rows
from .windows import first_of_equal, longest, wide_windows, with_extended

FORWARD, REVERSED, NONE = 1, 2, 3
#: letters on end that are counted; how far around windows at most
SPAN, MARGIN = 32, 1024
_PAIR = str.maketrans("ACGT", "TGCA")
_OTHER = np.arange(256, dtype=np.uint8)
_OTHER[[*b"ACGT"]] = [*b"TGCA"]


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a string column as bytes, padded with 0; and their lengths."""
    raw, offsets = flat_bytes(column)
    length = np.diff(offsets)
    out = np.zeros((len(length), int(length.max(initial=0))), dtype=np.uint8)
    out[np.arange(out.shape[1]) < length[:, None]] = raw
    return out, length


def _reverse_complements(column: pa.Array, reads: np.ndarray, length: np.ndarray) -> np.ndarray:
    """F8 of the texts of a column, of which ``reads`` and ``length`` are the matrix, padded with 0 as well."""
    if reads.max(initial=0) >= 128:  # a letter may be several bytes
        return matrix(pa.array([(x or "").translate(_PAIR)[::-1] for x in column.to_pylist()], pa.large_string()))[0]
    place = length[:, None] - 1 - np.arange(reads.shape[1])
    return np.where(place >= 0, _OTHER[np.take_along_axis(reads, np.maximum(place, 0), axis=1)], 0).astype(np.uint8)


def _planes(codes: np.ndarray, bits: int, words: int) -> np.ndarray:
    """Each bit of rows of codes, 64 letters a word: bit, word, row."""
    out = np.zeros((bits, len(codes), 8 * words), dtype=np.uint8)
    for i in range(bits):
        packed = np.packbits(codes >> i & 1, axis=1, bitorder="little")
        out[i, :, : packed.shape[1]] = packed
    return np.ascontiguousarray(out.view("<u8").transpose(0, 2, 1))


def _distances(window: np.ndarray, w_len: np.ndarray, reads: list[np.ndarray], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each of ``reads`` (codes of ``bits`` bits, all of one length) the least distance over all shifts with full overlap, and the first shift that has it."""
    length = reads[0].shape[1]
    words = -(-length // 64)
    held, asked = _planes(window, bits, -(-window.shape[1] // 64) + words + 1), [_planes(x, bits, words) for x in reads]
    inside = _planes(np.ones((1, length), dtype=np.uint8), 1, words)[0]
    # distance and shift in one number
    best = [np.full(len(window), 1 << 52, dtype=np.int64) for _ in reads]
    fewest = int(w_len.min(initial=0))
    for shift in range(int(w_len.max(initial=-1)) - length + 1):
        at, low = divmod(shift, 64)
        part = held[:, at : at + words]
        if low:
            part = (part >> np.uint64(low)) | (held[:, at + 1 : at + words + 1] << np.uint64(64 - low))
        full = True if shift + length <= fewest else shift + length <= w_len
        for least, own in zip(best, asked):
            apart = part[0] ^ own[0]
            for i in range(1, bits):
                apart |= part[i] ^ own[i]
            d = np.bitwise_count(apart & inside).sum(axis=0, dtype=np.int64)
            np.minimum(least, d << 32 | shift, out=least, where=full)
    return [(x >> 32, x & 0xFFFFFFFF) for x in best]


def _blocks(length: int, most: int) -> int:
    """Letters in each of ``most + 1`` equal blocks of a read; 0 where there are none."""
    return length // (most + 1) if most >= 0 else 0


def _packed(codes: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` (at most 16) two-bit codes from each place of each row in one number."""
    power, width, out, have, n = codes.astype(np.uint32), 1, None, 0, codes.shape[1] - size + 1
    while True:
        if size & width:
            out = power if out is None else (out[:, : power.shape[1] - have] << np.uint32(2 * width)) | power[:, have:]
            have += width
        if have == size:
            return out[:, :n]
        power = (power[:, : power.shape[1] - width] << np.uint32(2 * width)) | power[:, width:]
        width *= 2


def _near(window: np.ndarray, w_len: np.ndarray, reads: list[np.ndarray], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """As ``_distances`` on letters, where the distance is at most ``most``; greater ones may come out as 1 << 20.

    With so few errors one of most + 1 blocks of the read has none, so letters are compared only at shifts where a block is found.
    """
    length = reads[0].shape[1]
    block, shifts = _blocks(length, most), window.shape[1] - length + 1
    if shifts <= 0:
        return [(np.full(len(window), 1 << 20), np.zeros(len(window), np.int64)) for _ in reads]
    size = min(16, block)
    # letters beside bases share the code of a base: more shifts are compared, none is lost
    held, texts, out = _packed(BASE_CODE[window] & 3, size), np.lib.stride_tricks.sliding_window_view(window, length, axis=1), []
    for read in reads:
        own, some = _packed(BASE_CODE[read] & 3, size), np.zeros((len(window), shifts), dtype=bool)
        for at in range(0, (most + 1) * block, block):
            some |= held[:, at : at + shifts] == own[:, at : at + 1]
        row, shift = np.nonzero(some)
        fits = shift + length <= w_len[row]
        row, shift = row[fits], shift[fits]
        # distance and shift in one number
        best = np.full(len(window), 1 << 52, dtype=np.int64)
        step = max(1, (1 << 20) // length)
        for a in range(0, len(row), step):
            r, at = row[a : a + step], shift[a : a + step]
            np.minimum.at(best, r, np.count_nonzero(texts[r, at] != read[r], axis=1) << 32 | at)
        out.append((best >> 32, best & 0xFFFFFFFF))
    return out


def _shifted(ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "window_seq"):
            names = batch.schema.names
            window, w_len = matrix(batch.column(names.index("window_seq")))
            fwd, r_len = matrix(batch.column(names.index("read_seq")))
            back = _reverse_complements(batch.column(names.index("read_seq")), fwd, r_len)
            n = batch.num_rows
            limit = np.floor(r_len.astype(np.float32) * np.float32(ratio)).astype(np.int64)
            # the bytes of the batch by number: few bits tell them apart
            seen = sum(np.bincount(x.ravel(), minlength=256) for x in (window, fwd, back)) > 0
            code = (np.cumsum(seen) - 1).astype(np.uint8)
            bits = max(1, int(seen.sum() - 1).bit_length())
            hd, shift, strand = np.full(n, 1 << 20, np.int64), np.zeros(n, np.int64), np.full(n, NONE, np.int64)
            for length in np.unique(r_len):  # reads of one length at a time: nothing is padded
                rows = np.flatnonzero(r_len == length)
                most = int(limit[rows[0]])
                for part in np.array_split(rows, 1 + len(rows) * window.shape[1] // 500_000):
                    long = int(w_len[part].max(initial=0))
                    near, asked = window[part, :long], [fwd[part, :length], back[part, :length]]
                    # blocks of fewer letters are found nearly everywhere
                    found = _near(near, w_len[part], asked, most) if _blocks(length, most) >= 8 else _distances(code[near], w_len[part], [code[x] for x in asked], bits)
                    (a, at_a), (b, at_b) = found
                    hd[part], shift[part] = np.minimum(a, b), np.where(b < a, at_b, at_a)
                    strand[part] = np.where(b < a, REVERSED, FORWARD)
            good = hd <= limit
            null = ~good
            new = [pa.array(np.where(good, strand, NONE).astype(np.int8)), pa.array(hd.astype(np.int32), mask=null), pa.array(shift.astype(np.int32), mask=null)]
            keep = [x for x in names if x not in ("window_seq", "read_seq")]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(x)) for x in keep), *new], names=[*keep, "orientation", "hamming", "shift"])

    return run


def shifted_hamming(pairs: DataFrame, ratio: float, even: bool = False) -> DataFrame:
    """Pairs with ``window_seq`` and ``read_seq`` become ``orientation, hamming, shift`` beside their other columns.

    Forward before reverse complement and the lowest shift at ties. Above int(length * ratio), or if the read is longer than the
    window, the orientation is 3 and the others are null. Pairs with a null text, and empty reads, count as not hit. even: pairs are spread over the cores already.
    """
    asked = pairs if even else spread(pairs)
    keep = [f for f in pairs.schema.fields if f.name not in ("window_seq", "read_seq")]
    new = [T.StructField("orientation", T.ByteType()), T.StructField("hamming", T.IntegerType()), T.StructField("shift", T.IntegerType())]
    return asked.mapInArrow(_shifted(ratio), T.StructType([*keep, *new]))


def densest(column: pa.Array, short: int) -> np.ndarray:
    """For each text the most of each of A, C, G and T in any SPAN letters on end; ``short`` where it has fewer letters, SPAN if letters may be several bytes."""
    raw, offsets = flat_bytes(column)
    n = len(offsets) - 1
    if raw.max(initial=0) >= 128:
        return np.full((n, 4), SPAN, dtype=np.int64)
    out = np.full((n, 4), short, dtype=np.int64)
    rows = np.flatnonzero(np.diff(offsets) >= SPAN)
    if len(rows):
        places = np.arange(len(raw) - SPAN + 1)
        inside = places + SPAN <= np.repeat(offsets[1:], np.diff(offsets))[: len(places)]
        for i, letter in enumerate(b"ACGT"):
            before = np.concatenate([[0], np.cumsum(raw == letter, dtype=np.int32)])
            out[rows, i] = np.maximum.reduceat((before[SPAN:] - before[:-SPAN]) * inside, offsets[:-1][rows])
    return out


def _with_density(text: str, ratio: float | None):
    """``text`` gives way to ``have``, its densest stretches (a byte a letter), or for reads (with a ratio) to what a window must have for a hit: ``need``, and ``turned`` for the other strand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text):
            column = batch.column(batch.schema.names.index(text))
            keep = [x for x in batch.schema.names if x != text or ratio is not None]
            if ratio is None:
                new = {"have": densest(column, SPAN)}
            else:
                errors = np.floor(np.diff(flat_bytes(column)[1]).astype(np.float32) * np.float32(ratio)).astype(np.int64)
                need = np.clip(densest(column, 0) - errors[:, None], 0, SPAN)
                # a text of other letters than bytes says nothing
                need = need if flat_bytes(column)[0].max(initial=0) < 128 else np.zeros_like(need)
                new = {"need": need, "turned": need[:, ::-1]}
            packed = [pa.array((x << np.array([0, 8, 16, 24])).sum(axis=1)) for x in new.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(x)) for x in keep), *packed], names=[*keep, *new])

    return run


def with_density(df: DataFrame, text: str, ratio: float | None = None) -> DataFrame:
    keep = [f for f in df.schema.fields if f.name != text or ratio is not None]
    return df.mapInArrow(_with_density(text, ratio), T.StructType([*keep, *(T.StructField(x, T.LongType()) for x in (("have",) if ratio is None else ("need", "turned")))]))


def may_hit() -> Column:
    """Whether a window that has ``have`` can be hit by a read of ``need, turned``: any SPAN letters of a read lie on as many of the window, which differ in no more letters than a hit may."""
    high = 0x80808080  # no byte borrows from the next: all are at least those of the read
    return F.expr(f"((have | {high}L) - need) & {high}L = {high}L OR ((have | {high}L) - turned) & {high}L = {high}L")


def best_hits(hits: DataFrame) -> DataFrame:
    """One hit of each read: least distance, then the first chromosome and window."""
    order = F.struct("hamming", "chrom_id", "pos", "orientation", "shift", *(c for c in hits.columns if c not in ("read_id", "hamming", "chrom_id", "pos", "orientation", "shift")))
    return hits.filter(F.col("orientation") != NONE).groupBy("read_id").agg(F.min(order).alias("_b")).select("read_id", "_b.*")


def map_reads(reads: DataFrame, genome: DataFrame, k: int = 16, w: int = 128, hashes: int = 16, min_hits: int = 4, ratio: float = 0.05, most: int = 65_535, mode: str = "all") -> DataFrame:
    """The mapping plan: ``read_id, hamming, chrom_id, pos, orientation, shift, ext_start, ext_len, read_len`` of each read that is hit.

    genome: as from load_genome. reads: read_id, file_id, read_id_in_file, seq, each read once. Windows and reads meet by minhash; a window is extended by half the
    read's length on either side, and the read slides along it. pos is the window's position; the hit begins at ext_start + shift.
    """
    genome = first_of_equal(genome)
    cleaned = cut(clean_reads(reads.filter(F.col("seq").isNotNull())).select("read_id", F.col("clean").alias("seq")), "cleaned-reads")
    longest_read = longest(cleaned)
    wide = with_density(wide_windows(genome, k, w, min(longest_read // 2, MARGIN)), "wide")
    if longest_read // 2 > MARGIN:  # windows are widened farther than was looked
        wide = wide.withColumn("have", F.lit(SPAN * 0x01010101).cast("long"))
    sides = signature_rows(wide, ["chrom_id", "pos", "have"], "seq", k, hashes), signature_rows(with_density(cleaned, "seq", ratio), ["read_id", "need", "turned"], "seq", k, hashes)
    found = candidates(*sides, most, min_hits, mode, only=may_hit())
    pairs = with_extended(cut(found.drop("hits"), "candidates"), cleaned.withColumnRenamed("seq", "read_seq"), genome, w, longest_read)
    return best_hits(shifted_hamming(pairs, ratio, even=True))
