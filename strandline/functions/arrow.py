"""Flat numpy views of Arrow columns, for code that runs inside mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: two-bit codes of the bases in either case; 255 for everything else
BASE_CODE = np.full(256, 255, dtype=np.uint8)
for _code, _letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
    for _letter in _letters:
        BASE_CODE[ord(_letter)] = _code


def bounded(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices that hold at most ``limit`` bytes (of a text column) or values (of a list column), or one row: memory doesn't depend on how long rows are."""
    for batch in batches:
        x = batch.column(batch.schema.names.index(column))
        size = pc.list_value_length(x) if pa.types.is_list(x.type) or pa.types.is_large_list(x.type) else pc.binary_length(x)
        ends, at, done = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(at, stop - at)
            at, done = stop, int(ends[stop - 1])


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def flat_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base codes of all rows, one for each character, with a 255 after each row; and where each row begins."""
    raw, offsets = flat_bytes(column)
    character = (raw & 0xC0) != 0x80
    if not character.all():
        counts = np.concatenate([[0], np.cumsum(character)])
        raw, offsets = raw[character], counts[offsets]
    codes = np.full(len(raw) + len(offsets) - 1, 255, dtype=np.uint8)
    codes[np.arange(len(raw)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = BASE_CODE[raw]
    return codes, offsets[:-1] + np.arange(len(offsets) - 1)


def code_pieces(column: pa.Array, overlap: int, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Base codes as from ``flat_codes``, where each row begins, its number, and how many characters of it came before.

    Rows of more than ``limit`` characters are cut into pieces that share ``overlap``: of a window of overlap + 1 characters, every start lies in exactly one piece.
    """
    codes, begins = flat_codes(column)
    if len(codes) <= limit + overlap + len(begins) or len(begins) != 1:
        yield codes, begins, np.arange(len(begins)), 0
        return
    for at in range(0, len(codes) - 1, limit):
        piece = codes[at : min(at + limit + overlap, len(codes) - 1)]
        yield np.append(piece, np.uint8(255)), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), at


def packed_kmers(codes: np.ndarray, k: int) -> np.ndarray:
    """The k-mer that begins at each position, two bits a letter (k <= 32); meaningless where it holds a 255."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, width, out, have = (codes & 3).astype(np.uint64), 1, None, 0
    while True:
        if k & width:
            out = power if out is None else (out[: len(power) - have] << np.uint64(2 * width)) | power[have:]
            have += width
        if have == k:
            return out[:n]
        power = (power[: len(power) - width] << np.uint64(2 * width)) | power[width:]
        width *= 2


def clean_windows(codes: np.ndarray, length: int) -> np.ndarray:
    """Whether the window of ``length`` from each position holds bases only."""
    bad = np.concatenate([[0], np.cumsum(codes == 255, dtype=np.int64)])
    return bad[length:] == bad[:-length] if len(codes) >= length else np.zeros(0, dtype=bool)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (two rounds of multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
