"""Loading delimited text lines with broken rows set apart (problem 2).

A line goes through a quote-aware finite-state tokenizer. Lines are cut into chunks of bounded size. Of a line
with several chunks each chunk is first turned into its transition map (state before -> state after), whatever
state it may start in; the maps are composed in chunk order, which gives the true state at the start of each
chunk, and then all chunks are tokenized side by side, wherever they lie. Lines of one chunk, nearly all, start
in the known state and need neither the first pass nor a shuffle.

States: 0 field start, 1 bare field, 2 inside quotes, 3 quote seen inside quotes, 4 error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import bounded, flat_bytes
from ..shared import cut

START, BARE, QUOTED, CLOSING, BROKEN = range(5)
CHUNK = 4096
FIELDS = ("record_no", "header", "seq", "qual", "seq_len")

#: _NEXT[state, class]; classes: 0 other, 1 comma, 2 quote
_NEXT = np.array([[BARE, START, QUOTED], [BARE, START, BROKEN], [QUOTED, QUOTED, CLOSING], [BROKEN, START, QUOTED], [BROKEN] * 3], dtype=np.uint8)
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord(",")], _CLASS[ord('"')] = 1, 2


def _walk(classes: np.ndarray, offsets: np.ndarray, state: np.ndarray, each: np.ndarray | None) -> np.ndarray:
    """End states of all rows: one step per character position, over every row still that long.

    state: (rows,) or (rows, starts). each, if given, receives the state after each byte.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, state, longest = offsets[:-1][order], state[order], -np.sort(-lengths)
    active = len(order)
    table = _NEXT.ravel()
    for at in range(int(longest[0]) if len(order) else 0):
        while active and longest[active - 1] <= at:
            active -= 1
        c = classes[starts[:active] + at]
        state[:active] = table[state[:active] * np.uint8(3) + (c if state.ndim == 1 else c[:, None])]
        if each is not None:
            each[starts[:active] + at] = state[:active]
    out = np.empty_like(state)
    out[order] = state
    return out


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: each chunk's transition map, three bits for each start state."""
    for batch in bounded(batches, "chunk"):
        raw, offsets = flat_bytes(batch.column("chunk"))
        ends = _walk(_CLASS[raw], offsets, np.tile(np.arange(5, dtype=np.uint8), (batch.num_rows, 1)), None)
        packed = sum(ends[:, s].astype(np.int32) << 3 * s for s in range(5))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.int32())], names=[*batch.schema.names, "map"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second pass: the (parts of) fields of each chunk, unquoted, from its true start state."""
    for batch in bounded(batches, "chunk"):
        raw, offsets = flat_bytes(batch.column("chunk"))
        first = batch.column("start_state").to_numpy(zero_copy_only=False).astype(np.uint8)
        n, classes = batch.num_rows, _CLASS[raw]
        if not n:
            continue
        after = np.empty(len(raw), dtype=np.uint8)
        ends = _walk(classes, offsets, first.copy(), after)
        before = np.empty_like(after)
        before[1:] = after[:-1]
        some = np.flatnonzero(np.diff(offsets))
        before[offsets[:-1][some]] = first[some]
        keep = (after == BARE) | ((after == QUOTED) & ((before == QUOTED) | (before == CLOSING)))
        comma = after == START
        letters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # later bytes of a UTF-8 sequence don't count
        kept = np.concatenate([[0], np.cumsum(keep)])
        commas = np.concatenate([[0], np.cumsum(comma)])
        # a field ends at each separator and at the end of its chunk
        counts = commas[offsets[1:]] - commas[offsets[:-1]] + 1
        row_end = np.cumsum(counts)
        ends_at = np.empty(int(row_end[-1]), dtype=np.int64)
        last = np.zeros(len(ends_at), dtype=bool)
        last[row_end - 1] = True
        ends_at[last], ends_at[~last] = offsets[1:], np.flatnonzero(comma)
        begins = np.empty_like(ends_at)
        begins[1:] = ends_at[:-1] + 1
        begins[row_end - counts] = offsets[:-1]
        bounds = np.concatenate([[0], kept[ends_at]]).astype(np.int64)
        values = pa.LargeStringArray.from_buffers(len(ends_at), pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw[keep].tobytes()))
        lists = pa.array(np.concatenate([[0], row_end]).astype(np.int32))
        at = (letters[begins] - np.repeat(letters[offsets[:-1]], counts)).astype(np.int32)
        broken = np.full(n, -1, dtype=np.int32)
        bad = np.flatnonzero((after == BROKEN) & (before != BROKEN))
        row = np.searchsorted(offsets, bad, side="right") - 1
        broken[row] = letters[bad] - letters[offsets[row]]
        more = [pa.ListArray.from_arrays(lists, values.cast(pa.string())), pa.ListArray.from_arrays(lists, pa.array(at)), pa.array(ends.astype(np.int32)), pa.array(broken), pa.array(np.diff(letters[offsets]).astype(np.int32))]
        names = ["fields", "field_at", "end_state", "broken_at", "n_letters"]
        have = [x for x in batch.schema.names if x not in ("chunk", "start_state")]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in have), *more], names=[*have, *names])


def _scanned(df: DataFrame) -> DataFrame:
    had = [f for f in df.schema.fields if f.name not in ("chunk", "start_state")]
    ints = T.ArrayType(T.IntegerType())
    new = [T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("field_at", ints), *(T.StructField(x, T.IntegerType()) for x in ("end_state", "broken_at", "n_letters"))]
    return df.mapInArrow(_tokens, T.StructType([*had, *new]))


def _chunked(size: int):
    """Each line's chunks of at most ``size`` characters, cut in one pass over its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "line"):
            raw, offsets = flat_bytes(batch.column("line"))
            for row in range(batch.num_rows):
                text = raw[offsets[row] : offsets[row + 1]]
                begins = np.flatnonzero((text & 0xC0) != 0x80)[::size]
                chunks = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(text)).astype(np.int64).tobytes()), pa.py_buffer(text.tobytes()))
                for at in range(0, len(chunks), 256):  # batches of bounded size, however long the line
                    part = chunks.slice(at, 256)
                    n = len(part)
                    key = pa.array([batch.column("line_key")[row].as_py()] * n, pa.string())
                    yield pa.RecordBatch.from_arrays([key, pa.array(np.arange(at, at + n, dtype=np.int32)), part.cast(pa.string())], names=["line_key", "chunk_no", "chunk"])

    return run


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _composed(maps: pd.Series) -> pd.Series:
    """The state at the start of each chunk of a line, from the chunks' maps in order."""

    def states(each) -> list[int]:
        state, out = START, []
        for m in each:
            out.append(state)
            state = int(m) >> 3 * state & 7
        return out

    return maps.map(states)


def _long_lines(text: DataFrame, chunk: int) -> DataFrame:
    """Lines of several chunks (line_key, rest, line): map, compose, tokenize, put together. ``line_key`` names a row, so equal rows stay apart."""
    key = ["line_key"]
    chunks = text.select("line_key", "line").mapInArrow(_chunked(chunk), "line_key string, chunk_no int, chunk string").repartition("line_key", "chunk_no")
    chunks = cut(chunks, "chunks")
    mapped = chunks.mapInArrow(_maps, T.StructType([*chunks.schema.fields, T.StructField("map", T.IntegerType())])).select("line_key", "chunk_no", "map")
    states = (
        mapped.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("chunk_no", "map"))).alias("maps"))
        .select("line_key", F.posexplode(_composed(F.col("maps.map"))).alias("chunk_no", "start_state"))
    )
    parts = _scanned(chunks.join(states, ["line_key", "chunk_no"]))
    order = Window.partitionBy("line_key").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("field_no", F.coalesce(F.sum(F.size("fields") - 1).over(order), F.lit(0))).withColumn("line_at", F.coalesce(F.sum("n_letters").over(order), F.lit(0)))
    fields = (
        placed.select("line_key", "chunk_no", "field_no", "line_at", F.posexplode(F.arrays_zip("fields", "field_at")).alias("i", "x"))
        .groupBy("line_key", (F.col("field_no") + F.col("i")).alias("field_no"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", F.col("x.fields").alias("part")))), lambda p: p["part"]), "").alias("field"), F.min(F.col("line_at") + F.col("x.field_at")).cast("int").alias("at"))
        .groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("field_no", "field", "at"))).alias("all"))
    )
    lines = placed.groupBy(*key).agg(
        F.max_by("end_state", "chunk_no").alias("end_state"), F.sum("n_letters").cast("int").alias("n_letters"),
        F.min(F.when(F.col("broken_at") >= 0, F.col("line_at") + F.col("broken_at"))).cast("int").alias("broken_at"),
    )
    whole = text.select("line_key", "rest").join(lines, key).join(fields, key)
    return whole.select("rest", F.col("all.field").alias("fields"), F.col("all.at").alias("field_at"), "end_state", F.coalesce("broken_at", F.lit(-1)).alias("broken_at"), "n_letters")


def tokenize_lines(lines: DataFrame, line: str, chunk: int = CHUNK) -> DataFrame:
    """Each row's line as ``rest`` (a struct of the other columns), ``fields, field_at, broken_at, n_letters``.

    fields: the unquoted values. field_at: where each field begins, in characters from 0. broken_at: the first
    character that breaks the quoting rules (the line's length where a quote is never closed), else -1. A null line
    has null fields; an empty one has one empty field. Lines longer than ``chunk`` characters are cut up and their
    chunks spread over the cluster. Every row comes out, equal ones as often as they came in.
    """
    others = [F.col(f"`{c}`") for c in lines.columns if c != line] or [F.lit(True).alias("no_other")]
    text = lines.select(F.struct(*others).alias("rest"), F.col(f"`{line}`").alias("line"))
    short = text.filter(F.col("line").isNull() | (F.length("line") <= chunk)).select("rest", F.col("line").isNull().alias("none"), F.col("line").alias("chunk"), F.lit(START).alias("start_state"))
    short = _scanned(short).select("rest", *(F.when(~F.col("none"), F.col(c)).alias(c) for c in ("fields", "field_at")), "end_state", "broken_at", "n_letters")
    # a name for each long row, made once and kept in the shared folder
    long = cut(text.filter(F.length("line") > chunk).select(F.expr("uuid()").alias("line_key"), "rest", "line"), "long-lines")
    both = short if long.isEmpty() else short.unionByName(_long_lines(long, chunk))
    return both.select("rest", "fields", "field_at", F.when(F.col("broken_at") >= 0, F.col("broken_at")).when(F.col("end_state") == QUOTED, F.col("n_letters")).otherwise(-1).alias("broken_at"), "n_letters")


def _matches(column: Column, pattern: str) -> Column:
    return column.rlike(rf"\A(?:{pattern})\z")


def parse_read_lines(lines: DataFrame, line: str = "line", chunk: int = CHUNK) -> DataFrame:
    """Every line as a typed record, or with the reason why it can't be one.

    Result: the other columns of ``lines`` (one that clashes with a new name gets the suffix ``_in``), then
    ``record_no DECIMAL(38,0), header, seq, qual STRING, seq_len INT`` (null where a reason is given), ``reason`` (null
    for a good line) and ``error_at``, the character from which the reason holds. Reasons, the first that applies:
    quoting, columns (a null line too, at 0), record_no, header, seq, qual, seq_len. A record number of more than
    38 digits is valid but has no value. No row is lost and none merged, however long or often repeated.
    """
    tokens = tokenize_lines(lines, line, chunk)
    no, header, seq, qual, size = (F.coalesce(F.get("fields", F.lit(i)), F.lit("")) for i in range(5))
    good_qual = F.when(header.startswith(">"), qual == "").otherwise((F.length(qual) == F.length(seq)) & _matches(qual, "[!-~]*"))
    checks = [
        ("quoting", F.col("broken_at") < 0, F.col("broken_at")),
        ("columns", F.coalesce(F.size("fields") == 5, F.lit(False)), F.coalesce(F.get("field_at", F.lit(5)) - 1, F.col("n_letters"))),
        ("record_no", _matches(no, "[0-9]+"), F.get("field_at", F.lit(0))),
        ("header", _matches(header, r"(?s)[@>][^ ].*"), F.get("field_at", F.lit(1))),
        ("seq", _matches(seq, "[ACGTNacgtn]+"), F.get("field_at", F.lit(2))),
        ("qual", good_qual, F.get("field_at", F.lit(3))),
        ("seq_len", _matches(size, "[0-9]{1,9}") & (F.coalesce(size.try_cast("int"), F.lit(-1)) == F.length(seq)), F.get("field_at", F.lit(4))),
    ]
    reason = error = None
    for name, good, at in checks:
        bad = ~good
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
        error = F.when(bad, at) if error is None else error.when(bad, at)
    fine = tokens.withColumn("reason", reason).withColumn("error_at", error)
    new = [
        *(F.when(F.col("reason").isNull(), x).alias(n) for x, n in ((no.try_cast("decimal(38,0)"), "record_no"), (header, "header"), (seq, "seq"), (qual, "qual"), (size.try_cast("int"), "seq_len"))),
        "reason", "error_at",
    ]
    taken = {*FIELDS, "reason", "error_at"}
    others = [F.col(f"rest.`{c}`").alias(f"{c}_in" if c in taken else c) for c in lines.columns if c != line]
    return fine.select(*others, *new)
