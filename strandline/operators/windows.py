"""Windows of a genome."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import bounded, flat_bytes
from ..functions.sequence import extend_window
from ..shared import cut, shuffle_partitions
from .prefix import prefix_sums


def load_genome(genome: DataFrame) -> DataFrame:
    """Distinct records, upper case, with their true length; a null sequence is empty. ``name`` stays whole."""
    rows = genome.select("chrom_id", "name", F.upper(F.coalesce("seq", F.lit(""))).alias("seq"), "profile_id").distinct()
    return rows.withColumn("len", F.length("seq"))


def window_counts(genome: DataFrame, k: int, w: int) -> DataFrame:
    """Windows of each chromosome, and how many come before it in order of chrom_id."""
    n = genome.select("chrom_id", F.ceil(F.col("len") / (w - k + 1)).cast("int").alias("n_windows"))
    return prefix_sums(n, "chrom_id", "n_windows", exclusive="first_window")


def _tiled(size: int, overlap: int):
    """Each text in tiles of ``size`` characters, each with the ``overlap`` characters after it, cut in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "seq", 1 << 22):
            raw, offsets = flat_bytes(batch.column("seq"))
            letter = (raw & 0xC0) != 0x80
            # where each character begins; a byte is a character in nearly every text
            place = None if letter.all() else np.append(np.flatnonzero(letter), len(raw))
            bounds = offsets if place is None else np.searchsorted(place, offsets)
            length = np.diff(bounds)
            count = -(-length // size)
            row = np.repeat(np.arange(len(count)), count)
            tile = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            first = bounds[:-1][row] + tile * size
            last = np.minimum(first + size + overlap, bounds[1:][row])
            if place is not None:
                first, last = place[first], place[last]
            step = max(1, (1 << 22) // (size + overlap))
            for at in range(0, len(row), step):
                part = slice(at, at + step)
                n = last[part] - first[part]
                ends = np.concatenate([[0], np.cumsum(n)])
                take = np.arange(ends[-1]) + np.repeat(first[part] - ends[:-1], n)
                texts = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(raw[take].tobytes()))
                chrom = batch.column("chrom_id").take(pa.array(row[part]))
                yield pa.RecordBatch.from_arrays([chrom, pa.array(tile[part].astype(np.int32)), pa.array(length[row[part]].astype(np.int32)), texts.cast(pa.string())], names=["chrom_id", "tile", "len", "text"])

    return run


def tiles(genome: DataFrame, size: int, overlap: int) -> DataFrame:
    """``chrom_id, tile, len, text``: each sequence in tiles of ``size`` letters and the ``overlap`` letters after each; len is that of the whole. Empty sequences have none."""
    schema = T.StructType([genome.schema["chrom_id"], T.StructField("tile", T.IntegerType()), T.StructField("len", T.IntegerType()), T.StructField("text", T.StringType())])
    return genome.select("chrom_id", "seq").mapInArrow(_tiled(size, overlap), schema)


def longest(df: DataFrame, text: str = "seq") -> int:
    """The length of the longest text; 0 if there is none."""
    return df.agg(F.max(F.length(text))).first()[0] or 0


def with_stretch(df: DataFrame, genome: DataFrame, start: Column | str, length: Column | int, name: str, most: int, least_tile: int = 4096) -> DataFrame:
    """``df`` (with chrom_id) and ``name``: the ``length`` letters of its chromosome from ``start`` (0-based, not negative), fewer at the end, none beyond it.

    most: no length is greater. Rows meet tiles of the genome, not chromosomes, so no row carries a chromosome and a chromosome is no hot key.
    """
    size = max(least_tile, 1 << max(0, most - 1).bit_length())
    start = F.col(start) if isinstance(start, str) else start
    asked = df.withColumn("_start", start.cast("int")).withColumn("_tile", F.expr(f"_start div {size}").cast("int"))
    held = tiles(genome, size, min(size, 2 * max(most, 1))).select(F.col("chrom_id").alias("_c"), F.col("tile").alias("_t"), F.col("text").alias("_text"))
    joined = asked.join(held, (F.col("chrom_id") == F.col("_c")) & (F.col("_tile") == F.col("_t")), "left")
    count = F.lit(length) if isinstance(length, int) else length
    got = F.coalesce(F.substring("_text", F.col("_start") - F.col("_tile") * size + 1, count), F.lit(""))
    return joined.withColumn(name, got).drop("_start", "_tile", "_c", "_t", "_text")


def first_of_equal(genome: DataFrame, few: int = 1 << 18) -> DataFrame:
    """``chrom_id, seq, len`` of a loaded genome without the chromosomes that have the text of an earlier one: whatever is found on them is found earlier as well. An id with several texts stays."""
    held = cut(genome.select("chrom_id", "seq", "len"), "genome")
    texts = held.select("chrom_id", F.sha2("seq", 256).alias("text"))
    first = texts.groupBy("text").agg(F.min("chrom_id").alias("first"))
    single = texts.groupBy("chrom_id").agg(F.min("text").alias("text"), F.count("*").alias("n")).filter("n = 1")
    later = cut(single.join(first, "text").filter("chrom_id > first").select("chrom_id"), "equal-chromosomes")
    return held.join(F.broadcast(later) if later.limit(few + 1).count() <= few else later, "chrom_id", "left_anti")


def with_extended(found: DataFrame, reads: DataFrame, genome: DataFrame, w: int, longest_read: int, block: int = 1 << 16, least_tile: int = 4096) -> DataFrame:
    """Windows (chrom_id, pos) of ``w`` letters and reads (read_id, read_seq) that met, with ``read_len, ext_start, ext_len`` and ``window_seq``: the window widened by half the read's length on
    either side (W6). Pairs whose read is longer than that are left out.

    A pair's tile follows from pos alone and holds its widened window; a tile with more than ``block`` pairs is met in parts. found is read twice. The pairs come spread over all cores.
    """
    spark, half, by = found.sparkSession, longest_read // 2, ["chrom_id", "_tile"]
    size = max(least_tile, 1 << max(0, w + longest_read - 1).bit_length())
    placed = found.withColumn("_tile", F.expr(f"greatest(0, pos - {half}) div {size}").cast("int"))
    # few keys: each stands for more than ``block`` rows
    hot = F.broadcast(placed.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > block).select(*by, F.ceil(F.col("n") / block).cast("int").alias("_parts")))
    parts, keys = F.coalesce("_parts", F.lit(1)), [*by, "_part"]
    asked = placed.join(hot, by, "left").withColumn("_part", F.pmod(F.xxhash64("read_id", "pos"), parts).cast("int")).drop("_parts")
    asked = asked.join(reads, "read_id").repartition(max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism), *keys)
    held = tiles(genome, size, min(size, 2 * max(w + longest_read, 1))).withColumnRenamed("tile", "_tile").join(hot, by, "left")
    held = held.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    extended = extend_window("pos", w, F.expr("length(read_seq) div 2").cast("int"), "len")
    out = asked.join(held, keys).withColumn("e", extended).withColumn("read_len", F.length("read_seq")).filter("read_len <= e.len")
    window = F.substring("text", F.col("e.start") - F.col("_tile") * size + 1, F.col("e.len"))
    return out.select("read_id", "chrom_id", "pos", F.col("e.start").alias("ext_start"), F.col("e.len").alias("ext_len"), "read_len", "read_seq", window.alias("window_seq"))


def windows(genome: DataFrame, k: int, w: int, limit: int | None = None) -> DataFrame:
    """``chrom_id, window_id, pos, len, seq``: windows at a stride of w - k + 1; the last of a chromosome may be short.

    Chromosomes are first cut into tiles of 32 windows, so the work grows as their length. limit (W5): only the first so many in order of chromosome and position.
    """
    stride, many = w - k + 1, 32
    rest = F.col("len") - F.col("tile") * (many * stride)
    ids = F.sequence(F.lit(0), F.least(F.lit(many), F.ceil(rest / stride)).cast("int") - 1)
    out = tiles(genome, many * stride, k - 1).select("chrom_id", "tile", "text", F.explode(ids).alias("i"))
    out = out.select("chrom_id", (F.col("tile") * many + F.col("i")).alias("window_id"), F.substring("text", F.col("i") * stride + 1, F.lit(w)).alias("seq"))
    out = out.select("chrom_id", "window_id", (F.col("window_id") * stride).alias("pos"), "seq").withColumn("len", F.length("seq"))
    return out if limit is None else out.orderBy("chrom_id", "pos").limit(limit)


def wide_windows(genome: DataFrame, k: int, w: int, margin: int) -> DataFrame:
    """``chrom_id, pos, seq, wide``: windows as from ``windows``, and each with ``margin`` letters more on either side, where there are any (``-`` before the first)."""
    stride, many = w - k + 1, 32
    padded = genome.select("chrom_id", F.concat(F.lit("-" * margin), "seq").alias("seq"))
    rest = F.col("len") - margin - F.col("tile") * (many * stride)
    ids = F.sequence(F.lit(0), F.least(F.lit(many), F.ceil(rest / stride)).cast("int") - 1)
    out = tiles(padded, many * stride, k - 1 + 2 * margin).filter(rest > 0).select("chrom_id", "tile", "text", F.explode(ids).alias("i"))
    at = F.col("i") * stride + 1
    return out.select("chrom_id", ((F.col("tile") * many + F.col("i")) * stride).alias("pos"), F.substring("text", at + margin, F.lit(w)).alias("seq"), F.substring("text", at, F.lit(w + 2 * margin)).alias("wide"))


def numbered_windows(genome: DataFrame, k: int, w: int) -> DataFrame:
    """Windows with their number over the whole genome, in order of chrom_id."""
    return windows(genome, k, w).join(window_counts(genome, k, w).select("chrom_id", "first_window"), "chrom_id").withColumn("global_window_id", F.col("first_window") + F.col("window_id")).drop("first_window")


def window_batches(numbered: DataFrame, size: int) -> DataFrame:
    """A batch number for each window; a batch is of one chromosome and at most ``size`` windows."""
    return numbered.withColumn("batch", F.expr(f"window_id div {size}").cast("int"))
