"""Long exact spans shared between records (problem 3), by a log-structured index of window fingerprints.

Each stretch of ``length`` letters (a window) is represented by one of its seeds: the q-mer inside it with the least hash. Equal windows
have equal seeds, so a window shared by two records shows as a seed that both own. The index holds sorted, immutable,
bucketed runs of (seed, least owner, greatest owner), one file a bucket. A new batch of records becomes a run of its own; it is
merge-joined with every older run, bucket by bucket, without a shuffle or a sort of history. Seeds that now have two owners give
the places, new and old, to verify; runs of a level are compacted into one of the next when there are ``fan_in``.

Verification is exact: windows at those places, cut from tiles of their records, are compared by all their letters, packed two bits each. Nothing is compared
pairwise: a window is shared if the least and the greatest record that hold it differ.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrow import bounded, clean_windows, code_pieces, flat_codes, mix64, packed_kmers
from ..operators.windows import tiles
from ..shared import cut, remove, scratch, shuffle_partitions

TILE = 1 << 16


def seed_length(length: int) -> int:
    return min(32, (length + 1) // 2)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """For each position the leftmost index of the least of ``width`` values from there."""

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    best, have = np.arange(len(values)), 1
    while have * 2 <= width:
        best, have = better(best[: len(best) - have], best[have:]), have * 2
    rest = width - have
    return better(best[: len(best) - rest], best[rest:]) if rest else best


def _seeds(length: int):
    q = seed_length(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "seq"):
            for codes, begins, numbers, before in code_pieces(batch.column("seq"), length - 1):
                starts = np.flatnonzero(clean_windows(codes, length))
                if not len(starts):
                    continue
                kmers = packed_kmers(codes, q)
                at = _least(mix64(kmers), length - q + 1)[starts]
                new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(starts)]]) - 1
                row = np.searchsorted(begins, starts[first], side="right") - 1
                place = before - begins[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kmers[at[first]].view(np.int64)), batch.column("id").take(pa.array(numbers[row])), pa.array((starts[first] + place).astype(np.int32)), pa.array((starts[last] + place).astype(np.int32))],
                    names=["seed", "id", "first", "last"],
                )

    return run


def _windows(length: int, tile: int):
    """The letters of each clean window from first to last of each tile, as words of 32 letters (the last word ends with the window)."""
    q = min(32, length)
    words = [*range(0, length - q, q), length - q]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            codes, begins = flat_codes(batch.column("text"))
            kmers, clean = packed_kmers(codes, q), clean_windows(codes, length)
            ranges = batch.column("ranges")
            flat = ranges.flatten()
            row = np.repeat(np.arange(len(ranges)), ranges.value_lengths().to_numpy(zero_copy_only=False))
            before = batch.column("tile").to_numpy().astype(np.int64) * tile
            first = flat.field("first").to_numpy(zero_copy_only=False).astype(np.int64)
            count = flat.field("last").to_numpy(zero_copy_only=False) - first + 1
            row = np.repeat(row, count)
            start = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            place = begins[row] + start - before[row]
            # another row of the same id may end before that place, or hold no bases there; a 255 stands after each row
            good = place < np.append(begins[1:], len(codes))[row]
            good[good] = place[good] < len(clean)
            good[good] = clean[place[good]]
            row, start, place = row[good], start[good], place[good]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), pa.array(start.astype(np.int32)), *(pa.array(kmers[place + w].view(np.int64)) for w in words)], names=["id", "start", *(f"w{i}" for i in range(len(words)))])

    return run, [f"w{i}" for i in range(len(words))]


@contextmanager
def _runs_are_sorted(spark: SparkSession):
    """Scans of tables with one file a bucket keep the order of their files, so that a merge join needn't sort them."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class SpanIndex:
    """Seeds of all records so far. ``add`` takes new records and returns the places that became shared by them.

    The index lives in a folder: ``SpanIndex.open`` takes it up again in another session, to add to it and compact it. Each change leaves a new manifest
    of the runs and places that count; what a job that failed has written is in none.
    """

    def __init__(self, spark: SparkSession, length: int, fan_in: int = 4, folder: str | None = None):
        self.spark, self.length, self.fan_in = spark, length, fan_in
        self.folder = folder or scratch(spark, "spans")
        self.buckets = shuffle_partitions(spark)
        self.runs: list[tuple[int, str]] = []
        self.places: list[str] = []
        self.tables: list[str] = []
        self.version = 0

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> SpanIndex:
        """The index of that folder, as its latest manifest has it."""
        rows = spark.read.text(f"{folder}/manifest-*").collect()  # a line for each change
        at = max((json.loads(r[0]) for r in rows), key=lambda m: m["version"])
        index = cls(spark, at["length"], at["fan_in"], folder)
        index.buckets, index.version, index.runs, index.places = at["buckets"], at["version"], [tuple(r) for r in at["runs"]], at["places"]
        for _, name in index.runs:
            index._declare(name)
        return index

    def _save(self) -> None:
        self.version += 1
        state = {"version": self.version, "length": self.length, "fan_in": self.fan_in, "buckets": self.buckets, "runs": self.runs, "places": self.places}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.version:06d}")

    def _declare(self, name: str) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (seed BIGINT, lo BIGINT, hi BIGINT) USING parquet CLUSTERED BY (seed) SORTED BY (seed) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        self.tables.append(name)

    def _write_run(self, keys: DataFrame, level: int) -> str:
        name = f"span_run_{uuid.uuid4().hex}"
        # the aggregation above has already placed each seed in the partition that is its bucket: a bucket is one file
        keys.write.bucketBy(self.buckets, "seed").sortBy("seed").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.runs.append((level, name))
        self.tables.append(name)
        return name

    def postings(self, records: DataFrame) -> DataFrame:
        """The seeds of records (id BIGINT, seq STRING), beside their other columns a batch of which ``add_postings`` takes."""
        return records.select("id", "seq").mapInArrow(_seeds(self.length), "seed long, id long, first int, last int")

    def add(self, records: DataFrame) -> DataFrame:
        """``records``: id BIGINT, seq STRING. Result: id, first, last (window starts) of each place whose seed got its second owner."""
        return self.add_postings(self.postings(records))

    def _merged(self, run: str, older: list[str]) -> DataFrame:
        """Each seed of the run with its owners in older runs: merge joins of sorted files."""
        none = F.lit(None).cast("long")
        new = self.spark.table(run).select("seed", "lo", "hi", none.alias("old_lo"), none.alias("old_hi"))
        for name in older:
            old = self.spark.table(name).select("seed", F.col("lo").alias("l"), F.col("hi").alias("h"))
            new = new.join(old.hint("merge"), "seed", "left").select("seed", "lo", "hi", F.least("old_lo", "l").alias("old_lo"), F.greatest("old_hi", "h").alias("old_hi"))
        return new

    def add_postings(self, postings: DataFrame) -> DataFrame:
        step, out = (f"{self.folder}/{x}-{uuid.uuid4().hex}" for x in ("places", "found"))
        postings.write.parquet(step)
        postings = self.spark.read.schema(postings.schema).parquet(step)
        older = [name for _, name in self.runs]
        run = self._write_run(postings.groupBy("seed").agg(F.min("id").alias("lo"), F.max("id").alias("hi")), 0)
        with _runs_are_sorted(self.spark):
            shared = cut(self._merged(run, older).filter(F.least("lo", "old_lo") != F.greatest("hi", "old_hi")), "shared-seeds")
        found = postings.join(shared.select("seed"), "seed", "left_semi")
        if self.places:
            # older places of these seeds that were not shared before
            met = shared.filter(F.col("old_lo") == F.col("old_hi")).select("seed")
            found = found.unionByName(self.spark.read.schema(postings.schema).parquet(*self.places).join(met, "seed", "left_semi"))
        found.select("id", "first", "last").write.parquet(out)
        self.places.append(step)
        self._save()
        return self.spark.read.schema("id long, first int, last int").parquet(out)

    def compact(self) -> None:
        """Merge the runs of any level that has ``fan_in`` of them into one of the next level."""
        level, before = 0, list(self.runs)
        while any(x >= level for x, _ in self.runs):
            full = [name for x, name in self.runs if x == level]
            if len(full) >= self.fan_in:
                rows = self.spark.table(full[0])
                for name in full[1:]:
                    rows = rows.unionByName(self.spark.table(name))
                self.runs = [(x, name) for x, name in self.runs if x != level]
                self._write_run(rows.groupBy("seed").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), level + 1)
            level += 1
        if self.runs != before:
            self._save()

    def close(self, delete: bool = False) -> None:
        """Take the runs out of the session's catalog; ``delete``: the folder too."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables = []
        if delete:
            remove(self.spark, self.folder)


def _merged(starts: DataFrame, length: int, tile: int = TILE) -> DataFrame:
    """Unbroken runs of positions covered by windows (id, start): first inside tiles of bounded size, then over a record's tiles."""

    def islands(df: DataFrame, by: list[str]) -> DataFrame:
        before = F.max("b").over(Window.partitionBy(*by).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
        new = df.withColumn("new", F.when(F.col("a") <= before, 0).otherwise(1))
        numbered = new.withColumn("island", F.sum("new").over(Window.partitionBy(*by).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
        return numbered.groupBy(*by, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))

    spans = starts.select("id", F.expr(f"start div {tile}").alias("tile"), F.col("start").alias("a"), (F.col("start") + length).alias("b"))
    return islands(islands(spans, ["id", "tile"]).select("id", "a", "b"), ["id"]).select("id", F.col("a").alias("span_start"), F.col("b").alias("span_end"))


def shared_spans(records: DataFrame, id: str, seq: str, length: int, batches: int = 3, fan_in: int = 2) -> DataFrame:
    """``id, span_start, span_end``: the longest unbroken runs of positions that lie in a stretch of ``length`` bases which
    also stands, apart from case, in a record of another id.

    Records go into the index in ``batches`` parts; their letters are read twice, for the seeds and for the places to verify. Rows with a null id or seq have no spans;
    rows of one id are compared with other ids only, and if their texts differ, a position is shared if it is in any of them. Letters other than A, C, G and T end a stretch. Shorter, empty and repeated rows
    are fine; an empty table gives no rows. Other columns are ignored.
    """
    spark = records.sparkSession
    rows = records.filter(F.col(f"`{id}`").isNotNull() & (F.length(f"`{seq}`") >= length)).select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{seq}`").alias("seq"))
    index = SpanIndex(spark, length, fan_in)
    try:
        seeds = cut(index.postings(rows), "seeds") if batches > 1 else index.postings(rows)
        found = None
        for part in range(batches):
            if part:
                index.compact()
            now = index.add_postings(seeds.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == part) if batches > 1 else seeds)
            found = now if found is None else found.unionByName(now)
        places = found.withColumn("tile", F.expr(f"first div {TILE}").cast("int")).groupBy("id", "tile").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
        run, words = _windows(length, TILE)
        # all windows of a seed begin within a window's length
        held = tiles(rows.withColumnRenamed("id", "chrom_id"), TILE, 2 * length).select(F.col("chrom_id").alias("id"), "tile", "text")
        windows = cut(places.join(held, ["id", "tile"]).mapInArrow(run, "id long, start int, " + ", ".join(f"{w} long" for w in words)), "windows")
    finally:
        index.close(delete=True)
    shared = windows.groupBy(*words).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").drop("lo", "hi")
    return _merged(windows.join(shared, words, "left_semi").select("id", "start"), length)
