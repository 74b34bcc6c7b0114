"""FASTA and FASTQ files (S1 - S8, K6, K7): a Python data source and writers.

    spark.dataSource.register(FastxSource)
    spark.read.format("fastx").load("/data/*.fastq.gz")
    df.write.format("fastx").save("/data/out")

One task reads one file, as these formats hold no marks to split at; ids come from the file's place in the sorted list and a record's place in the file.
"""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_id int, read_id_in_file long, header string, seq string, qual string, path string"
#: fixed value: how a gzip stream begins
GZIP_MAGIC = b"\x1f\x8b"


class BrokenRecord(ValueError):
    """A FASTQ record without qualities, or with another number of them than bases."""


#: what a report calls the ways a file can break: qualities cut short, and bytes that are no text or no whole gzip stream
BROKEN_QUALITIES, BROKEN_STREAM = -2, -3


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, ...) and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri(f"file://{path[5:]}") if path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[str]:
    """The files of a path, a folder, a pattern (its last part only), or several of these divided by commas, sorted; hidden ones are left out."""
    found = []
    for part in path.split(","):
        system, at = _located(part)
        folder, _, name = at.rpartition("/")
        prefix = part[: len(part) - len(at)]
        if any(c in name for c in "*?["):
            found += [prefix + f.path for f in system.get_file_info(fs.FileSelector(folder or ".")) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, name)]
        elif system.get_file_info(at).type == fs.FileType.Directory:
            found += [prefix + f.path for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
        else:
            found.append(part)
    return sorted(f for f in found if not f.rpartition("/")[2].startswith(("_", ".")))


def is_gzip(path: str) -> bool:
    """S2."""
    system, at = _located(path)
    with system.open_input_stream(at, compression=None) as f:
        return f.read(2) == GZIP_MAGIC


def records(path: str) -> Iterator[tuple[str, str, str | None]]:
    """(header, sequence, qualities or None) of each record; sequences and qualities may stand on several lines.

    Empty lines are skipped; what stands before the first > or @ too. A record whose qualities don't have the sequence's length raises BrokenRecord.
    """
    system, at = _located(path)
    with system.open_input_stream(at, compression="gzip" if is_gzip(path) else None) as raw, io.TextIOWrapper(raw, encoding="utf-8") as f:
        header, seq = None, []
        lines = iter(f)
        for line in lines:
            line = line.rstrip("\r\n")
            if line[:1] in (">", "@"):
                if header is not None:
                    yield header, "".join(seq), None
                header, seq = line[1:], []
            elif header is not None and line[:1] == "+":
                want, qual = sum(map(len, seq)), ""
                while len(qual) < want:
                    more = next(lines, None)
                    if more is None:
                        break
                    qual += more.rstrip("\r\n")
                if len(qual) != want:
                    raise BrokenRecord(f"{path}: {header!r} has {want} bases and {len(qual)} qualities")
                yield header, "".join(seq), qual
                header, seq = None, []
            elif header is not None and line:
                seq.append(line)
        if header is not None:
            yield header, "".join(seq), None


class _File(InputPartition):
    def __init__(self, file_id: int, path: str):
        super().__init__((file_id, path))


class FastxReader(DataSourceReader):
    """mode: FAILFAST (default), or STOP: a broken record ends its file, with the records before it kept (``broken_records`` reports it)."""

    def __init__(self, options: dict):
        self.paths = files_of(options.get("path", ""))
        self.mode = options.get("mode", "FAILFAST").upper()

    def partitions(self) -> list[InputPartition]:
        return [_File(i, p) for i, p in enumerate(self.paths)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        file_id, path = partition.value
        try:
            for n, (header, seq, qual) in enumerate(records(path)):
                yield file_id, n, header, seq, qual, path
        except (BrokenRecord, OSError, EOFError, UnicodeDecodeError):
            if self.mode != "STOP":
                raise


class _BrokenReader(FastxReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        file_id, path = partition.value
        n = -1
        try:
            for n, _ in enumerate(records(path)):
                pass
        except (BrokenRecord, OSError, EOFError, UnicodeDecodeError) as e:
            yield file_id, path, n + 1, BROKEN_QUALITIES if isinstance(e, BrokenRecord) else BROKEN_STREAM, str(e)


class BrokenSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx-broken"

    def schema(self) -> str:
        return "file_id int, path string, read_id_in_file long, code int, message string"

    def reader(self, schema) -> FastxReader:
        return _BrokenReader(dict(self.options))


def broken_records(spark: SparkSession, path: str) -> DataFrame:
    """``file_id, path, read_id_in_file, code, message`` of the record at which each file breaks, where a reader in mode STOP ends; whole files have no row."""
    spark.dataSource.register(BrokenSource)
    return spark.read.format("fastx-broken").load(path)


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:
        return FastxReader(dict(self.options))


def read_fastx(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """Records of one or more files (a path, a folder, a pattern, or several divided by commas)."""
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("mode", mode).load(path)


def sniff(path: str, n: int = 5) -> str:
    """FASTA, FASTQ, FASTAGZ, FASTQGZ or NONE, from the first records; some with and some without qualities is an error."""
    kinds = {qual is not None for _, (_, _, qual) in zip(range(n), records(path))}
    if len(kinds) > 1:
        raise ValueError(f"{path} mixes records with and without qualities")
    return "NONE" if not kinds else ("FASTQ" if kinds.pop() else "FASTA") + ("GZ" if is_gzip(path) else "")


def global_ids(reads: DataFrame) -> DataFrame:
    """Adds ``global_read_id``: dense over files in order of file_id, then read_id_in_file (dense from 0 in each file).

    Only one row a file is ranked over all files.
    """
    before = Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = reads.groupBy("file_id").agg((F.max("read_id_in_file") + 1).alias("_n")).select("file_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return reads.join(offsets, "file_id").withColumn("global_read_id", F.col("_first") + F.col("read_id_in_file")).drop("_first")


def interleave(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pairs of two files by their place: ids 2i and 2i + 1; ends with the shorter file."""
    pairs = first.select("read_id_in_file", F.struct("header", "seq", "qual").alias("a")).join(second.select("read_id_in_file", F.struct("header", "seq", "qual").alias("b")), "read_id_in_file")
    return pairs.select(F.explode(F.array(F.struct((F.col("read_id_in_file") * 2).alias("read_id"), "a.*"), F.struct((F.col("read_id_in_file") * 2 + 1).alias("read_id"), "b.*"))).alias("r")).select("r.*")


def paired(reads: DataFrame) -> DataFrame:
    """The pairs of files that hold both mates in turn: ``file_id, pair_id, mate`` (1 or 2) beside the other columns.

    A last record without a mate is left out, as at the end of the shorter of two files.
    """
    sized = reads.groupBy("file_id").agg((F.max("read_id_in_file") + 1).alias("_n"))
    placed = reads.join(sized, "file_id").filter(F.col("read_id_in_file") < F.col("_n") - F.col("_n") % 2).drop("_n")
    return placed.withColumn("pair_id", F.expr("read_id_in_file div 2")).withColumn("mate", (F.col("read_id_in_file") % 2 + 1).cast("int"))


def file_stats(reads: DataFrame) -> DataFrame:
    """Reads of each file, and their least and greatest length."""
    return reads.groupBy("file_id").agg(F.count("*").alias("n_reads"), F.min(F.length("seq")).alias("min_length"), F.max(F.length("seq")).alias("max_length"))


def fastx_text(reads: DataFrame) -> DataFrame:
    """K6: one ``value`` a record, FASTQ where there are qualities and FASTA elsewhere; null headers and sequences are empty."""
    header, seq = F.coalesce("header", F.lit("")), F.coalesce("seq", F.lit(""))
    return reads.select(F.when(F.col("qual").isNotNull(), F.concat(F.lit("@"), header, F.lit("\n"), seq, F.lit("\n+\n"), "qual")).otherwise(F.concat(F.lit(">"), header, F.lit("\n"), seq)).alias("value"))


def write_fastx(reads: DataFrame, path: str, compressed: bool = False) -> None:
    """K6, K7: text files, gzip if asked."""
    fastx_text(reads).write.option("compression", "gzip" if compressed else "none").text(path)
