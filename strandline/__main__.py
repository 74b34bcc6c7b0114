"""python -m strandline --reads PATH --genome PATH --output FOLDER [settings of Options]: map reads, write SAM and VCF."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sequence import reverse_complement
from .operators.windows import load_genome
from .options import Options
from .plans import mapper
from .shared import cut
from .sources.fastx import global_ids, read_fastx
from .sources.tables import write_sam, write_vcf


def run(spark: SparkSession, reads_path: str, genome_path: str, output: str, options: Options) -> None:
    """Every read comes out in the SAM file, mapped or not; variants of alignments of enough quality in the VCF file."""
    reads = global_ids(read_fastx(spark, reads_path, "STOP")).select(F.col("global_read_id").alias("read_id"), "file_id", "read_id_in_file", "seq", "qual")
    chroms = global_ids(read_fastx(spark, genome_path)).select(F.col("global_read_id").cast("int").alias("chrom_id"), F.col("header").alias("name"), "seq", F.lit(None).cast("int").alias("profile_id"))
    aligned = cut(mapper.alignments(reads, chroms, options), "alignments")
    write_sam(sam_rows(reads, aligned), load_genome(chroms).withColumn("name", F.split("name", r"\s")[0]), f"{output}/sam")
    names = chroms.select("chrom_id", F.split("name", r"\s")[0].alias("chrom"))
    found = mapper.variants(aligned, options).join(names, "chrom_id")
    write_vcf(found.select("chrom", (F.col("pos") + 1).alias("pos"), F.lit(None).cast("string").alias("id"), "ref", "alt", F.lit(None).cast("int").alias("qual")), f"{output}/vcf")


def sam_rows(reads: DataFrame, aligned: DataFrame) -> DataFrame:
    """Rows for ``sam_lines``: reads on the reverse strand are turned, with their qualities."""
    of = aligned.select("read_id", "chrom", "pos", "mapq", "cigar", "strand", "conversions")
    both = reads.join(of, "read_id", "left").withColumn("reverse", F.coalesce(F.col("strand") == "-", F.lit(False)))
    turned = lambda x, y: F.when(F.col("reverse"), y).otherwise(x)
    return both.select("read_id", "reverse", "chrom", "pos", "mapq", "cigar", turned(F.upper("seq"), reverse_complement(F.upper("seq"))).alias("seq"), turned(F.col("qual"), F.reverse("qual")).alias("qual"), "conversions", "strand")


def main(arguments: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="strandline", description=__doc__)
    for name in ("reads", "genome", "output"):
        parser.add_argument(f"--{name}", required=True)
    paths, rest = parser.parse_known_args(arguments)
    options, unknown = Options.parse(rest)
    if unknown:
        parser.error(f"unknown: {' '.join(unknown)}")
    run(SparkSession.builder.appName("strandline").getOrCreate(), paths.reads, paths.genome, paths.output, options)


if __name__ == "__main__":
    main(sys.argv[1:])
