"""From reads and a genome to alignments and variants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import cigar_span, is_ambiguous, mapq, reverse_complement, three_letter
from ..operators.align import bisulfite_align, edit_align
from ..operators.hamming import map_reads
from ..operators.variants import call_variants
from ..operators.windows import load_genome, longest, with_stretch
from ..options import Options
from ..shared import spread


def mapped(reads: DataFrame, genome: DataFrame, options: Options = Options()) -> DataFrame:
    """Best hit of each read (E1, steps 1 and 2). ``seed_alphabet`` 3N finds and compares reads and genome after C to T conversion."""
    ready = load_genome(genome)
    if options.seed_alphabet == "3N":
        ready, reads = ready.withColumn("seq", three_letter("seq")), reads.withColumn("seq", three_letter(F.upper("seq")))
    return map_reads(reads, ready, options.kmerlength, options.window_size, options.num_hash_functions, options.min_table_hits, options.max_hamming_ratio, options.max_results_per_map, options.bucket_mode)


def alignments(reads: DataFrame, genome: DataFrame, options: Options = Options(), hits: DataFrame | None = None, mapper: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Alignments of the hits with their window (L14 - L18): ``read_id, chrom_id, chrom, pos, strand, score, score2, mapq, cigar, conversions, query, ref, ref_begin, prefix``.

    pos is 0-based and where the alignment begins on the chromosome. mapper: a function in place of the built-in ones; it gets ``read_id, query, ref`` and others, and
    adds strand, score, score2, mapq, conversions and ``alignment`` (ref_begin, cigar).
    """
    ready = load_genome(genome)
    found = mapped(reads, genome, options) if hits is None else hits
    texts = reads.filter(F.col("seq").isNotNull()).select("read_id", F.upper("seq").alias("query")).distinct()
    names = ready.select("chrom_id", F.trim(F.split("name", r"\s")[0]).alias("chrom"))
    sided = found.join(texts, "read_id").join(names, "chrom_id")
    # the letter before the window comes along
    early = (F.col("ext_start") > 0).cast("int")
    placed = with_stretch(sided, ready, F.col("ext_start") - early, F.col("ext_len") + early, "_whole", options.window_size + longest(reads) + 1)
    pairs = placed.select("read_id", "chrom_id", "chrom", "ext_start", "query", F.substring("_whole", early + 1, F.col("ext_len")).alias("ref"), F.when(F.col("ext_start") > 0, F.left("_whole", F.lit(1))).otherwise("N").alias("_before"))
    if mapper is not None:
        out = mapper(pairs)
    elif options.mapper == "sw":
        out = bisulfite_align(pairs, "query", "ref")
    else:
        out = edit_mapper(pairs)
    begin = F.col("alignment.ref_begin")
    out = out.withColumn("oriented", F.when(F.col("strand") == "-", reverse_complement("query")).otherwise(F.col("query")))
    return out.select(
        "read_id", "chrom_id", "chrom", (F.col("ext_start") + begin).alias("pos"), "strand", "score", "score2", "mapq", F.col("alignment.cigar").alias("cigar"), "conversions", F.col("oriented").alias("query"), "ref",
        begin.alias("ref_begin"), F.when(begin > 0, F.substring("ref", begin, F.lit(1))).otherwise(F.col("_before")).alias("prefix"),
    )


def edit_mapper(pairs: DataFrame) -> DataFrame:
    """L8 in place of L1: both strands by edit distance, three letters, free ends in the reference; the score is the query's length less the distance."""
    both = spread(pairs).withColumn("_rc", reverse_complement("query")).withColumn("_ref", three_letter("ref"))
    both = both.withColumn("_f", edit_align(three_letter("query"), F.col("_ref"), "HW", True)).withColumn("_r", edit_align(three_letter("_rc"), F.col("_ref"), "HW", True))
    plus = F.col("_f.edit_distance") <= F.col("_r.edit_distance")
    best, other = F.when(plus, F.col("_f")).otherwise(F.col("_r")), F.when(plus, F.col("_r")).otherwise(F.col("_f"))
    out = both.withColumn("_b", best).withColumn("strand", F.when(plus, "+").otherwise("-"))
    size = F.length("query")
    out = out.withColumn("score", F.greatest(F.lit(0), size - F.col("_b.edit_distance"))).withColumn("score2", F.greatest(F.lit(0), size - other["edit_distance"]))
    struct = F.struct(F.coalesce(F.col("_b.locations")[0]["start"], F.lit(0)).alias("ref_begin"), F.col("_b.cigar").alias("cigar"))
    return out.withColumn("alignment", struct).withColumn("conversions", F.lit(0)).withColumn("mapq", mapq("score", "score2")).drop("_rc", "_ref", "_f", "_r", "_b")


def variants(aligned: DataFrame, options: Options = Options(), span: int | None = None) -> DataFrame:
    """V4: distinct variants of alignments of enough quality, each with its own chromosome."""
    rows = aligned.select("chrom_id", "pos", "mapq", "cigar", "prefix", F.expr("substring(ref, ref_begin + 1)").alias("ref"), F.col("query").alias("alt"))
    return call_variants(rows, options.min_mapq, span)


def usable(reads: DataFrame) -> DataFrame:
    """Reads with a text, each once, with F4's flag."""
    return reads.filter(F.col("seq").isNotNull()).dropDuplicates(["read_id", "seq"]).withColumn("ambiguous", is_ambiguous("seq"))


def aligned_span(aligned: DataFrame) -> DataFrame:
    """How far each alignment reaches on reference and query."""
    return aligned.select("read_id", cigar_span("cigar", "M=XDN").alias("ref_span"), cigar_span("cigar", "M=XIS").alias("query_span"))
