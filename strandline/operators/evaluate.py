"""Accuracy of a mapping against known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import hamming_full, reverse_complement, window_with_overlap
from .windows import with_stretch


def primary(sam: DataFrame) -> DataFrame:
    """Rows (flag) that are neither secondary nor supplementary."""
    return sam.filter(F.col("flag").bitwiseAND(0x900) == 0)


def truth_windows(sam: DataFrame, genome: DataFrame, w: int, k: int, overlap: int) -> DataFrame:
    """``read_id, chrom_id, window_id`` of primary alignments (read_id, flag, chrom_id, pos, read_len): the first window with enough of the read."""
    return primary(sam).join(genome.select("chrom_id", F.col("len").alias("_len")), "chrom_id").select("read_id", "chrom_id", window_with_overlap("pos", "read_len", "_len", w, k, overlap).alias("window_id"))


def window_hits(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """``chrom_id, window_id, true_hits, false_hits`` of hits (read_id, chrom_id, window_id); a read without truth is false."""
    known = truth.select("read_id", F.col("chrom_id").alias("_c"), F.col("window_id").alias("_w"))
    right = (F.col("chrom_id") == F.col("_c")) & (F.col("window_id") == F.col("_w"))
    return hits.join(known, "read_id", "left").groupBy("chrom_id", "window_id").agg(F.count_if(right).alias("true_hits"), (F.count("*") - F.count_if(right)).alias("false_hits"))


def reads_per_window(windows: DataFrame, truth: DataFrame) -> DataFrame:
    """A10: ``chrom_id, window_id, n`` of every window, with 0 where no read is."""
    n = truth.groupBy("chrom_id", "window_id").agg(F.count("*").alias("n"))
    return windows.select("chrom_id", "window_id").join(n, ["chrom_id", "window_id"], "left").select("chrom_id", "window_id", F.coalesce("n", F.lit(0)).alias("n"))


def hit_statistics(hits: DataFrame, per_window: DataFrame) -> DataFrame:
    """Mean, median, least and greatest precision and recall over the windows that have hits; recall is 1 where no read is true."""
    both = hits.join(per_window, ["chrom_id", "window_id"], "left").filter(F.col("true_hits") + F.col("false_hits") > 0)
    n = F.coalesce("n", F.lit(0))
    both = both.select((F.col("true_hits") / (F.col("true_hits") + F.col("false_hits"))).alias("precision"), F.when(n == 0, 1.0).otherwise(F.col("true_hits") / n).alias("recall"))
    return both.agg(F.count("*").alias("n_windows"), *(F.round(f(c), 4).alias(f"{name}_{c}") for c in ("precision", "recall") for name, f in (("mean", F.avg), ("median", lambda x: F.percentile(x, 0.5)), ("min", F.min), ("max", F.max))))


def mapping_status(mapped: DataFrame, truth: DataFrame, genome: DataFrame, most_mismatches: int = 0) -> DataFrame:
    """V7: each read with ``status``: unmapped, clipped, truth_clipped, or four bits (chromosome, orientation, position, region all right).

    mapped and truth: read_id, chrom_id (null: unmapped), pos, orientation; truth also read_len. A region is right if the read lies where it should, or where the genome, in either
    direction, differs from there in at most ``most_mismatches`` bases.
    """
    m = mapped.select("read_id", F.col("chrom_id").alias("mc"), F.col("pos").alias("mp"), F.col("orientation").alias("mo"))
    t = truth.select("read_id", F.col("chrom_id").alias("tc"), F.col("pos").alias("tp"), F.col("orientation").alias("to"), "read_len")
    most = truth.agg(F.max("read_len")).first()[0] or 0
    g = genome.select("chrom_id", "len")
    sided = (
        t.join(m, "read_id", "left")
        .join(g.select(F.col("chrom_id").alias("mc"), F.col("len").alias("ml")), "mc", "left")
        .join(g.select(F.col("chrom_id").alias("tc"), F.col("len").alias("tl")), "tc", "left")
    )
    for name, c, p in (("_a", "tc", "tp"), ("_b", "mc", "mp")):
        sided = with_stretch(sided.withColumnRenamed(c, "chrom_id"), genome, F.greatest(F.coalesce(p, F.lit(0)), F.lit(0)), F.col("read_len"), name, most).withColumnRenamed("chrom_id", c)
    a, b = F.col("_a"), F.col("_b")
    chrom, strand, place = F.col("mc") == F.col("tc"), F.col("mo") == F.col("to"), F.col("mp") == F.col("tp")
    near = F.when(chrom & strand & place, True).otherwise(F.least(hamming_full(a, b), hamming_full(reverse_complement(a), b)) <= most_mismatches)
    bits = F.concat(*(x.cast("int").cast("string") for x in (chrom, strand, place, near)))
    status = (
        F.when(F.col("ml").isNull() | F.col("tl").isNull(), "unmapped").when((F.col("mp") < 0) | (F.col("mp") + F.col("read_len") >= F.col("ml")), "clipped")
        .when((F.col("tp") < 0) | (F.col("tp") + F.col("read_len") >= F.col("tl")), "truth_clipped").otherwise(bits)
    )
    return sided.select("read_id", status.alias("status"))


def status_counts(statuses: DataFrame) -> DataFrame:
    """How many reads have each status."""
    return statuses.groupBy("status").agg(F.count("*").alias("n"))
