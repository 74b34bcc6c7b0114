"""Variants from alignments, cohorts and concordance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASES, parse_cigar

_VARIANTS = "array<struct<pos: int, ref: string, alt: string>>"


def cigar_variants(pos: Column | str, prefix: Column | str, ref: Column | str, alt: Column | str, cigar: Column | str, span: int | None = None) -> Column:
    """V1: the variants of one read as array of (pos, ref, alt).

    pos: where the reference text begins; prefix: the base before it. M, = and X give a variant for each differing pair without N. An insertion is the base before it and
    that base with the inserted ones, from the read; at the very start the prefix stands for it. A deletion is the base before and the
    deleted ones, and the read's base before. S moves on in the read, N in the reference; H and P do nothing. span: no operation goes beyond so many
    bases of either text.
    """
    pos, prefix, ref, alt = (F.col(x) if isinstance(x, str) else x for x in (pos, prefix, ref, alt))
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("a"), F.array().cast(_VARIANTS).alias("found"))

    def base(text: Column, at: Column, n: Column | int = 1) -> Column:
        return F.substring(text, at + 1, F.lit(n) if isinstance(n, int) else n)

    def step(x: Column, e: Column) -> Column:
        n = e["len"] if span is None else F.greatest(F.lit(0), F.least(e["len"], F.lit(span) - F.greatest(x["r"], x["a"])))
        both = e["op"].isin("M", "=", "X")
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((pos + x["r"] + i).cast("int").alias("pos"), base(ref, x["r"] + i).alias("ref"), base(alt, x["a"] + i).alias("alt")))
        snvs = F.filter(each, lambda v: (v["ref"] != v["alt"]) & (v["ref"] != "N") & (v["alt"] != "N") & (v["ref"] != "") & (v["alt"] != ""))
        at = (pos + x["r"]).cast("int").alias("pos")
        first = x["r"] == 0
        inserted = F.struct(at, F.when(first, prefix).otherwise(base(ref, x["r"] - 1)).alias("ref"), F.when(first, F.concat(prefix, base(alt, x["a"], n))).otherwise(base(alt, F.greatest(x["a"] - 1, F.lit(0)), n + 1)).alias("alt"))
        deleted = F.struct(at, F.when(first, F.concat(prefix, base(ref, x["r"], n))).otherwise(base(ref, x["r"] - 1, n + 1)).alias("ref"), F.when(first, prefix).otherwise(base(alt, F.greatest(x["a"] - 1, F.lit(0)))).alias("alt"))
        new = F.when(both, snvs).when(e["op"] == "I", F.array(inserted)).when(e["op"] == "D", F.array(deleted)).otherwise(F.array().cast(_VARIANTS))
        return F.struct(
            (x["r"] + F.when(both | e["op"].isin("D", "N"), n).otherwise(0)).alias("r"), (x["a"] + F.when(both | e["op"].isin("I", "S"), n).otherwise(0)).alias("a"),
            F.when(n > 0, F.concat(x["found"], new)).otherwise(x["found"]).cast(_VARIANTS).alias("found"),
        )

    return F.aggregate(parse_cigar(cigar), start, step)["found"]


def call_variants(alignments: DataFrame, min_mapq: int = 20, span: int | None = None) -> DataFrame:
    """Distinct ``chrom_id, pos, ref, alt`` of alignments (chrom_id, pos, mapq, cigar, prefix, ref, alt) of enough quality."""
    good = alignments.filter((F.col("mapq") >= min_mapq) & (F.length("cigar") > 0))
    return good.select("chrom_id", F.inline(cigar_variants("pos", "prefix", "ref", "alt", "cigar", span))).distinct()


def variant_counts(variants: DataFrame, start: int = 0, end: int = 2**31 - 1, by: tuple[str, ...] = ("pos", "ref", "alt")) -> DataFrame:
    """How many samples have each variant of a region, both ends included."""
    return variants.filter(F.col("pos").between(start, end)).groupBy(*by).agg(F.count("*").alias("n"))


def concordance(known: DataFrame, called: DataFrame) -> DataFrame:
    """Each known variant (chrom, pos, ref, alt, and others) with ``status``: matched, alt_mismatch, ref_mismatch or missing.

    A position counts as matched if any variant called there has the reference text and any has the alternative.
    """
    at = called.groupBy("chrom", "pos").agg(F.collect_set("ref").alias("_refs"), F.collect_set("alt").alias("_alts"))
    status = (
        F.when(F.col("_refs").isNull(), "missing").when(~F.array_contains("_refs", F.col("ref")), "ref_mismatch")
        .when(~F.array_contains("_alts", F.col("alt")), "alt_mismatch").otherwise("matched")
    )
    return known.join(at, ["chrom", "pos"], "left").withColumn("status", status).drop("_refs", "_alts")


def concordance_summary(matched: DataFrame) -> DataFrame:
    """Numbers and the percentage of matches."""
    count = lambda s: F.count_if(F.col("status") == s)
    return matched.agg(count("matched").alias("matched"), count("ref_mismatch").alias("ref_mismatch"), count("alt_mismatch").alias("alt_mismatch"), count("missing").alias("missing"), F.round(count("matched") * 100 / F.count("*"), 4).alias("percent"))


def is_variant(ref: Column, alt: Column) -> Column:
    """Both are bases and differ."""
    return (ref != alt) & ref.isin(*BASES) & alt.isin(*BASES)
