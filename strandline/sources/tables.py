"""Text formats around the mapper: SAM, VCF, CSV and TSV files, FASTA indexes, Parquet stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import parse_cigar, reverse_complement
from ..operators.prefix import prefix_sums

SAM_SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext string, tlen string, seq string, qual string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _typed(parts: Column, schema: str) -> list[Column]:
    return [F.get(parts, F.lit(i)).try_cast(kind).alias(name) for i, (name, kind) in enumerate(x.split() for x in schema.split(", "))]


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM files; header lines are skipped, as are lines of fewer than 11 columns. Further columns are ``tags``."""
    parts = F.split("value", "\t")
    rows = _lines(spark, path).filter(~F.col("value").startswith("@") & (F.size(parts) >= 11))
    return rows.select(*_typed(parts, SAM_SCHEMA), F.slice(parts, F.lit(12), F.greatest(F.size(parts) - 11, F.lit(0))).alias("tags"))


def sam_header(genome: DataFrame) -> DataFrame:
    """K1: ``ord, value``: @HD, one @SQ a sequence and @PG."""
    squares = genome.select((F.col("chrom_id") + 1).cast("long").alias("ord"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("len").cast("string")).alias("value"))
    spark = genome.sparkSession
    ends = spark.createDataFrame([(0, "@HD\tVN:1.6\tSO:unknown"), (2**62, "@PG\tID:strandline\tPN:strandline")], "ord long, value string")
    return ends.unionByName(squares)


def sam_lines(alignments: DataFrame, rnext: str = "*") -> DataFrame:
    """K1, K2: ``value``: one SAM line of each alignment (read_id, reverse BOOLEAN, chrom, pos 0-based, mapq, cigar, seq, qual, conversions, strand).

    A null chrom makes an unmapped line (flag 4, position 0, *). rnext: of mapped lines (K2, from edit distances, has =). Tags: Yf the number of conversions, YZ the strand.
    """
    mapped = F.col("chrom").isNotNull()
    text = lambda x, none: F.coalesce(x.cast("string"), F.lit(none))
    columns = [
        text(F.col("read_id"), "*"), F.when(~mapped, "4").when(F.col("reverse"), "16").otherwise("0"), text(F.col("chrom"), "*"), F.when(mapped, (F.col("pos") + 1).cast("string")).otherwise("0"),
        F.when(mapped, text(F.col("mapq"), "0")).otherwise("0"), F.when(mapped & (F.col("cigar") != ""), F.col("cigar")).otherwise("*"), F.when(mapped, rnext).otherwise("*"), F.lit("0"), F.lit("0"),
        F.when(F.col("seq") != "", F.col("seq")).otherwise("*"), F.when(F.col("qual") != "", F.col("qual")).otherwise("*"),
    ]
    tags = F.when(mapped, F.concat(F.lit("\tYf:i:"), text(F.col("conversions"), "0"), F.lit("\tYZ:A:"), text(F.col("strand"), "+"))).otherwise("")
    return alignments.select(F.concat(F.concat_ws("\t", *columns), tags).alias("value"))


def aligner_sam_lines(alignments: DataFrame) -> DataFrame:
    """K9: ``value``: one SAM line of each local alignment (read_id, reverse BOOLEAN, chrom, ref_begin 0-based, mapq, cigar, seq, qual, score, score2, mismatches).

    seq and qual are as read: on the reverse strand they are turned. Tags: AS the score, NM the mismatches and, if there is any, ZS the second score. A score of 0 makes an unmapped line.
    """
    hit = F.coalesce(F.col("score") > 0, F.lit(False))
    back = F.coalesce(F.col("reverse"), F.lit(False))
    tags = F.concat(F.lit("\tAS:i:"), F.col("score").cast("string"), F.lit("\tNM:i:"), F.coalesce("mismatches", F.lit(0)).cast("string"), F.when(F.col("score2") > 0, F.concat(F.lit("\tZS:i:"), F.col("score2").cast("string"))).otherwise(""))
    columns = [
        F.when(back, "16").otherwise("0"), F.col("chrom"), (F.col("ref_begin") + 1).cast("string"), F.coalesce("mapq", F.lit(0)).cast("string"), F.when(F.col("cigar") != "", F.col("cigar")).otherwise("*"), F.lit("*"), F.lit("0"), F.lit("0"),
        F.when(back, reverse_complement("seq")).otherwise(F.col("seq")), F.when(F.col("qual") != "", F.when(back, F.reverse("qual")).otherwise(F.col("qual"))).otherwise("*"),
    ]
    none = F.lit("\t4\t*\t0\t255\t*\t*\t0\t0\t*\t*")
    return alignments.select(F.concat(F.coalesce(F.col("read_id").cast("string"), F.lit("*")), F.when(hit, F.concat(F.lit("\t"), F.concat_ws("\t", *columns), tags)).otherwise(none)).alias("value"))


def alignment_text(alignments: DataFrame, width: int = 60) -> DataFrame:
    """K9: ``value``: a readable text of each local alignment (read_id, reverse, chrom, score, score2, ref_begin, ref_end, query_begin, query_end, cigar, query, ref).

    query: as it was aligned, ref: the whole target text; begins and ends 0-based and inclusive. The letters stand in blocks of ``width``: | for equal ones, * for others, - for gaps.
    """
    spent = lambda e, *ops: F.when(e["op"].isin(*ops), e["len"]).otherwise(0)
    start = F.struct(F.col("query_begin").cast("int").alias("q"), F.col("ref_begin").cast("int").alias("t"), *(F.lit("").alias(c) for c in ("a", "s", "b", "ta", "qa")))

    def step(x: Column, e: Column) -> Column:
        q, t, gap = F.substring("query", x["q"] + 1, e["len"]), F.substring("ref", x["t"] + 1, e["len"]), F.repeat(F.lit("-"), e["len"])
        signs = F.array_join(F.zip_with(F.split(q, ""), F.split(t, ""), lambda c, d: F.when(F.upper(c) == F.upper(d), "|").otherwise("*")), "")
        op, empty = e["op"], F.lit("")
        letters = lambda x, *ops: F.concat(x, F.when(op.isin("M", "=", "X", *ops), F.repeat(F.lit("x"), e["len"])).when(op.isin("I", "D", "N"), F.repeat(F.lit(" "), e["len"])).otherwise(empty))
        return F.struct(
            (x["q"] + spent(e, "M", "=", "X", "I")).alias("q"), (x["t"] + spent(e, "M", "=", "X", "D", "N")).alias("t"),
            F.concat(x["a"], F.when(op.isin("M", "=", "X", "D", "N"), t).when(op == "I", gap).otherwise(empty)).alias("a"),
            F.concat(x["s"], F.when(op.isin("M", "=", "X"), signs).when(op.isin("I", "D", "N"), F.repeat(F.lit(" "), e["len"])).otherwise(empty)).alias("s"),
            F.concat(x["b"], F.when(op.isin("M", "=", "X", "I"), q).when(op.isin("D", "N"), gap).otherwise(empty)).alias("b"),
            letters(x["ta"], "D", "N").alias("ta"), letters(x["qa"], "I").alias("qa"),
        )

    walked = F.aggregate(parse_cigar("cigar"), start, step)

    def block(x: Column, i: Column) -> Column:
        cut = lambda c: F.substring(x[c], i * width + 1, F.lit(width))
        number = lambda c, n, begin: (F.col(begin) + F.length(F.replace(F.substring(x[c], F.lit(1), n), F.lit(" "), F.lit("")))).cast("string")
        side = lambda name, c, mask, begin: F.concat(F.lit(name), F.lpad((number(mask, i * width, begin) + 1).cast("int").cast("string"), 8, " "), F.lit("    "), cut(c), F.lit("    "), number(mask, (i + 1) * width, begin))
        return F.concat(side("Target: ", "a", "ta", "ref_begin"), F.lit("\n" + " " * 20), cut("s"), F.lit("\n"), side("Query:  ", "b", "qa", "query_begin"), F.lit("\n\n"))

    shown = F.transform(F.array(walked), lambda x: F.when(F.length(x["a"]) > 0, F.array_join(F.transform(F.sequence(F.lit(0), ((F.length(x["a"]) - 1) / width).cast("int")), lambda i: block(x, i)), "")).otherwise(""))[0]
    field = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"))
    head = F.concat(
        field("target_name", F.coalesce("chrom", F.lit("*"))), F.lit("\n"), field("query_name", F.coalesce(F.col("read_id").cast("string"), F.lit("*"))), F.lit("\n"),
        F.concat_ws(
            "\t", field("optimal_alignment_score", F.col("score")), F.when(F.col("score2") > 0, field("suboptimal_alignment_score", F.col("score2"))), field("strand", F.when(F.col("reverse"), "-").otherwise("+")),
            F.when(F.col("ref_begin") >= 0, field("target_begin", F.col("ref_begin") + 1)), field("target_end", F.col("ref_end") + 1), F.when(F.col("query_begin") >= 0, field("query_begin", F.col("query_begin") + 1)), field("query_end", F.col("query_end") + 1),
        ),
        F.lit("\n\n"),
    )
    return alignments.select("read_id", F.concat(head, F.coalesce(shown, F.lit(""))).alias("value"))


def write_sam(alignments: DataFrame, genome: DataFrame, path: str) -> None:
    """K1: a folder of text files; the header is a file of its own that sorts first."""
    sam_header(genome).orderBy("ord").select("value").coalesce(1).write.mode("append").text(f"{path}/part=0")
    sam_lines(alignments).write.mode("append").text(f"{path}/part=1")


def vcf_lines(variants: DataFrame) -> DataFrame:
    """K3: ``value`` of each variant (chrom, pos 1-based, id, ref, alt, qual); nulls become dots."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return variants.select("chrom", "pos", "ref", "alt", F.concat_ws("\t", *(dot(c) for c in ("chrom", "pos", "id", "ref", "alt", "qual")), F.lit("PASS"), F.lit(".")).alias("value"))


def write_vcf(variants: DataFrame, path: str) -> None:
    """K3, T4: header, then the variants in order of chromosome, position and alleles; ordering is by range, so files are written side by side."""
    spark = variants.sparkSession
    spark.createDataFrame([("##fileformat=VCFv4.3",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",)], "value string").coalesce(1).write.mode("append").text(f"{path}/part=0")
    vcf_lines(variants).orderBy("chrom", "pos", "ref", "alt").select("value").write.mode("append").text(f"{path}/part=1")


def read_variants(spark: SparkSession, path: str, sample: str = r"([^/]+)$") -> DataFrame:
    """``sample`` (a part of the file's path, by default its name), pos, ref, alt of files with commas or tabs; lines that don't begin with a number are skipped."""
    parts = F.split("value", "[,\t]")
    rows = _lines(spark, path).select(F.regexp_extract(F.input_file_name(), sample, 1).alias("sample"), *_typed(parts, "pos int, ref string, alt string"))
    return rows.filter(F.col("pos").isNotNull())


def write_variants(variants: DataFrame, path: str, counts: bool = False) -> None:
    """K4, K5: pos,ref,alt and, if asked, n."""
    variants.select("pos", "ref", "alt", *(["n"] if counts else [])).write.csv(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Run and bam of each sample, with the name of its file."""
    return spark.read.csv(path, sep="\t", schema="run string, bam string").withColumn("file", F.concat("run", F.lit("_"), F.regexp_replace("bam", r"\.bam$", "")))


def read_reference_windows(spark: SparkSession, path: str) -> DataFrame:
    """``read_id, chrom, window_id``; read_id is the line's place in its file (one task reads one file, whole)."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("read_id", "line")).filter("line <> ''")
    return rows.select(F.col("read_id").cast("long").alias("read_id"), F.split("line", " ")[0].alias("chrom"), F.split("line", " ")[1].cast("int").alias("window_id"))


MAPPER_SCHEMA = "read_id long, orientation int, chrom string, window_pos int, shift int, read_len int"


def read_mapped(spark: SparkSession, path: str) -> DataFrame:
    """The mapper's tab-separated hits."""
    return spark.read.csv(path, sep="\t", schema=MAPPER_SCHEMA)


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """Known variants, divided by semicolons."""
    return spark.read.csv(path, sep=";", schema="chrom string, pos int, ref string, alt string, gene string")


def fasta_index(genome: DataFrame, line_bases: int, line_end: int = 1) -> DataFrame:
    """The index of the FASTA file that holds ``genome`` (chrom_id, name, len) in order of chrom_id at so many bases a line."""
    body = F.col("len") + F.ceil(F.col("len") / line_bases) * line_end
    sized = genome.select("chrom_id", "name", F.col("len").cast("long").alias("length"), (F.octet_length("name") + 1 + line_end).cast("long").alias("head"), body.cast("long").alias("body"))
    placed = prefix_sums(sized.withColumn("both", F.col("head") + F.col("body")), "chrom_id", "both", exclusive="before")
    return placed.select("chrom_id", "name", "length", (F.col("before") + F.col("head")).alias("offset"), F.lit(line_bases).alias("line_bases"), F.lit(line_bases + line_end).alias("line_width"))


def read_fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """Name, length, byte offset, bases and bytes a line."""
    return spark.read.csv(path, sep="\t", schema="name string, length long, offset long, line_bases int, line_width int")


def reference_slice(seq: Column | str, pos: Column | str, span: Column | int = 82) -> Column:
    """Struct (prefix, ref): the base before a 0-based position (N at the start) and the ``span`` bases from it."""
    seq, pos = (F.col(x) if isinstance(x, str) else x for x in (seq, pos))
    return F.struct(F.when(pos > 0, F.substring(seq, pos, F.lit(1))).otherwise("N").alias("prefix"), F.substring(seq, pos + 1, F.lit(span) if isinstance(span, int) else span).alias("ref"))


def region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows (chrom, pos) of a region, both ends included."""
    return df.filter((F.col("chrom") == chrom) & F.col("pos").between(start, end))


def save(df: DataFrame, path: str) -> None:
    """Reads or signatures as Parquet."""
    df.write.mode("overwrite").parquet(path)


def load_signatures(spark: SparkSession, path: str, hashes: int | None = None) -> DataFrame:
    """Stored signatures, of at most so many hash functions."""
    stored = spark.read.parquet(path)
    return stored if hashes is None else stored.filter(F.col("h") < hashes)
