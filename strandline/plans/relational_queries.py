"""Queries for sources, sinks, filters, joins, aggregates, alignment and accuracy, over whole tables (S, K, P, J, A, T, L, V)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import evaluate as E
from ..functions.register import register_functions
from ..operators.align import better_strand, bisulfite_align, edit_align, local_align, pretty
from ..operators.hamming import shifted_hamming
from ..operators.minhash import bottom_sketch, candidates, capped, kmer_lists, minhash, signature_rows
from ..operators.prefix import prefix_sums
from ..operators.variants import call_variants, cigar_variants, concordance, concordance_summary, variant_counts
from ..operators.windows import longest, windows, with_stretch
from ..options import Options
from ..shared import scratch, spread, table
from ..sources import tables as X
from ..sources.fastx import file_stats, global_ids, interleave, read_fastx, write_fastx
from ..streaming.ingest import distinct_hits, hits_per_window, map_stream, merged_hits, run_to_files, stream_table
from . import mapper
from .registry import Registry
from .scalar_queries import _G, _R, _W, genome, reads
from .scalar_queries import SQL as SCALAR_SQL

query = Registry()
QUERIES, SQL = query.queries, query.sql

_FIRST = r"lower(regexp_extract(name, '^\s*(\S+)', 1))"
#: the hit of each read: least distance, then first chromosome and place
_H = f"""{_G}, {_R}, m AS (SELECT DISTINCT read_id, CAST(orientation AS INT) AS orientation, hamming, lower(trim(chrom)) AS c, CAST(window_pos + shift AS INT) AS pos FROM mapped_reads WHERE orientation IN (1, 2) AND window_pos >= 0 AND shift >= 0 AND hamming >= 0),
    o AS (SELECT m.*, chrom_id, row_number() OVER (PARTITION BY read_id ORDER BY hamming, chrom_id, pos, orientation) AS n FROM m JOIN g ON c = {_FIRST}),
    h AS (SELECT o.read_id, o.orientation, o.hamming, o.chrom_id, o.pos, r.seq AS read, CASE WHEN orientation = 2 THEN reverse(translate(r.seq, 'ACGT', 'TGCA')) ELSE r.seq END AS oriented, length(r.seq) AS n, g.seq AS whole, length(g.seq) AS len,
        regexp_extract(g.name, '^\\s*(\\S+)', 1) AS chrom, r.qual, r.file_id FROM o JOIN r USING (read_id) JOIN g USING (chrom_id) WHERE o.n = 1 AND r.seq IS NOT NULL)"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "mapped_reads").filter("orientation IN (1, 2) AND window_pos >= 0 AND shift >= 0 AND hamming >= 0")
    m = m.select("read_id", F.col("orientation").cast("int").alias("orientation"), "hamming", F.lower(F.trim("chrom")).alias("c"), (F.col("window_pos") + F.col("shift")).alias("pos"))
    g = genome(spark, d).select("chrom_id", F.regexp_extract("name", r"^\s*(\S+)", 1).alias("chrom"), "len").withColumn("c", F.lower("chrom"))
    best = m.join(g.select("c", "chrom_id"), "c").groupBy("read_id").agg(F.min(F.struct("hamming", "chrom_id", "pos", "orientation")).alias("b")).select("read_id", "b.*")
    r = reads(spark, d).filter(F.col("seq").isNotNull()).select("read_id", F.col("seq").alias("read"), "qual", "file_id")
    out = best.join(r, "read_id").join(g.drop("c"), "chrom_id").withColumn("n", F.length("read"))
    return out.withColumn("oriented", F.when(F.col("orientation") == 2, S.reverse_complement("read")).otherwise(F.col("read")))


def stretched(spark, d, df: DataFrame, start: Column, length: Column | int, name: str) -> DataFrame:
    """``df`` with the stretch of its chromosome from ``start`` on; no longer than the longest read and 128 more."""
    return with_stretch(df, genome(spark, d), start, length, name, 128 + longest(table(spark, d, "read_records")))


# sources and sinks


@query(f"WITH {_R}, f AS (SELECT file_id, max(read_id_in_file) + 1 AS n FROM r GROUP BY 1), o AS (SELECT file_id, coalesce(sum(n) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM f) SELECT read_id, CAST(first + read_id_in_file AS BIGINT) AS global_read_id FROM r JOIN o USING (file_id)")
def s6_global_ids(spark, d):
    return global_ids(reads(spark, d)).select("read_id", "global_read_id")


@query(f"WITH {_R}, p AS (SELECT read_id_in_file AS i, a.file_id, a.seq AS x, b.seq AS y FROM r a JOIN r b USING (read_id_in_file) WHERE a.file_id = 1 AND b.file_id = 2) SELECT 2 * i AS read_id, x AS seq FROM p UNION ALL SELECT 2 * i + 1, y FROM p")
def s7_interleaved(spark, d):
    r = reads(spark, d)
    return interleave(r.filter("file_id = 1"), r.filter("file_id = 2")).select("read_id", "seq")


@query(f"WITH {_R} SELECT file_id, count(*) AS n_reads, CAST(min(length(seq)) AS INT) AS min_length, CAST(max(length(seq)) AS INT) AS max_length FROM r GROUP BY 1")
def s8_file_stats(spark, d):
    return file_stats(reads(spark, d))


@query(f"WITH {_G}, s AS (SELECT chrom_id, name, length(seq) AS length, strlen(name) + 2 AS head, length(seq) + CAST(ceil(length(seq) / 60) AS BIGINT) AS body FROM g) SELECT chrom_id, name, length, CAST(coalesce(sum(head + body) OVER (ORDER BY chrom_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head AS BIGINT) AS \"offset\", 60 AS line_bases, 61 AS line_width FROM s")
def s11_fasta_index(spark, d):
    return X.fasta_index(genome(spark, d), 60)


def _sliced(spark, d, df: DataFrame, span: Column) -> DataFrame:
    """``prefix`` and ``ref`` of each hit, from the tiles of its chromosome."""
    early = (F.col("pos") > 0).cast("int")
    got = stretched(spark, d, df, F.col("pos") - early, span + early, "_s")
    return got.withColumn("s", X.reference_slice(F.col("_s"), early, span)).select("*", "s.prefix", "s.ref").drop("_s", "s")


@query(f"WITH {_H} SELECT read_id, CASE WHEN pos > 0 THEN substr(whole, pos, 1) ELSE 'N' END AS prefix, substr(whole, pos + 1, 82) AS ref FROM h")
def s13_reference_slices(spark, d):
    return _sliced(spark, d, hits(spark, d), F.lit(82)).select("read_id", "prefix", "ref")


@query("SELECT run, bam, concat(run, '_', regexp_replace(bam, '\\.bam$', '')) AS file, count(DISTINCT read_id) AS n_reads FROM run_metadata m LEFT JOIN read_records r USING (file_id) WHERE bam IS NOT NULL GROUP BY ALL")
def s15_metadata(spark, d):
    m = table(spark, d, "run_metadata").filter(F.col("bam").isNotNull()).withColumn("file", F.concat("run", F.lit("_"), F.regexp_replace("bam", r"\.bam$", "")))
    n = table(spark, d, "read_records").select("file_id", "read_id").distinct().groupBy("file_id").agg(F.count("*").alias("n"))
    return m.join(n, "file_id", "left").groupBy("run", "bam", "file").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_reads"))


@query(f"WITH {_H} SELECT read_id, chrom, pos FROM h WHERE chrom_id = (SELECT min(chrom_id) FROM h) AND pos BETWEEN 100 AND 5000")
def s22_region(spark, d):
    h = hits(spark, d)
    first = h.agg(F.min_by("chrom", "chrom_id")).first()[0] or ""
    return X.region(h, first, 100, 5000).select("read_id", "chrom", "pos")


@query(f"WITH {_R} SELECT concat('r', read_id) AS header, seq, CASE WHEN length(qual) = length(seq) THEN qual END AS qual FROM r WHERE length(seq) > 0")
def k6_fastx_round_trip(spark, d):
    """Writes all reads as FASTA and FASTQ files and reads them again."""
    path = scratch(spark, "fastx")
    rows = reads(spark, d).filter(F.length("seq") > 0).select(F.concat(F.lit("r"), "read_id").alias("header"), "seq", F.when(F.length("qual") == F.length("seq"), F.col("qual")).alias("qual"))
    write_fastx(rows, path, compressed=True)
    return read_fastx(spark, path).select("header", "seq", "qual")


@query(f"""WITH {_H} SELECT concat_ws(chr(9), read_id, CASE WHEN orientation = 2 THEN '16' ELSE '0' END, chrom, pos + 1, least(254, 60 - hamming), concat(n, 'M'), '*', '0', '0', oriented, '*') || concat(chr(9), 'Yf:i:', hamming, chr(9), 'YZ:A:', CASE WHEN orientation = 2 THEN '-' ELSE '+' END) AS value FROM h WHERE n > 0""")
def k1_sam_lines(spark, d):
    h = hits(spark, d).filter("n > 0").withColumn("reverse", F.col("orientation") == 2)
    rows = h.select("read_id", "reverse", "chrom", "pos", F.least(F.lit(254), 60 - F.col("hamming")).alias("mapq"), F.concat(F.col("n").cast("string"), F.lit("M")).alias("cigar"), F.col("oriented").alias("seq"), F.lit(None).cast("string").alias("qual"), F.col("hamming").alias("conversions"), F.when(F.col("reverse"), "-").otherwise("+").alias("strand"))
    return X.sam_lines(rows)


_V = f"""{_H}, v AS (SELECT DISTINCT chrom_id, chrom, CAST(pos + i AS INT) AS pos, whole[pos + i + 1] AS ref, oriented[i + 1] AS alt FROM (SELECT *, unnest(range(least(n, len - pos))) AS i FROM h WHERE n > 0) WHERE whole[pos + i + 1] <> oriented[i + 1] AND whole[pos + i + 1] <> 'N' AND oriented[i + 1] <> 'N')"""


def ungapped(spark, d) -> DataFrame:
    """The hits as alignments without gaps."""
    h = _sliced(spark, d, hits(spark, d).filter("n > 0"), F.col("n"))
    return h.select("read_id", "file_id", "chrom_id", "chrom", "pos", F.lit(60).alias("mapq"), F.concat(F.least("n", F.col("len") - F.col("pos")).cast("string"), F.lit("M")).alias("cigar"), "prefix", "ref", F.col("oriented").alias("alt"))


@query(f"WITH {_V} SELECT chrom_id, pos, ref, alt FROM v")
def v1_variants(spark, d):
    return call_variants(ungapped(spark, d))


@query(f"WITH {_V} SELECT concat_ws(chr(9), chrom, pos + 1, '.', ref, alt, '.', 'PASS', '.') AS value FROM v")
def k3_vcf_lines(spark, d):
    names = genome(spark, d).select("chrom_id", F.regexp_extract("name", r"^\s*(\S+)", 1).alias("chrom"))
    v = call_variants(ungapped(spark, d)).join(names, "chrom_id").select("chrom", (F.col("pos") + 1).alias("pos"), F.lit(None).cast("string").alias("id"), "ref", "alt", F.lit(None).cast("int").alias("qual"))
    return X.vcf_lines(v).select("value")


_VS = _V.replace("SELECT DISTINCT chrom_id, chrom,", "SELECT DISTINCT file_id, chrom_id, chrom,")


def sample_variants(spark, d) -> DataFrame:
    return ungapped(spark, d).select("file_id", "chrom_id", F.inline(cigar_variants("pos", "prefix", "ref", "alt", "cigar"))).distinct()


@query(f"WITH {_VS} SELECT chrom_id, pos, ref, alt, count(*) AS n FROM v GROUP BY ALL")
def a13_variant_counts(spark, d):
    return variant_counts(sample_variants(spark, d), by=("chrom_id", "pos", "ref", "alt"))


@query(f"WITH {_VS} SELECT pos, ref, alt, count(*) AS n FROM v WHERE pos BETWEEN 200 AND 2000 GROUP BY ALL")
def v5_region_counts(spark, d):
    return variant_counts(sample_variants(spark, d), 200, 2000)


_KNOWN = """a AS (SELECT chrom_id AS chrom, pos, ref, alt FROM v WHERE file_id % 2 = 0), k AS (SELECT DISTINCT chrom_id AS chrom, pos, ref, CASE WHEN pos % 3 = 0 THEN 'A' ELSE alt END AS alt FROM v WHERE file_id % 2 = 1),
    c AS (SELECT chrom, pos, list(ref) AS refs, list(alt) AS alts FROM a GROUP BY ALL), s AS (SELECT k.*, CASE WHEN refs IS NULL THEN 'missing' WHEN NOT list_contains(refs, ref) THEN 'ref_mismatch' WHEN NOT list_contains(alts, alt) THEN 'alt_mismatch' ELSE 'matched' END AS status FROM k LEFT JOIN c USING (chrom, pos))"""


def _matched(spark, d) -> DataFrame:
    v = sample_variants(spark, d).withColumnRenamed("chrom_id", "chrom")
    known = v.filter("file_id % 2 = 1").select("chrom", "pos", "ref", F.when(F.col("pos") % 3 == 0, "A").otherwise(F.col("alt")).alias("alt")).distinct()
    return concordance(known, v.filter("file_id % 2 = 0"))


@query(f"WITH {_VS}, {_KNOWN} SELECT * FROM s")
def j13_concordance(spark, d):
    return _matched(spark, d).select("chrom", "pos", "ref", "alt", "status")


@query(f"WITH {_VS}, {_KNOWN} SELECT count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'ref_mismatch') AS ref_mismatch, count(*) FILTER (status = 'alt_mismatch') AS alt_mismatch, count(*) FILTER (status = 'missing') AS missing, round(count(*) FILTER (status = 'matched') * 100 / count(*), 4) AS percent FROM s")
def a17_concordance_summary(spark, d):
    return concordance_summary(_matched(spark, d))


# filters


@query(f"WITH {_R} SELECT read_id FROM r WHERE length(seq) >= 16")
def filter_p1_length(spark, d):
    return reads(spark, d).filter(F.length("seq") >= 16).select("read_id")


@query("SELECT DISTINCT read_id, window_pos, hamming, read_len FROM mapped_reads WHERE hamming >= 0 AND read_len >= 0 AND hamming <= CAST(floor(CAST(read_len AS FLOAT) * CAST(0.05 AS FLOAT)) AS INT)")
def filter_p4_ratio(spark, d):
    limit = F.floor(F.col("read_len").cast("float") * F.lit(0.05).cast("float"))
    return table(spark, d, "mapped_reads").filter((F.col("hamming") >= 0) & (F.col("read_len") >= 0) & (F.col("hamming") <= limit)).select("read_id", "window_pos", "hamming", "read_len").distinct()


@query("SELECT coalesce(orientation IN (1, 2), false) AS mapped, count(*) AS n FROM (SELECT DISTINCT * FROM mapped_reads) GROUP BY 1")
def a15_mapped_counts(spark, d):
    return table(spark, d, "mapped_reads").distinct().groupBy(F.coalesce(F.col("orientation").isin(1, 2), F.lit(False)).alias("mapped")).agg(F.count("*").alias("n"))


# joins and aggregates


def _hash_sql(table_: str, ids: str) -> str:
    """Minhash signatures with k 16 and 4 hash functions, before the cut."""
    return f"""(WITH k AS (SELECT {ids}, regexp_replace(substr(seq, i, 16), '[^ACGT]', 'A', 'g') AS k FROM (SELECT *, unnest(range(1, length(seq) - 14)) AS i FROM {table_} WHERE length(seq) >= 16)),
        c AS (SELECT {ids}, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS k FROM k),
        n AS (SELECT DISTINCT {ids}, CAST('0b' || replace(replace(replace(replace(k, 'A', '00'), 'C', '01'), 'G', '10'), 'T', '11') AS UBIGINT) AS x FROM c),
        a AS (SELECT {ids}, h, x + h AS x FROM n, (SELECT unnest(range(4))::UBIGINT AS h)),
        b AS (SELECT {ids}, h, ((xor(x, x >> 33)::UHUGEINT * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM a),
        e AS (SELECT {ids}, h, ((xor(x, x >> 33)::UHUGEINT * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM b)
        SELECT {ids}, h::INT AS h, (min(xor(x, x >> 33)) & 4294967295::UBIGINT)::BIGINT AS key FROM e GROUP BY ALL)"""


@query(f"WITH {_R} SELECT * FROM {_hash_sql('r', 'read_id')}")
def a1_minhash(spark, d):
    return minhash(reads(spark, d), ["read_id"], "seq", 16, 4)


def _window_signatures(spark, d) -> DataFrame:
    return signature_rows(windows(genome(spark, d), 16, 128), ["chrom_id", "pos"], "seq", 16, 4)


_C = f"{_R}, {_W}, x AS {_hash_sql('r', 'read_id')}, y AS {_hash_sql('w', 'chrom_id, pos')}, cand AS (SELECT chrom_id, pos, read_id, count(*) AS hits FROM x JOIN y USING (h, key) GROUP BY ALL HAVING count(*) >= 2)"


@query(f"WITH {_C} SELECT * FROM cand")
def j1_candidates(spark, d):
    return candidates(_window_signatures(spark, d), signature_rows(reads(spark, d), ["read_id"], "seq", 16, 4), min_hits=2)


@query(f"WITH {_R}, k AS (SELECT DISTINCT read_id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS k FROM (SELECT read_id, substr(seq, i, 16) AS k FROM (SELECT *, unnest(range(1, length(seq) - 14)) AS i FROM r WHERE length(seq) >= 16))) SELECT read_id, count(*) AS n, min(k) AS first, max(k) AS last FROM k GROUP BY 1")
def a4_kmer_lists(spark, d):
    lists = reads(spark, d).filter(F.length("seq") >= 16).select("read_id", kmer_lists("seq", 16, True).alias("k"))
    return lists.select("read_id", F.size("k").cast("long").alias("n"), F.element_at("k", 1).alias("first"), F.element_at("k", -1).alias("last"))


@query()
def a3_bottom_sketch(spark, d):
    """The eight least hashes of each read; checked against brute force in the tests."""
    return bottom_sketch(reads(spark, d), ["read_id"], "seq", 16, 8).select("read_id", F.array_join(F.transform("sketch", lambda x: x.cast("string")), ",").alias("sketch"))


#: the buckets of all profiles, with the limit of each
_B = "b AS (SELECT DISTINCT profile_id, h, bucket_key AS key, read_id FROM read_signatures WHERE bucket_key IS NOT NULL), lim AS (SELECT profile_id, max(max_results_per_map) AS most FROM run_options GROUP BY 1)"
_PROFILE = ("profile_id", "h", "key")


def _buckets(spark, d) -> DataFrame:
    return table(spark, d, "read_signatures").filter("bucket_key IS NOT NULL").select("profile_id", "h", F.col("bucket_key").alias("key"), "read_id").distinct()


def _capped(spark, d, mode: str) -> DataFrame:
    limits = table(spark, d, "run_options").groupBy("profile_id").agg(F.max("max_results_per_map").alias("most"))
    # a profile without options has no limit
    limited = _buckets(spark, d).join(limits, "profile_id", "left").withColumn("most", F.coalesce("most", F.lit(2**31 - 1)))
    return capped(limited, F.col("most"), mode, _PROFILE).select(*_PROFILE, "read_id")


@query(f"WITH {_B} SELECT profile_id, h, key, read_id FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, h, key ORDER BY read_id) AS n FROM b) LEFT JOIN lim USING (profile_id) WHERE most IS NULL OR n <= most")
def j8_truncated_buckets(spark, d):
    return _capped(spark, d, "truncate")


@query(f"WITH {_B} SELECT profile_id, h, key, read_id FROM (SELECT *, count(*) OVER (PARTITION BY profile_id, h, key) AS n FROM b) LEFT JOIN lim USING (profile_id) WHERE most IS NULL OR n <= most")
def j8_dropped_buckets(spark, d):
    return _capped(spark, d, "drop")


@query(f"WITH {_B} SELECT * FROM b SEMI JOIN (SELECT profile_id, h, key FROM b GROUP BY ALL HAVING count(*) >= 2) USING (profile_id, h, key)")
def j4_shared_buckets(spark, d):
    """Two passes: counts a bucket, then the entries of those with at least two."""
    b = _buckets(spark, d)
    return b.join(b.groupBy(*_PROFILE).agg(F.count("*").alias("n")).filter("n >= 2").select(*_PROFILE), [*_PROFILE], "left_semi").select(*_PROFILE, "read_id")


@query(f"WITH {_B}, {_R} SELECT b.*, length(seq) AS len FROM b JOIN r USING (read_id)")
def j9_gather(spark, d):
    return _buckets(spark, d).join(reads(spark, d).select("read_id", F.length("seq").cast("long").alias("len")), "read_id").select(*_PROFILE, "read_id", "len")


@query(f"WITH {_B} SELECT a.profile_id, a.read_id FROM (SELECT DISTINCT profile_id, read_id FROM b WHERE h = 0) a SEMI JOIN (SELECT DISTINCT profile_id, read_id // 2 AS pair FROM b WHERE h = 1) c ON a.profile_id = c.profile_id AND a.read_id // 2 = c.pair")
def j15_mates(spark, d):
    """Reads of one hash function's buckets whose pair (id div 2) is in another's."""
    b = _buckets(spark, d).withColumn("pair", F.expr("read_id div 2"))
    one = b.filter("h = 0").select("profile_id", "pair", "read_id").distinct()
    return one.join(b.filter("h = 1").select("profile_id", "pair").distinct(), ["profile_id", "pair"], "left_semi").select("profile_id", "read_id")


@query(SQL["j8_truncated_buckets"])
def j8_all_truncated_buckets(spark, d):
    """The same under its earlier name."""
    return j8_truncated_buckets(spark, d)


@query(SQL["j8_dropped_buckets"])
def j8_all_dropped_buckets(spark, d):
    """The same under its earlier name."""
    return j8_dropped_buckets(spark, d)


@query(SQL["j4_shared_buckets"])
def j4_all_shared_buckets(spark, d):
    """The same under its earlier name."""
    return j4_shared_buckets(spark, d)


@query(SQL["j9_gather"])
def j9_all_gather(spark, d):
    """The same under its earlier name."""
    return j9_gather(spark, d)


@query(SQL["j15_mates"])
def j15_all_mates(spark, d):
    """The same under its earlier name."""
    return j15_mates(spark, d)


@query(f"WITH {_H} SELECT read_id, chrom_id, pos, substr(whole, pos + 1, 128) AS seq FROM h")
def j10_window_texts(spark, d):
    return stretched(spark, d, hits(spark, d).select("read_id", "chrom_id", "pos"), F.col("pos"), 128, "seq")


@query(f"WITH {_B}, p AS (SELECT a.read_id FROM b a JOIN b c ON a.profile_id = c.profile_id AND a.h = c.h AND a.key = c.key AND c.read_id = a.read_id + 1) SELECT read_id, count(*) AS n FROM p GROUP BY 1")
def a6_common_buckets(spark, d):
    """How many buckets each read shares with the next one."""
    b = _buckets(spark, d)
    return b.join(b.withColumn("read_id", F.col("read_id") - 1), ["read_id", *_PROFILE]).groupBy("read_id").agg(F.count("*").alias("n"))


@query(f"WITH {_B} SELECT profile_id, h, n, count(*) AS n_buckets FROM (SELECT profile_id, h, key, count(*) AS n FROM b GROUP BY ALL) GROUP BY ALL")
def a5_bucket_sizes(spark, d):
    return _buckets(spark, d).groupBy(*_PROFILE).agg(F.count("*").alias("n")).groupBy("profile_id", "h", "n").agg(F.count("*").alias("n_buckets"))


_D = """fwd AS (SELECT read_id, chrom_id, pos, min(hamming(substr(ext, CAST(s AS INT) + 1, length(seq)), seq) * 10000 + s) AS f, min(hamming(substr(ext, CAST(s AS INT) + 1, length(seq)), reverse(translate(seq, 'ACGT', 'TGCA'))) * 10000 + s) AS b, any_value(length(seq)) AS n
        FROM (SELECT *, unnest(range(length(ext) - length(seq) + 1)) AS s FROM p WHERE length(ext) >= length(seq)) GROUP BY ALL),
    sh AS (SELECT read_id, chrom_id, pos, n, CASE WHEN b // 10000 < f // 10000 THEN 2 ELSE 1 END AS orientation, least(f // 10000, b // 10000) AS hamming, CASE WHEN b // 10000 < f // 10000 THEN b % 10000 ELSE f % 10000 END AS shift FROM fwd)"""
_P = f"{_H}, p AS (SELECT read_id, chrom_id, greatest(pos - 40, 0) AS pos, substr(whole, CAST(greatest(pos - 40, 0) AS INT) + 1, n + 60) AS ext, read AS seq FROM h WHERE n > 0)"


def _pairs(spark, d) -> DataFrame:
    """Reads with the stretch around their hit."""
    h = hits(spark, d).filter("n > 0").withColumn("start", F.greatest(F.col("pos") - 40, F.lit(0)))
    return stretched(spark, d, h, F.col("start"), F.col("n") + 60, "window_seq").select("read_id", "chrom_id", F.col("start").alias("pos"), "window_seq", F.col("read").alias("read_seq"))


def _oriented_pairs(spark, d) -> DataFrame:
    """Reads as they lie on the chromosome, with the stretch around their hit."""
    h = hits(spark, d).filter("n > 0").select("read_id", "chrom_id", "oriented", "pos", "n")
    return stretched(spark, d, h, F.greatest(F.col("pos") - 40, F.lit(0)), F.col("n") + 60, "target").select("read_id", "oriented", "target")


@query(f"WITH {_P}, {_D} SELECT read_id, chrom_id, pos, CAST(CASE WHEN hamming <= floor(n::FLOAT * 0.1::FLOAT) THEN orientation ELSE 3 END AS TINYINT) AS orientation, CAST(CASE WHEN hamming <= floor(n::FLOAT * 0.1::FLOAT) THEN hamming END AS INT) AS hamming, CAST(CASE WHEN hamming <= floor(n::FLOAT * 0.1::FLOAT) THEN shift END AS INT) AS shift FROM sh")
def l13_shifted_hamming(spark, d):
    return shifted_hamming(_pairs(spark, d), 0.1)


#: reads as F3 cleans them, in place of _R
_RC = f"r AS ({SCALAR_SQL['f3_clean_reads'].replace(' AS clean,', ' AS seq,')})"


@query(f"""WITH {_C.replace(_R, _RC, 1)}, ce AS (SELECT *, CAST(len // 2 AS INT) AS ext FROM (SELECT c.read_id, c.chrom_id, c.pos, r.seq, length(r.seq) AS len, g.seq AS whole, length(g.seq) AS n FROM cand c JOIN r USING (read_id) JOIN g USING (chrom_id))),
    cx AS (SELECT *, CASE WHEN ext < pos THEN ext ELSE 0 END AS l, CASE WHEN pos + 128 > n THEN 0 WHEN pos + 128 + ext < n THEN ext ELSE n - pos - 128 END AS r FROM ce),
    p AS (SELECT read_id, chrom_id, pos, seq, substr(whole, CAST(pos - l AS INT) + 1, CAST(least(128, n - pos) + l + r AS INT)) AS ext FROM cx), {_D},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY hamming, chrom_id, pos) AS k FROM sh WHERE hamming <= floor(n::FLOAT * 0.05::FLOAT))
    SELECT read_id, CAST(hamming AS INT) AS hamming, chrom_id, pos, CAST(orientation AS TINYINT) AS orientation, CAST(shift AS INT) AS shift FROM ranked WHERE k = 1""")
def a8_best_hits(spark, d):
    """The mapping plan from all reads, letters beside bases replaced (F3), and the genome to one hit a read."""
    r = table(spark, d, "read_records").select("read_id", "file_id", "read_id_in_file", F.upper("seq").alias("seq")).filter(F.col("seq").isNotNull()).distinct()
    found = mapper.mapped(r, table(spark, d, "genome"), Options(num_hash_functions=4, min_table_hits=2))
    return found.select("read_id", "hamming", "chrom_id", "pos", "orientation", "shift")


@query(SQL["a8_best_hits"])
def a8_all_best_hits(spark, d):
    """The same under its earlier name."""
    return a8_best_hits(spark, d)


@query("SELECT file_id, min(length(seq)) AS shortest, max(length(seq)) AS longest, CAST(sum(length(seq)) AS BIGINT) AS total, bool_and(length(seq) >= 20) AS all_long, bool_or(qual IS NULL) AS any_bare FROM (SELECT DISTINCT * FROM read_records) GROUP BY 1")
def a16_reductions(spark, d):
    r = table(spark, d, "read_records").distinct().withColumn("n", F.length("seq").cast("long"))
    return r.groupBy("file_id").agg(F.min("n").alias("shortest"), F.max("n").alias("longest"), F.sum("n").alias("total"), F.bool_and(F.col("n") >= 20).alias("all_long"), F.bool_or(F.col("qual").isNull()).alias("any_bare"))


@query("SELECT chrom_id, l AS len, CAST(sum(l) OVER (ORDER BY chrom_id) AS BIGINT) AS inclusive, CAST(sum(l) OVER (ORDER BY chrom_id) - l AS BIGINT) AS exclusive FROM (SELECT DISTINCT chrom_id, coalesce(length(seq), 0) AS l, seq FROM genome)")
def a18_prefix_sums(spark, d):
    """Running sums of the lengths of all chromosomes."""
    g = genome(spark, d).select("chrom_id", F.col("len").cast("long").alias("len"))
    return prefix_sums(g, "chrom_id", "len", "inclusive", "exclusive")


@query(f"WITH {_H}, k AS (SELECT *, row_number() OVER (PARTITION BY chrom_id ORDER BY hamming DESC, read_id) AS k FROM h) SELECT chrom_id, read_id, hamming FROM k WHERE k <= 3")
def t3_top_hits(spark, d):
    """The three worst hits of each chromosome."""
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("hamming")).alias("d"), "read_id"))), F.lit(1), F.lit(3))
    salted = hits(spark, d).select("chrom_id", "hamming", "read_id").withColumn("r", F.row_number().over(Window.partitionBy("chrom_id", F.pmod(F.xxhash64("read_id"), F.lit(8))).orderBy(F.desc("hamming"), "read_id"))).filter("r <= 3")
    return salted.groupBy("chrom_id").agg(top.alias("t")).select("chrom_id", F.inline("t")).select("chrom_id", "read_id", (-F.col("d")).alias("hamming"))


# accuracy: truth is where the reads are; hits lie in windows


_T = f"""{_H}, t AS (SELECT read_id, chrom_id, CAST(greatest(pos // 113, 0) AS INT) AS window_id FROM h WHERE n > 0), hw AS (SELECT read_id, chrom_id, CAST(unnest(range(pos // 113, (least(pos + n, len) - 1) // 113 + 1)) AS INT) AS window_id FROM h WHERE n > 0),
    st AS (SELECT hw.chrom_id, hw.window_id, count(*) FILTER (t.window_id = hw.window_id) AS true_hits, count(*) FILTER (t.window_id <> hw.window_id) AS false_hits FROM hw JOIN t USING (read_id) GROUP BY ALL)"""


def _truth(spark, d) -> DataFrame:
    return hits(spark, d).filter("n > 0").select("read_id", "chrom_id", F.expr("pos div 113").cast("int").alias("window_id"))


def _hit_windows(spark, d) -> DataFrame:
    return hits(spark, d).filter("n > 0").select("read_id", "chrom_id", F.explode(S.window_ids("pos", "n", "len", 128, 16)).alias("window_id"))


@query(f"WITH {_T} SELECT * FROM hw")
def f29_window_ids(spark, d):
    return _hit_windows(spark, d)


@query(f"""WITH {_H}, i AS (SELECT *, unnest(range(pos // 113, (least(pos + n, len) - 1) // 113 + 1)) AS w FROM h WHERE n > 0),
    ow AS (SELECT read_id, chrom_id, min(w) FILTER (least((w + 1) * 113, pos + n, len) - greatest(w * 113, pos) >= 40) AS w FROM i GROUP BY ALL) SELECT read_id, chrom_id, CAST(w AS INT) AS window_id FROM ow""")
def w8_truth_windows(spark, d):
    sam = hits(spark, d).filter("n > 0").select("read_id", "chrom_id", "pos", F.col("n").alias("read_len"), F.when(F.col("orientation") == 2, 16).otherwise(0).alias("flag"))
    return E.truth_windows(sam, genome(spark, d), 128, 16, 40)


@query(f"WITH {_T} SELECT * FROM st")
def a9_window_hits(spark, d):
    return E.window_hits(_hit_windows(spark, d), _truth(spark, d))


@query(f"WITH {_T}, {_W.replace(_G + ', ', '')} SELECT w.chrom_id, w.window_id, count(t.read_id) AS n FROM w LEFT JOIN t ON t.chrom_id = w.chrom_id AND t.window_id = w.window_id GROUP BY ALL")
def a10_reads_per_window(spark, d):
    return E.reads_per_window(windows(genome(spark, d), 16, 128), _truth(spark, d))


@query(f"""WITH {_T}, c AS (SELECT chrom_id, window_id, count(*) AS n FROM t GROUP BY ALL), q AS (SELECT true_hits / (true_hits + false_hits) AS p, CASE WHEN coalesce(n, 0) = 0 THEN 1 ELSE true_hits / n END AS r FROM st LEFT JOIN c USING (chrom_id, window_id))
    SELECT count(*) AS n_windows, round(avg(p), 4) AS mean_precision, round(median(p), 4) AS median_precision, round(min(p), 4) AS min_precision, round(max(p), 4) AS max_precision, round(avg(r), 4) AS mean_recall, round(median(r), 4) AS median_recall, round(min(r), 4) AS min_recall, round(max(r), 4) AS max_recall FROM q""")
def a11_hit_statistics(spark, d):
    truth = _truth(spark, d)
    return E.hit_statistics(E.window_hits(_hit_windows(spark, d), truth), E.reads_per_window(windows(genome(spark, d), 16, 128), truth))


_ST = f"""{_H}, mm AS (SELECT read_id, CASE WHEN read_id % 7 <> 0 THEN chrom_id END AS mc, CASE WHEN read_id % 5 = 0 THEN pos + 3 ELSE pos END AS mp, CASE WHEN read_id % 3 = 0 THEN 1 ELSE orientation END AS mo, chrom_id AS tc, pos AS tp, orientation AS ot, n, whole, len FROM h WHERE n > 0),
    x AS (SELECT *, substr(whole, tp + 1, n) AS a, substr(whole, CAST(mp AS INT) + 1, n) AS b FROM mm),
    s AS (SELECT read_id, CASE WHEN mc IS NULL THEN 'unmapped' WHEN mp + n >= len THEN 'clipped' WHEN tp + n >= len THEN 'truth_clipped' ELSE concat('1', CAST(mo = ot AS INT), CAST(mp = tp AS INT),
        CAST((mo = ot AND mp = tp) OR least(hamming(a, b), hamming(reverse(translate(a, 'ACGT', 'TGCA')), b)) <= 0 AS INT)) END AS status FROM x)"""


def _statuses(spark, d) -> DataFrame:
    h = hits(spark, d).filter("n > 0")
    moved = h.select("read_id", F.when(F.col("read_id") % 7 != 0, F.col("chrom_id")).alias("chrom_id"), F.when(F.col("read_id") % 5 == 0, F.col("pos") + 3).otherwise(F.col("pos")).alias("pos"), F.when(F.col("read_id") % 3 == 0, 1).otherwise(F.col("orientation")).alias("orientation"))
    return E.mapping_status(moved, h.select("read_id", "chrom_id", "pos", "orientation", F.col("n").alias("read_len")), genome(spark, d))


_ST = _ST.replace("hamming(a, b)", "CASE WHEN length(a) = length(b) THEN hamming(a, b) ELSE 999 END").replace("hamming(reverse(translate(a, 'ACGT', 'TGCA')), b)", "CASE WHEN length(a) = length(b) THEN hamming(reverse(translate(a, 'ACGT', 'TGCA')), b) ELSE 999 END")


@query(f"WITH {_ST} SELECT * FROM s")
def v7_mapping_status(spark, d):
    return _statuses(spark, d)


@query(f"WITH {_ST} SELECT status, count(*) AS n FROM s GROUP BY 1")
def a12_status_counts(spark, d):
    return E.status_counts(_statuses(spark, d))


# alignment


@query(f"WITH {_P} SELECT read_id, levenshtein(substr(ext, 1, length(seq)), seq) AS d FROM p")
def l8_edit_distance(spark, d):
    """Whole against whole: the built-in function."""
    return _pairs(spark, d).select("read_id", F.levenshtein(F.expr("left(window_seq, length(read_seq))"), "read_seq").cast("long").alias("d"))


@query(f"WITH {_P} SELECT read_id, levenshtein(substr(ext, 1, length(seq)), seq) AS d FROM p")
def l8_edit_align(spark, d):
    """Whole against whole, by the aligner."""
    return spread(_pairs(spark, d)).select("read_id", edit_align("read_seq", F.expr("left(window_seq, length(read_seq))")).alias("e")).select("read_id", F.col("e.edit_distance").cast("long").alias("d"))


@query()
def l9_edit_locations(spark, d):
    """Each oriented read anywhere in its stretch, with path (L8 - L12, F28); tested against a plain table."""
    pairs = _oriented_pairs(spark, d)
    found = spread(pairs).withColumn("e", edit_align("oriented", "target", "HW", True))
    shown = found.withColumn("p", pretty(F.col("e.path"), F.col("oriented"), F.expr("substring(target, e.locations[0].start + 1)")))
    return shown.select("read_id", "e.edit_distance", F.col("e.locations")[0]["start"].alias("start"), F.col("e.locations")[0]["end"].alias("stop"), "e.cigar", F.col("p.signs").alias("signs"))


@query()
def l1_local_align(spark, d):
    """Each oriented read against its stretch (L1 - L5); tested against a plain table."""
    pairs = _oriented_pairs(spark, d)
    return spread(pairs).select("read_id", local_align("oriented", "target").alias("a")).select("read_id", "a.*")


@query()
def l14_bisulfite(spark, d):
    """Both strands after C to T conversion, rescored."""
    out = bisulfite_align(_pairs(spark, d), "read_seq", "window_seq")
    return out.select("read_id", "strand", "score", "score2", "conversions", "mapq", "alignment.cigar")


@query()
def e1_alignments(spark, d):
    """The whole plan: reads and genome to alignments."""
    r = table(spark, d, "read_records").select("read_id", "file_id", "read_id_in_file", F.upper("seq").alias("seq")).distinct()
    return mapper.alignments(r, table(spark, d, "genome")).select("read_id", "chrom_id", "pos", "strand", "score", "mapq", "cigar", "conversions")


@query()
def l7_better_strand(spark, d):
    """Each read against its stretch, on the strand that scores more."""
    return better_strand(_pairs(spark, d), "read_seq", "window_seq").select("read_id", "strand", "alignment.score", "alignment.cigar")


@query(f"WITH {_R} SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, replace(seq, 'C', 'T') AS converted, regexp_matches(seq, '[^ACGTacgt]') AS ambiguous, CAST(greatest(length(seq) - 7, 0) AS INT) AS n FROM r WHERE seq IS NOT NULL")
def sql_functions(spark, d):
    """The functions by their SQL names."""
    register_functions(spark)
    reads(spark, d).createOrReplaceTempView("strandline_reads")
    return spark.sql("SELECT read_id, revcomp(seq) AS rc, three_letter(seq) AS converted, is_ambiguous(seq) AS ambiguous, cast(size(kmers(seq, 8)) AS INT) AS n FROM strandline_reads WHERE seq IS NOT NULL")


@query("SELECT date_trunc('hour', mapped_at)::TIMESTAMP::VARCHAR AS start, count(*) FILTER (coalesce(orientation IN (1, 2), false)) AS mapped, count(*) FILTER (NOT coalesce(orientation IN (1, 2), false)) AS unmapped FROM (SELECT DISTINCT ON (read_id, mapped_at) * FROM mapped_reads) WHERE mapped_at IS NOT NULL GROUP BY 1")
def stream_hits_per_hour(spark, d):
    """Hits as a stream, repeated ones dropped, counted by hour of event time."""
    hits_ = distinct_hits(stream_table(spark, f"{d}/mapped_reads.parquet"), "365 days")
    counted = run_to_files(hits_, scratch(spark, "hits"), scratch(spark, "log"))
    return hits_per_window(counted, delay=None).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "mapped", "unmapped")


@query(SQL["a8_best_hits"])
def stream_best_hits(spark, d):
    """All reads as a stream, mapped batch by batch, the best hit over all batches; F3 counts within a batch."""
    stream = stream_table(spark, f"{d}/read_records.parquet").select("read_id", "file_id", "read_id_in_file", F.upper("seq").alias("seq")).filter(F.col("seq").isNotNull())
    path = scratch(spark, "mapped")
    map_stream(stream, table(spark, d, "genome"), path, scratch(spark, "log"), Options(num_hash_functions=4, min_table_hits=2)).awaitTermination()
    return merged_hits(spark, path).select("read_id", "hamming", "chrom_id", "pos", "orientation", "shift")


@query(SQL["a8_best_hits"])
def stream_all_best_hits(spark, d):
    """The same under its earlier name."""
    return stream_best_hits(spark, d)
