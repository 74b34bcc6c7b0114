"""Queries that write whole tables in a file format and read them again (S, K), and the remaining filters and joins (P, J, A, T)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import evaluate as E
from ..operators.align import edit_align, local_align
from ..operators.minhash import kmer_lists, minhash
from ..operators.variants import is_variant, variant_counts
from ..shared import scratch, spread, table
from ..sources import tables as X
from ..sources.fastx import broken_records, paired, read_fastx, sniff, write_fastx
from . import relational_queries as R
from .registry import Registry
from .scalar_queries import _G, _R, genome, reads

query = Registry()
QUERIES, SQL = query.queries, query.sql


# files


@query(f"WITH {_G} SELECT chrom_id, regexp_extract(name, '^\\s*(\\S+)', 1) AS header, seq FROM g WHERE length(seq) > 0")
def s1_genome_file(spark, d):
    """The genome as a FASTA file of lines of 60 letters, read by the record parser (S1 - S5, S9); the header's first word is the id."""
    path = scratch(spark, "fasta")
    g = genome(spark, d).filter("len > 0")
    lines = F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")
    g.select(F.concat(F.lit(">"), "chrom_id", F.lit(" "), F.regexp_extract("name", r"^\s*(\S+)", 1), F.lit("\n"), lines).alias("value")).write.text(path)
    parts = F.split("header", " ")
    return read_fastx(spark, path, "STOP").select(parts[0].cast("int").alias("chrom_id"), parts[1].alias("header"), "seq")


@query(f"WITH {R._H} SELECT read_id::VARCHAR AS qname, CASE WHEN orientation = 2 THEN 16 ELSE 0 END AS flag, chrom AS rname, pos + 1 AS pos, least(254, 60 - hamming) AS mapq, concat(n, 'M') AS cigar, oriented AS seq FROM h WHERE n > 0")
def s12_sam_round_trip(spark, d):
    path = scratch(spark, "sam")
    R.k1_sam_lines(spark, d).write.text(path)
    return X.read_sam(spark, path).select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq")


@query(f"WITH {R._VS} SELECT DISTINCT file_id AS sample, pos, ref, alt FROM v")
def s14_variant_files(spark, d):
    """Each sample's variants as its own CSV files (K4), read together."""
    path = scratch(spark, "variants")
    rows = R.sample_variants(spark, d).select("pos", "ref", "alt", F.col("file_id").alias("sample")).distinct()
    rows.repartition("sample").write.partitionBy("sample").csv(path)
    return X.read_variants(spark, f"{path}/*", r"sample=(\d+)").select(F.col("sample").cast("int").alias("sample"), "pos", "ref", "alt")


@query(f"WITH {R._VS} SELECT pos, ref, alt, count(*) AS n FROM v GROUP BY ALL")
def k5_count_file(spark, d):
    path = scratch(spark, "counts")
    X.write_variants(variant_counts(R.sample_variants(spark, d)), path, counts=True)
    return spark.read.csv(path, schema="pos int, ref string, alt string, n long")


@query("SELECT DISTINCT read_id, CAST(orientation AS INT) AS orientation, trim(chrom) AS chrom, window_pos, shift, read_len FROM mapped_reads WHERE orientation IN (1, 2) AND trim(chrom) <> ''")
def s17_mapper_file(spark, d):
    path = scratch(spark, "mapped")
    m = table(spark, d, "mapped_reads").filter("orientation IN (1, 2) AND trim(chrom) <> ''").select("read_id", F.col("orientation").cast("int").alias("orientation"), F.trim("chrom").alias("chrom"), "window_pos", "shift", "read_len").distinct()
    m.write.csv(path, sep="\t")
    return X.read_mapped(spark, path)


@query(f"WITH {_R}, x AS {R._hash_sql('r', 'read_id')} SELECT * FROM x WHERE h < 2")
def s19_stored_signatures(spark, d):
    """Signatures as a Parquet store (S18, S19), of which two of four hash functions are loaded."""
    path = scratch(spark, "signatures")
    X.save(minhash(reads(spark, d), ["read_id"], "seq", 16, 4), path)
    return X.load_signatures(spark, path, 2)


@query(f"WITH {R._VS}, k AS (SELECT chrom, pos, ref, alt, count(*) AS n FROM v GROUP BY ALL) SELECT chrom, pos, ref, alt, concat('g', n) AS gene FROM k")
def s20_known_file(spark, d):
    path = scratch(spark, "known")
    v = R.sample_variants(spark, d).join(genome(spark, d).select("chrom_id", F.regexp_extract("name", r"^\s*(\S+)", 1).alias("chrom")), "chrom_id")
    v.groupBy("chrom", "pos", "ref", "alt").agg(F.concat(F.lit("g"), F.count("*").cast("string")).alias("gene")).write.csv(path, sep=";")
    return X.read_known(spark, path)


@query(f"WITH {R._T} SELECT chrom_id, window_id, true_hits, false_hits FROM st")
def k8_hit_file(spark, d):
    path = scratch(spark, "hits")
    E.window_hits(R._hit_windows(spark, d), R._truth(spark, d)).write.csv(path, sep=" ")
    return spark.read.csv(path, sep=" ", schema="chrom_id int, window_id int, true_hits long, false_hits long")


@query(f"WITH {_R} SELECT concat(CASE WHEN any_bare THEN 'FASTA' ELSE 'FASTQ' END, 'GZ') AS kind, count(*) AS n FROM (SELECT (length(qual) = length(seq)) IS NOT TRUE AS any_bare FROM r WHERE length(seq) > 0) GROUP BY 1")
def s4_sniffed_files(spark, d):
    """All reads written as compressed files of either kind; the kind is found from the first records, the number from all."""
    out = None
    rows = reads(spark, d).filter(F.length("seq") > 0)
    good = F.coalesce(F.length("qual") == F.length("seq"), F.lit(False))
    for part in (rows.filter(good), rows.filter(~good).withColumn("qual", F.lit(None).cast("string"))):
        path = scratch(spark, "sniff")
        write_fastx(part, path, compressed=True)
        back = read_fastx(spark, path)
        first = back.select("path").head()
        kind = sniff(first["path"]) if first else "NONE"
        counted = back.groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


@query(f"WITH {_R}, b AS (SELECT *, length(qual) = length(seq) AND length(seq) > 3 AS fq, read_id_in_file % 40 = 39 AS bad FROM r WHERE length(seq) > 0 AND header IS NOT NULL), n AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY read_id_in_file, read_id) - 1 AS i, fq AND bad AS broken FROM b) SELECT file_id, min(i) AS read_id_in_file, CAST(-2 AS INT) AS code FROM n WHERE broken GROUP BY 1")
def s5_broken_records(spark, d):
    """Each file of reads written as a file with some qualities cut short, and the record at which a reader stops."""
    path = scratch(spark, "broken")
    r = reads(spark, d).filter((F.length("seq") > 0) & F.col("header").isNotNull())
    fq = F.coalesce((F.length("qual") == F.length("seq")) & (F.length("seq") > 3), F.lit(False))
    qual = F.when(fq & (F.col("read_id_in_file") % 40 == 39), F.expr("left(qual, length(qual) - 2)")).when(fq, F.col("qual"))
    text = F.concat(F.when(fq, F.lit("@")).otherwise(F.lit(">")), F.lit("r"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"), F.when(fq, F.concat(F.lit("\n+\n"), qual)).otherwise(""))
    r.select("file_id", "read_id_in_file", "read_id", text.alias("value")).repartition("file_id").sortWithinPartitions("file_id", "read_id_in_file", "read_id").select("value", "file_id").write.partitionBy("file_id").text(path)
    files = ",".join(f"{path}/{f}" for f in sorted(r.select(F.concat(F.lit("file_id="), "file_id")).distinct().toPandas().iloc[:, 0]))  # a name for each file
    return broken_records(spark, files).select(F.regexp_extract("path", r"file_id=(\d+)", 1).cast("int").alias("file_id"), "read_id_in_file", "code")


@query(f"WITH {_R}, n AS (SELECT file_id, max(read_id_in_file) + 1 AS n FROM r GROUP BY 1) SELECT file_id, read_id_in_file // 2 AS pair_id, CAST(read_id_in_file % 2 + 1 AS INT) AS mate, read_id FROM r JOIN n USING (file_id) WHERE read_id_in_file < n - n % 2")
def s7_one_file_pairs(spark, d):
    return paired(reads(spark, d)).select("file_id", "pair_id", "mate", "read_id")


@query("WITH m AS (SELECT DISTINCT file_id, run, bam FROM run_metadata WHERE bam IS NOT NULL) SELECT run, bam, concat(run, '_', regexp_replace(bam, '\\.bam$', '')) AS file, count(*) AS n FROM m GROUP BY ALL")
def s15_metadata_file(spark, d):
    """The metadata as a file, read by the operator."""
    path = scratch(spark, "metadata")
    table(spark, d, "run_metadata").filter("bam IS NOT NULL").select("file_id", "run", "bam").distinct().select("run", "bam").write.csv(path, sep="\t")
    return X.read_metadata(spark, path).groupBy("run", "bam", "file").agg(F.count("*").alias("n"))


#: hits without gaps, as alignments of their whole text; the second score and the lack of a hit by a rule
_K9 = f"""{R._H}, k AS (SELECT *, substr(whole, pos + 1, CAST(least(n, len - pos) AS INT)) AS t, CASE WHEN read_id % 11 = 0 THEN 0 ELSE 2 * n - CAST(hamming AS BIGINT) END AS score, CASE WHEN read_id % 3 = 0 THEN 0 ELSE n // 2 END AS score2 FROM h WHERE n > 0 AND pos + n <= len)"""


def _aligned(spark, d):
    h = R.hits(spark, d).filter("n > 0 AND pos + n <= len")
    h = R.stretched(spark, d, h, F.col("pos"), F.col("n"), "ref")
    scored = h.withColumn("score", F.when(F.col("read_id") % 11 == 0, 0).otherwise(2 * F.col("n") - F.col("hamming"))).withColumn("score2", F.when(F.col("read_id") % 3 == 0, 0).otherwise(F.expr("n div 2")))
    return scored.withColumn("reverse", F.col("orientation") == 2).withColumn("cigar", F.concat(F.col("n").cast("string"), F.lit("M")))


@query(f"""WITH {_K9} SELECT CASE WHEN score = 0 THEN concat(read_id, chr(9), array_to_string(['4', '*', '0', '255', '*', '*', '0', '0', '*', '*'], chr(9)))
    ELSE concat_ws(chr(9), read_id, CASE WHEN orientation = 2 THEN 16 ELSE 0 END, chrom, pos + 1, 60, concat(n, 'M'), '*', '0', '0', oriented, CASE WHEN length(qual) > 0 THEN CASE WHEN orientation = 2 THEN reverse(qual) ELSE qual END ELSE '*' END, concat('AS:i:', score), concat('NM:i:', hamming)) || CASE WHEN score2 > 0 THEN concat(chr(9), 'ZS:i:', score2) ELSE '' END END AS value FROM k""")
def k9_sam_lines(spark, d):
    """Local alignments with AS, NM and ZS tags (K9)."""
    rows = _aligned(spark, d).select("read_id", "reverse", "chrom", F.col("pos").alias("ref_begin"), F.lit(60).alias("mapq"), "cigar", F.col("read").alias("seq"), "qual", "score", "score2", F.col("hamming").alias("mismatches"))
    return X.aligner_sam_lines(rows)


@query(f"""WITH {_K9}, x AS (SELECT *, array_to_string(list_transform(range(n), lambda i: CASE WHEN t[CAST(i AS INT) + 1] = oriented[CAST(i AS INT) + 1] THEN '|' ELSE '*' END), '') AS signs FROM k)
    SELECT read_id, concat('target_name: ', chrom, chr(10), 'query_name: ', read_id, chr(10), 'optimal_alignment_score: ', score, chr(9), CASE WHEN score2 > 0 THEN concat('suboptimal_alignment_score: ', score2, chr(9)) ELSE '' END, 'strand: ', CASE WHEN orientation = 2 THEN '-' ELSE '+' END,
        chr(9), 'target_begin: 1', chr(9), 'target_end: ', n, chr(9), 'query_begin: 1', chr(9), 'query_end: ', n, chr(10), chr(10),
        array_to_string(list_transform(range((n + 59) // 60), lambda i: concat('Target: ', lpad(CAST(i * 60 + 1 AS VARCHAR), 8, ' '), '    ', substr(t, CAST(i * 60 + 1 AS INT), 60), '    ', least(n, i * 60 + 60), chr(10), repeat(' ', 20), substr(signs, CAST(i * 60 + 1 AS INT), 60), chr(10),
            'Query:  ', lpad(CAST(i * 60 + 1 AS VARCHAR), 8, ' '), '    ', substr(oriented, CAST(i * 60 + 1 AS INT), 60), '    ', least(n, i * 60 + 60), chr(10), chr(10))), '')) AS value FROM x""")
def k9_alignment_text(spark, d):
    """Alignments as readable text, in blocks of 60 letters (K9)."""
    rows = _aligned(spark, d).select(
        "read_id", "reverse", "chrom", "score", "score2", F.lit(0).alias("ref_begin"), (F.col("n") - 1).alias("ref_end"), F.lit(0).alias("query_begin"), (F.col("n") - 1).alias("query_end"), "cigar", F.col("oriented").alias("query"), "ref"
    )
    return X.alignment_text(rows)


@query("SELECT read_id, flag FROM (SELECT DISTINCT read_id, CASE WHEN read_id % 5 = 0 THEN 256 WHEN read_id % 7 = 0 THEN 2064 WHEN orientation = 2 THEN 16 ELSE 0 END AS flag FROM mapped_reads WHERE window_pos >= 0 AND orientation IN (1, 2)) WHERE flag < 256")
def filter_p9_primary(spark, d):
    """Primary alignments of SAM rows with secondary and supplementary flags among them."""
    m = table(spark, d, "mapped_reads").filter("window_pos >= 0 AND orientation IN (1, 2)")
    flag = F.when(F.col("read_id") % 5 == 0, 256).when(F.col("read_id") % 7 == 0, 2064).when(F.col("orientation") == 2, 16).otherwise(0)
    return E.primary(m.select("read_id", flag.alias("flag")).distinct())


# filters


@query(f"WITH {_R} SELECT read_id FROM r WHERE length(seq) >= 16 AND NOT regexp_matches(seq, '[^ACGT]')")
def filter_p2_valid(spark, d):
    flagged = reads(spark, d).withColumn("valid", (F.length("seq") >= 16) & ~S.is_ambiguous("seq"))
    return flagged.filter("valid").select("read_id")


@query("SELECT DISTINCT read_id, hamming FROM mapped_reads WHERE coalesce(orientation, 3) <> 3")
def filter_p5_mapped(spark, d):
    return table(spark, d, "mapped_reads").filter(F.coalesce("orientation", F.lit(3)) != 3).select("read_id", "hamming").distinct()


@query("SELECT DISTINCT read_id, CAST(least(254, 60 - 5 * hamming) AS INT) AS mapq FROM mapped_reads WHERE hamming >= 0 AND 60 - 5 * hamming >= 20")
def filter_p6_mapq(spark, d):
    return table(spark, d, "mapped_reads").filter("hamming >= 0").select("read_id", F.least(F.lit(254), 60 - 5 * F.col("hamming")).alias("mapq")).filter(F.col("mapq") >= 20).distinct()


@query(f"WITH {R._H} SELECT read_id, i AS place, whole[pos + i + 1] AS ref, oriented[i + 1] AS alt FROM (SELECT *, CAST(unnest(range(least(n, len - pos))) AS INT) AS i FROM h WHERE n > 0) WHERE whole[pos + i + 1] IN ('A', 'C', 'G', 'T') AND oriented[i + 1] IN ('A', 'C', 'G', 'T') AND whole[pos + i + 1] <> oriented[i + 1]")
def filter_p7_bases(spark, d):
    h = R.stretched(spark, d, R.hits(spark, d).filter("n > 0"), F.col("pos"), F.col("n"), "ref")
    each = h.select("read_id", F.posexplode(F.arrays_zip(F.split("ref", "").alias("ref"), F.split(F.left("oriented", F.length("ref")), "").alias("alt"))).alias("place", "x")).select("read_id", "place", "x.ref", "x.alt")
    return each.filter(is_variant(F.col("ref"), F.col("alt")))


@query(f"WITH {R._P} SELECT read_id, CASE WHEN levenshtein(substr(ext, 1, length(seq)), seq) <= 60 THEN levenshtein(substr(ext, 1, length(seq)), seq) ELSE -1 END AS d FROM p")
def filter_p11_edit_bound(spark, d):
    return spread(R._pairs(spark, d)).select("read_id", edit_align("read_seq", F.expr("left(window_seq, length(read_seq))"), k=60).alias("e")).select("read_id", F.col("e.edit_distance").cast("long").alias("d"))


@query()
def filter_p10_score(spark, d):
    """Alignments whose CIGAR is only given from a score on (P10)."""
    pairs = R.stretched(spark, d, R.hits(spark, d).filter("n > 0"), F.col("pos"), F.col("n") + 10, "target").select("read_id", "oriented", "target")
    return spread(pairs).select("read_id", local_align("oriented", "target", score_filter=180, distance_filter=150).alias("a")).select("read_id", "a.score", "a.cigar")


@query(f"WITH {R._B} SELECT profile_id, h, key, count(*) - 1 AS n_others FROM b GROUP BY ALL HAVING count(*) > 1")
def filter_p12_others(spark, d):
    """The members of each bucket beside its first, which is left out as the one that asks."""
    return R._buckets(spark, d).groupBy(*R._PROFILE).agg((F.count("*") - 1).alias("n_others")).filter("n_others > 0")


# joins, aggregates, order


@query(f"WITH {R._T} SELECT hw.read_id, hw.chrom_id, hw.window_id, t.window_id = hw.window_id AS is_true FROM hw JOIN t USING (read_id)")
def j11_truth(spark, d):
    truth = R._truth(spark, d).select("read_id", F.col("window_id").alias("t"))
    return R._hit_windows(spark, d).join(truth, "read_id").select("read_id", "chrom_id", "window_id", (F.col("t") == F.col("window_id")).alias("is_true"))


@query(f"WITH {R._T}, c AS (SELECT chrom_id, window_id, count(*) AS n FROM t GROUP BY ALL) SELECT st.*, coalesce(n, 0) AS n FROM st LEFT JOIN c USING (chrom_id, window_id)")
def j12_joined_files(spark, d):
    """Hits and reads of each window side by side: by key, not by place in two files."""
    truth = R._truth(spark, d)
    n = truth.groupBy("chrom_id", "window_id").agg(F.count("*").alias("n"))
    return E.window_hits(R._hit_windows(spark, d), truth).join(n, ["chrom_id", "window_id"], "left").fillna({"n": 0})


@query(f"WITH {_R}, x AS {R._hash_sql('r', 'read_id').replace(' & 4294967295::UBIGINT)::BIGINT', ')::VARCHAR').replace('(min(', '(min(')} SELECT * FROM x")
def a2_unmasked_minhash(spark, d):
    """Least hashes of the different k-mers, not cut to 2k bits, as unsigned numbers."""
    s = minhash(reads(spark, d), ["read_id"], "seq", 16, 4, mask=False)
    whole = F.when(F.col("key") >= 0, F.col("key").cast("decimal(20,0)")).otherwise(F.col("key").cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)"))
    return s.select("read_id", "h", whole.cast("string").alias("key"))


@query(f"WITH {_R} SELECT read_id, count(DISTINCT k) AS n, count(*) AS total FROM (SELECT read_id, least(k, reverse(translate(k, 'ACGT', 'TGCA'))) AS k FROM (SELECT read_id, substr(seq, i, 12) AS k FROM (SELECT *, unnest(range(1, length(seq) - 10)) AS i FROM r WHERE length(seq) >= 12))) GROUP BY 1")
def a7_different_kmers(spark, d):
    r = reads(spark, d).filter(F.length("seq") >= 12)
    return r.select("read_id", F.size(kmer_lists("seq", 12, True)).cast("long").alias("n"), F.size(kmer_lists("seq", 12)).cast("long").alias("total"))


@query(f"WITH {R._VS}, s AS (SELECT DISTINCT chrom_id, pos, ref, alt FROM v) SELECT *, row_number() OVER (PARTITION BY chrom_id ORDER BY pos, ref, alt) AS place FROM s")
def t4_ordered_variants(spark, d):
    """Variants numbered in order inside their chromosome."""
    v = R.sample_variants(spark, d).select("chrom_id", "pos", "ref", "alt").distinct()
    ordered = v.groupBy("chrom_id", F.expr("pos div 1000").alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "alt"))).alias("v"))
    before = F.coalesce(F.sum(F.size("v")).over(Window.partitionBy("chrom_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered.withColumn("before", before).select("chrom_id", "before", F.posexplode("v").alias("i", "x")).select("chrom_id", "x.pos", "x.ref", "x.alt", (F.col("before") + F.col("i") + 1).alias("place"))
