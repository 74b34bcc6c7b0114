"""Queries for the functions on sequences, CIGAR strings, qualities and arrays, over whole tables (F, W, O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import sequence as S
from ..operators.minhash import murmur64_column
from ..operators.windows import load_genome, numbered_windows, window_batches, window_counts, windows
from ..shared import table
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

_R = "r AS (SELECT DISTINCT read_id, file_id, read_id_in_file, header, upper(seq) AS seq, qual FROM read_records)"
_G = "g AS (SELECT DISTINCT chrom_id, name, upper(coalesce(seq, '')) AS seq, profile_id FROM genome)"


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Reads, each once, in upper case."""
    return table(spark, d, "read_records").select("read_id", "file_id", "read_id_in_file", "header", F.upper("seq").alias("seq"), "qual").distinct()


def genome(spark: SparkSession, d: str) -> DataFrame:
    return load_genome(table(spark, d, "genome"))


@query("SELECT DISTINCT read_id, upper(seq) AS seq FROM read_records")
def f1_upper(spark, d):
    return table(spark, d, "read_records").select("read_id", S.upper("seq").alias("seq")).distinct()


@query(f"WITH {_R} SELECT read_id, array_to_string(CASE WHEN header LIKE '%:' OR header = '' THEN string_split(header, ':')[:-2] ELSE string_split(header, ':') END, '|') AS parts FROM r")
def f2_split(spark, d):
    return reads(spark, d).select("read_id", F.array_join(S.split_tokens("header", ":"), "|").alias("parts"))


@query("""WITH r AS (SELECT DISTINCT read_id, file_id, read_id_in_file, upper(seq) AS u FROM read_records WHERE seq IS NOT NULL),
    b AS (SELECT *, CAST(coalesce(sum(len(regexp_replace(u, '[ACGT]', '', 'g'))) OVER (PARTITION BY file_id, read_id_in_file // 65536 ORDER BY read_id_in_file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n FROM r)
    SELECT read_id, coalesce(array_to_string(list_transform(string_split(u, ''), lambda c, i: CASE WHEN c IN ('A', 'C', 'G', 'T') OR c = '' THEN c ELSE substr('ACGT', CAST((n + len(regexp_replace(u[:i - 1], '[ACGT]', '', 'g'))) % 4 AS INT) + 1, 1) END), ''), '') AS clean,
        regexp_matches(u, '[^ACGT]') AS ambiguous FROM b""")
def f3_clean_reads(spark, d):
    rows = reads(spark, d).filter(F.col("seq").isNotNull())
    return S.clean_reads(rows).select("read_id", "clean", "ambiguous")


@query("SELECT DISTINCT read_id, regexp_matches(seq, '[^ACGTacgt]') AS ambiguous FROM read_records")
def f4_ambiguous(spark, d):
    return table(spark, d, "read_records").select("read_id", S.is_ambiguous("seq").alias("ambiguous")).distinct()


@query(f"WITH {_R} SELECT read_id, translate(seq, 'ACGT', 'TGCA') AS seq FROM r")
def f5_complement(spark, d):
    return reads(spark, d).select("read_id", S.complement("seq").alias("seq"))


@query(f"WITH {_R} SELECT read_id, CAST(len(regexp_replace(seq, '[CG]', '', 'g')) AS BIGINT) AS n_at FROM r")
def f6_at_bases(spark, d):
    return reads(spark, d).select("read_id", F.size(F.filter(F.split("seq", ""), lambda c: (c != "") & S.is_at(c))).cast("long").alias("n_at")).withColumn("n_at", F.when(F.col("n_at") >= 0, F.col("n_at")))


@query(f"WITH {_R} SELECT read_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM r")
def f7_reverse_complement(spark, d):
    return reads(spark, d).select("read_id", S.reverse_complement("seq").alias("seq"))


_CODE = "CAST(list_sum(list_transform(string_split({0}, ''), lambda c, i: CASE c WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END * CAST(4 ^ (len({0}) - i) AS BIGINT))) AS BIGINT)"


@query(f"""WITH {_R}, w AS (SELECT read_id, i, seq[31 * i + 1:31 * i + 31] AS s FROM (SELECT *, unnest(range((length(seq) + 30) // 31)) AS i FROM r)), k AS (SELECT read_id, list({_CODE.format('s')} ORDER BY i) AS codes FROM w GROUP BY 1)
    SELECT read_id, CASE WHEN seq = '' THEN '' ELSE array_to_string(codes, ',') END AS codes, regexp_replace(seq, '[^ACGT]', 'A', 'g') AS decoded FROM r LEFT JOIN k USING (read_id)""")
def f9_encode_2bit(spark, d):
    """Whole reads as words of up to 31 letters, and back."""
    n = F.length("seq")
    at = F.when(n > 0, F.sequence(F.lit(0), F.expr("(length(seq) - 1) div 31").cast("int"))).when(n == 0, F.array().cast("array<int>"))
    piece = lambda i: F.substring(F.col("seq"), i * 31 + 1, F.lit(31))
    words = F.transform(at, lambda i: F.struct(S.encode_2bit(piece(i)).alias("code"), F.length(piece(i)).alias("n")))
    coded = reads(spark, d).select("read_id", words.alias("w"))
    return coded.select("read_id", F.array_join("w.code", ",").alias("codes"), F.array_join(F.transform("w", lambda x: S.decode_2bit(x["code"], x["n"])), "").alias("decoded"))


@query(SQL["f9_encode_2bit"])
def f9_encode_words(spark, d):
    """The same under its earlier name."""
    return f9_encode_2bit(spark, d)


@query(f"WITH {_R}, c AS (SELECT read_id, regexp_replace(seq, '[^ACGT]', 'A', 'g') AS s FROM r) SELECT read_id, translate(s, 'ACGT', '0011') AS hi, translate(s, 'ACGT', '0101') AS lo, s AS decoded FROM c")
def f10_bit_planes(spark, d):
    planes = reads(spark, d).select("read_id", S.encode_planes("seq").alias("p"))
    return planes.select("read_id", "p.hi", "p.lo", S.decode_planes(F.col("p")).alias("decoded"))


@query(f"WITH {_R} SELECT read_id, replace(seq, 'C', 'T') AS seq FROM r")
def f12_three_letter(spark, d):
    return reads(spark, d).select("read_id", S.three_letter("seq").alias("seq"))


_K = f"""{_R}, k AS (SELECT read_id, CAST(i - 1 AS INT) AS place, substr(seq, i, 16) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - 14)) AS i FROM r WHERE length(seq) >= 16))"""


def _kmers(spark, d):
    return reads(spark, d).select("read_id", F.posexplode(S.kmers("seq", 16)).alias("place", "kmer"))


@query(f"WITH {_K} SELECT * FROM k")
def f14_kmers(spark, d):
    return _kmers(spark, d)


@query(f"WITH {_K} SELECT read_id, place, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer FROM k")
def f15_canonical(spark, d):
    return _kmers(spark, d).select("read_id", "place", S.canonical("kmer").alias("kmer"))


@query(f"""WITH {_G}, k AS (SELECT chrom_id, i // 113 AS window_id, substr(seq, i + 1, 16) AS kmer FROM (SELECT *, unnest(range(length(seq) - 15)) AS i FROM g WHERE length(seq) >= 16))
    SELECT chrom_id, CAST(window_id AS INT) AS window_id, count(*) AS n, count(DISTINCT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA')))) AS n_different FROM k GROUP BY ALL""")
def f16_window_kmers(spark, d):
    at = genome(spark, d).select("chrom_id", F.posexplode(S.canonical_kmers("seq", 16)).alias("at", "kmer"))
    return at.groupBy("chrom_id", F.expr("at div 113").cast("int").alias("window_id")).agg(F.count("*").alias("n"), F.countDistinct("kmer").alias("n_different"))


@query(f"""WITH a AS (SELECT DISTINCT read_id::UBIGINT AS x FROM read_records), b AS (SELECT x, xor(x, x >> 33) AS y FROM a), c AS (SELECT x, ((y::UHUGEINT * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS y FROM b),
    e AS (SELECT x, xor(y, y >> 33) AS y FROM c), f AS (SELECT x, ((y::UHUGEINT * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS y FROM e), h AS (SELECT x, xor(y, y >> 33) AS y FROM f)
    SELECT x::BIGINT AS read_id, y::VARCHAR AS hash FROM h""")
def f17_murmur(spark, d):
    hashed = table(spark, d, "read_records").select("read_id").distinct().withColumn("h", murmur64_column("read_id"))
    return hashed.select("read_id", F.when(F.col("h") >= 0, F.col("h").cast("decimal(20,0)")).otherwise(F.col("h").cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)")).cast("string").alias("hash"))


@query(f"WITH {_R} SELECT read_id, CAST(greatest(length(seq) - 15, 0) AS INT) AS n FROM r WHERE seq IS NOT NULL")
def f18_number_of_kmers(spark, d):
    return reads(spark, d).filter(F.col("seq").isNotNull()).select("read_id", S.n_kmers("seq", 16).alias("n"))


@query(f"""WITH {_R}, p AS (SELECT a.read_id, a.seq AS x, b.seq AS y FROM r a JOIN r b ON b.read_id = a.read_id + 1 WHERE a.seq IS NOT NULL AND b.seq IS NOT NULL)
    SELECT read_id, CAST(CASE WHEN least(length(x), length(y)) = 0 THEN 0 ELSE hamming(x[:least(length(x), length(y))], y[:least(length(x), length(y))]) END + abs(length(x) - length(y)) AS INT) AS d FROM p""")
def f19_hamming(spark, d):
    r = reads(spark, d).filter(F.col("seq").isNotNull())
    return r.select("read_id", F.col("seq").alias("x")).join(r.select((F.col("read_id") - 1).alias("read_id"), F.col("seq").alias("y")), "read_id").select("read_id", S.hamming_full("x", "y").cast("int").alias("d"))


@query("""WITH m AS (SELECT DISTINCT read_id, window_pos, CAST(2 * read_len AS DOUBLE) AS a, CAST(abs(hamming) AS DOUBLE) AS b FROM mapped_reads WHERE read_len >= 0 AND hamming IS NOT NULL)
    SELECT read_id, window_pos, CAST(CASE WHEN a = 0 THEN 0 WHEN 1 - abs(a - b) / a <= 0 THEN 254 ELSE least(254, greatest(0, floor(floor(-4.343 * ln(1 - abs(a - b) / a)) + 4.99))) END AS INT) AS mapq FROM m""")
def f20_mapq(spark, d):
    m = table(spark, d, "mapped_reads").filter("read_len >= 0 AND hamming IS NOT NULL").select("read_id", "window_pos", (F.col("read_len") * 2).alias("a"), F.abs("hamming").alias("b")).distinct()
    return m.select("read_id", "window_pos", S.mapq("a", "b").alias("mapq"))


@query(f"""WITH {_R} SELECT read_id, CAST(list_sum(list_transform(string_split(seq, ''), lambda c, i: CASE WHEN c = seq[length(seq) + 1 - i] AND c IN ('A', 'C', 'G', 'T') THEN 2 ELSE -2 END)) AS BIGINT) AS score FROM r WHERE length(seq) > 0""")
def f21_substitution(spark, d):
    r = reads(spark, d).filter(F.length("seq") > 0)
    scores = F.zip_with(F.split("seq", ""), F.split(F.reverse("seq"), ""), lambda a, b: S.substitution(a, b))
    return r.select("read_id", F.aggregate(scores, F.lit(0).cast("long"), lambda a, x: a + x).alias("score"))


_CIGARS = "c AS (SELECT DISTINCT read_id, concat(shift, 'S', read_len, 'M', hamming, CASE WHEN hamming % 2 = 0 THEN 'I' ELSE 'D' END, window_pos, '=') AS cigar FROM mapped_reads WHERE shift >= 0 AND hamming >= 0 AND read_len >= 0)"


def _cigars(spark, d):
    m = table(spark, d, "mapped_reads").filter("shift >= 0 AND hamming >= 0 AND read_len >= 0")
    text = lambda c: F.col(c).cast("string")
    return m.select("read_id", F.concat(text("shift"), F.lit("S"), text("read_len"), F.lit("M"), text("hamming"), F.when(F.col("hamming") % 2 == 0, "I").otherwise("D"), text("window_pos"), F.lit("=")).alias("cigar")).distinct()


@query(f"WITH {_CIGARS}, e AS (SELECT read_id, cigar, unnest(regexp_extract_all(cigar, '\\d+[MIDSHNPX=]')) AS e, unnest(range(4)) AS place FROM c) SELECT read_id, cigar, CAST(place AS INT) AS place, e[-1] AS op, CAST(e[:-2] AS INT) AS len FROM e")
def f22_parse_cigar(spark, d):
    return _cigars(spark, d).select("read_id", "cigar", F.posexplode(S.parse_cigar("cigar")).alias("place", "e")).select("read_id", "cigar", "place", "e.op", "e.len")


@query(f"WITH {_CIGARS} SELECT read_id, cigar, cigar AS again FROM c")
def f23_format_cigar(spark, d):
    return _cigars(spark, d).select("read_id", "cigar", S.format_cigar(S.parse_cigar("cigar")).alias("again"))


@query(f"""WITH {_R}, b AS (SELECT read_id, unnest(string_split(seq, '')) AS b, unnest(range(length(seq))) AS i FROM r WHERE length(seq) > 0),
    n AS (SELECT *, i - row_number() OVER (PARTITION BY read_id, b ORDER BY i) AS z FROM b), x AS (SELECT read_id, min(i) AS i, concat(count(*), b) AS t FROM n GROUP BY read_id, b, z)
    SELECT read_id, string_agg(t, '' ORDER BY i) AS runs FROM x GROUP BY read_id""")
def f24_run_lengths(spark, d):
    return reads(spark, d).filter(F.length("seq") > 0).select("read_id", S.run_lengths("seq").alias("runs"))


_BIN = "array_to_string(list_transform(string_split(qual, ''), lambda c: CASE WHEN ascii(c) - 33 <= {0}), '')"


@query(f"WITH {_R} SELECT read_id, {_BIN.format("13 THEN '(' ELSE '5' END")} AS one, {_BIN.format("4 THEN '$' WHEN ascii(c) - 33 <= 13 THEN '(' WHEN ascii(c) - 33 <= 20 THEN '1' ELSE '9' END")} AS two, qual AS eight FROM r WHERE length(qual) > 0")
def f26_quality_bins(spark, d):
    return reads(spark, d).filter(F.length("qual") > 0).select("read_id", S.quality_bins("qual", 1).alias("one"), S.quality_bins("qual", 2).alias("two"), S.quality_bins("qual", 8).alias("eight"))


@query("""WITH t AS (SELECT DISTINCT read_id, read_len, concat(read_len, CASE read_id % 4 WHEN 0 THEN 'K' WHEN 1 THEN 'M' WHEN 2 THEN 'G' ELSE '' END) AS t FROM mapped_reads WHERE read_len >= 0)
    SELECT read_id, t, CAST(read_len::BIGINT * CASE read_id % 4 WHEN 0 THEN 1024 WHEN 1 THEN 1048576 WHEN 2 THEN 1073741824 ELSE 1 END AS BIGINT) AS bytes FROM t""")
def f27_memory_bytes(spark, d):
    unit = F.element_at(F.array(F.lit("K"), F.lit("M"), F.lit("G"), F.lit("")), (F.col("read_id") % 4 + 1).cast("int"))
    t = table(spark, d, "mapped_reads").filter("read_len >= 0").select("read_id", F.concat(F.col("read_len").cast("string"), unit).alias("t")).distinct()
    return t.select("read_id", "t", S.memory_bytes("t").alias("bytes"))


@query(f"WITH {_G} SELECT chrom_id, name, seq, CAST(length(seq) AS INT) AS len FROM g")
def s9_genome(spark, d):
    return genome(spark, d).select("chrom_id", "name", "seq", "len")


@query(f"WITH {_G} SELECT chrom_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM g")
def s10_reverse_genome(spark, d):
    return genome(spark, d).select("chrom_id", S.reverse_complement("seq").alias("seq"))


_W = f"""{_G}, n AS (SELECT chrom_id, CAST(ceil(length(seq) / 113) AS INT) AS n_windows FROM g), f AS (SELECT *, CAST(coalesce(sum(n_windows) OVER (ORDER BY chrom_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_window FROM n),
    w AS (SELECT chrom_id, CAST(i AS INT) AS window_id, CAST(i * 113 AS INT) AS pos, substr(seq, i * 113 + 1, 128) AS seq FROM (SELECT *, unnest(range(CAST(ceil(length(seq) / 113) AS BIGINT))) AS i FROM g))"""


@query(f"WITH {_W} SELECT * FROM f")
def w1_window_counts(spark, d):
    return window_counts(genome(spark, d), 16, 128)


@query(f"WITH {_W} SELECT *, CAST(length(seq) AS INT) AS len FROM w")
def w2_windows(spark, d):
    return windows(genome(spark, d), 16, 128)


@query(f"WITH {_W} SELECT w.*, CAST(length(seq) AS INT) AS len, first_window + window_id AS global_window_id FROM w JOIN f USING (chrom_id)")
def w3_numbered_windows(spark, d):
    return numbered_windows(genome(spark, d), 16, 128)


@query(f"WITH {_W} SELECT chrom_id, CAST(window_id // 64 AS INT) AS batch, count(*) AS n, min(pos) AS first_pos FROM w GROUP BY ALL")
def w4_window_batches(spark, d):
    return window_batches(numbered_windows(genome(spark, d), 16, 128), 64).groupBy("chrom_id", "batch").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query(f"WITH {_W} SELECT chrom_id, window_id, pos FROM w ORDER BY chrom_id, pos LIMIT 500")
def w5_first_windows(spark, d):
    return windows(genome(spark, d), 16, 128, limit=500).select("chrom_id", "window_id", "pos")


_E = f"""{_W}, l AS (SELECT w.chrom_id, w.pos, length(g.seq) AS n, g.seq AS whole FROM w JOIN g USING (chrom_id)), e AS (SELECT *, CASE WHEN 50 < pos THEN 50 ELSE 0 END AS l,
    CASE WHEN pos + 128 > n THEN 0 WHEN pos + 178 < n THEN 50 ELSE n - pos - 128 END AS r FROM l)"""


@query(f"WITH {_E} SELECT chrom_id, pos, CAST(pos - l AS INT) AS start, CAST(least(128, n - pos) + l + r AS INT) AS len, substr(whole, pos - l + 1, least(128, n - pos) + l + r) AS seq FROM e")
def w6_extended_windows(spark, d):
    g = genome(spark, d)
    w = windows(g, 16, 128).select("chrom_id", "pos").join(g.select("chrom_id", "seq", F.col("len").alias("n")), "chrom_id").withColumn("e", S.extend_window("pos", 128, 50, "n"))
    return w.select("chrom_id", "pos", "e.start", "e.len", F.substring("seq", F.col("e.start") + 1, F.col("e.len")).alias("seq"))


@query(f"WITH {_G} SELECT read_id, window_pos, chrom_id, CAST(least(greatest(window_pos - 100, 0), length(g.seq)) AS INT) AS lo, CAST(greatest(least(greatest(window_pos - 100, 0), length(g.seq)), least(window_pos + 400, length(g.seq))) AS INT) AS hi FROM (SELECT DISTINCT read_id, chrom, window_pos FROM mapped_reads WHERE window_pos >= 0) m JOIN g ON lower(trim(chrom)) = lower(regexp_extract(name, '^\\s*(\\S+)', 1))")
def w7_sections(spark, d):
    g = genome(spark, d).select("chrom_id", F.lower(F.regexp_extract("name", r"^\s*(\S+)", 1)).alias("c"), "len")
    m = table(spark, d, "mapped_reads").filter("window_pos >= 0").select("read_id", F.lower(F.trim("chrom")).alias("c"), "chrom", "window_pos").distinct().drop("chrom")
    return m.join(g, "c").withColumn("s", S.clip_section(F.col("window_pos") - 100, F.col("window_pos") + 400, "len")).select("read_id", "window_pos", "chrom_id", F.col("s.begin").alias("lo"), F.col("s.end").alias("hi"))


#: the sets of the whole record: its two halves, and the half in the middle
_SETS = """s AS (SELECT DISTINCT chrom_id, seq, CAST((length(seq) + 1) // 2 AS INT) AS m FROM g), h AS (SELECT chrom_id, regexp_extract_all(seq[:m], '[ACGT]{3}') AS a, regexp_extract_all(seq[m + 1:], '[ACGT]{3}') AS b,
    regexp_extract_all(seq[m // 2 + 1:m // 2 + m], '[ACGT]{3}') AS c FROM s)"""


def _sets(spark, d):
    three = lambda x: F.regexp_extract_all(x, F.lit("([ACGT]{3})"), F.lit(1))
    g = genome(spark, d).withColumn("m", F.expr("(length(seq) + 1) div 2").cast("int"))
    return g.select("chrom_id", three(F.expr("left(seq, m)")).alias("a"), three(F.expr("substring(seq, m + 1)")).alias("b"), three(F.expr("substring(seq, m div 2 + 1, m)")).alias("c"))


def _join(x):
    return F.array_join(x, ",")


@query(f"""WITH {_G}, {_SETS} SELECT chrom_id, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))), ',') AS difference, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: list_contains(b, x))), ',') AS intersection,
    array_to_string(list_sort(list_concat(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x)), list_filter(list_distinct(b), lambda x: NOT list_contains(a, x)))), ',') AS symmetric,
    array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS both, array_to_string(list_sort(list_concat(a, b)), ',') AS merged FROM h""")
def o1_set_operations(spark, d):
    a, b = F.col("a"), F.col("b")
    return _sets(spark, d).select("chrom_id", _join(A.difference(a, b)).alias("difference"), _join(A.intersection(a, b)).alias("intersection"), _join(A.symmetric_difference(a, b)).alias("symmetric"), _join(A.union(a, b)).alias("both"), _join(A.merged(a, b)).alias("merged"))


@query(f"""WITH {_G}, {_SETS} SELECT chrom_id, array_to_string(list_sort(list_distinct(list_concat(a, b, c))), ',') AS all_, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: list_contains(b, x) AND list_contains(c, x))), ',') AS common,
    array_to_string(list_sort(list_concat(a, b, c)), ',') AS merged FROM h""")
def o2_many_sets(spark, d):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return _sets(spark, d).select("chrom_id", _join(A.union(a, b, c)).alias("all_"), _join(A.intersection(a, b, c)).alias("common"), _join(A.merged(a, b, c)).alias("merged"))


@query(f"""WITH {_G}, {_SETS}, m AS (SELECT chrom_id, list_concat(a, b) AS m, a FROM h), f AS (SELECT *, list_sort(list_filter(list_distinct(m), lambda x: len(list_filter(m, lambda y: y = x)) >= 6)) AS f FROM m)
    SELECT chrom_id, array_to_string(f, ',') AS frequent, CASE WHEN len(f) > 12 THEN '' ELSE array_to_string(f, ',') END AS few, array_to_string(list_sort(list_filter(a, lambda x: len(list_filter(a, lambda y: y = x)) >= 4)), ',') AS repeated, array_to_string(list_sort(list_distinct(a))[:10], ',') AS first_ten FROM f""")
def o5_counted_sets(spark, d):
    a, b = F.col("a"), F.col("b")
    return _sets(spark, d).select("chrom_id", _join(A.frequent([a, b], 6)).alias("frequent"), _join(A.frequent([a, b], 6, 12)).alias("few"), _join(A.repeated(a, 4)).alias("repeated"), _join(A.first_n(A.union(a), 10)).alias("first_ten"))


@query(SQL["o1_set_operations"])
def o1_all_set_operations(spark, d):
    """The same under its earlier name."""
    return o1_set_operations(spark, d)


@query(SQL["o2_many_sets"])
def o2_all_many_sets(spark, d):
    """The same under its earlier name."""
    return o2_many_sets(spark, d)


@query(SQL["o5_counted_sets"])
def o5_all_counted_sets(spark, d):
    """The same under its earlier name."""
    return o5_counted_sets(spark, d)
