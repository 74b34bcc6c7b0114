"""Queries whose SQL does the dynamic programs cell by cell (L), sketches (A3) and variants of gapped alignments (V1, V4), over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement, three_letter
from ..operators.align import better_strand, edit_align, local_align
from ..operators.minhash import bottom_sketch
from ..operators.variants import call_variants
from ..shared import spread
from . import relational_queries as R
from .registry import Registry
from .scalar_queries import _R, reads

query = Registry()
QUERIES, SQL = query.queries, query.sql

_LOW = -1048576


def _local_sql(pairs: str, match: int = 2, mismatch: int = 2, open_: int = 3, extend: int = 1) -> str:
    """Tables of the local scores of ``pairs`` (a query for id, q, t): a row of the score matrix a step. ``best``: id, score, score2, ref_end, query_end."""
    return f"""p AS MATERIALIZED ({pairs}),
    cells(id, j, i, h, f, top, place) USING KEY (id, j) AS (
        SELECT id, CAST(unnest(range(length(t) + 1)) AS INT), 0, 0, {_LOW}, 0, 0 FROM p WHERE q IS NOT NULL AND t IS NOT NULL
        UNION
        SELECT id, j, i + 1, greatest(now, e), f, greatest(top, now, e), CASE WHEN greatest(now, e) > top THEN i ELSE place END FROM (
            SELECT *, CASE WHEN j = 0 THEN {_LOW} ELSE max(now + {extend} * j) OVER (PARTITION BY id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {open_} - {extend} * (j - 1) END AS e FROM (
                SELECT id, j, i, f, top, place, CASE WHEN j = 0 THEN 0 ELSE greatest(0, f, before + CASE WHEN a = b AND a IN ('A', 'C', 'G', 'T') THEN {match} ELSE -{mismatch} END) END AS now FROM (
                    SELECT c.id, j, i, CASE WHEN j = 0 THEN {_LOW} ELSE greatest(h - {open_}, f - {extend}) END AS f, top, place, lag(h) OVER (PARTITION BY c.id ORDER BY j) AS before, q[i + 1] AS a, t[j] AS b
                    FROM cells c JOIN p ON p.id = c.id WHERE i < length(q))))),
    score AS (SELECT id, max(top) AS score FROM cells GROUP BY 1),
    ends AS (SELECT c.id, score, min(j) - 1 AS ref_end, arg_min(place, j) AS query_end FROM cells c JOIN score s ON s.id = c.id WHERE top = score AND score > 0 GROUP BY ALL),
    second AS (SELECT e.id, max(top) AS score2 FROM ends e JOIN cells c ON c.id = e.id JOIN p ON p.id = e.id WHERE j > 0 AND abs(j - 1 - ref_end) > greatest(length(q) // 2, 15) GROUP BY 1),
    best AS (SELECT s.id, CAST(s.score AS INT) AS score, CAST(coalesce(score2, 0) AS INT) AS score2, CAST(coalesce(ref_end, -1) AS INT) AS ref_end, CAST(coalesce(query_end, -1) AS INT) AS query_end FROM score s LEFT JOIN ends ON ends.id = s.id LEFT JOIN second ON second.id = s.id)"""


def _edit_sql(pairs: str, free: bool) -> str:
    """``ends``: id, d (the least distance) and every end (0-based) of the best places, with the start in the target ``free`` or not and its end free."""
    return f"""p AS MATERIALIZED ({pairs}),
    cells(id, j, i, d) USING KEY (id, j) AS (
        SELECT id, j, 0, {'0' if free else 'j'} FROM (SELECT id, CAST(unnest(range(length(t) + 1)) AS INT) AS j FROM p WHERE q IS NOT NULL AND t IS NOT NULL)
        UNION
        SELECT id, j, i + 1, min(now - j) OVER (PARTITION BY id ORDER BY j) + j FROM (
            SELECT id, j, i, CASE WHEN j = 0 THEN d + 1 ELSE least(d + 1, before + CASE WHEN a = b THEN 0 ELSE 1 END) END AS now FROM (
                SELECT c.id, j, i, d, lag(d) OVER (PARTITION BY c.id ORDER BY j) AS before, q[i + 1] AS a, t[j] AS b FROM cells c JOIN p ON p.id = c.id WHERE i < length(q)))),
    least_ AS (SELECT id, min(d) AS d FROM cells GROUP BY 1),
    ends AS (SELECT c.id, c.d, j - 1 AS e FROM cells c JOIN least_ l ON l.id = c.id AND l.d = c.d)"""


_ORIENTED = "SELECT read_id AS id, oriented AS q, substr(whole, CAST(greatest(pos - 40, 0) AS INT) + 1, n + 60) AS t FROM h WHERE n > 0"
_H = R._H.replace("g AS (", "RECURSIVE g AS (", 1)


@query(f"WITH {_H}, {_local_sql(_ORIENTED)} SELECT id AS read_id, score, score2, ref_end, query_end, CAST(CASE WHEN score = 0 THEN 1 ELSE 0 END AS INT) AS flag FROM best")
def l1_local_scores(spark, d):
    """Each oriented read against its stretch: both scores and the ends."""
    out = spread(R._oriented_pairs(spark, d)).withColumn("a", local_align("oriented", "target"))
    return out.select("read_id", "a.score", "a.score2", "a.ref_end", "a.query_end", "a.flag")


_TURNED = "reverse(translate(read, 'ACGT', 'TGCA'))"
_STRETCH = "substr(whole, CAST(greatest(pos - 40, 0) AS INT) + 1, n + 60)"


@query(f"""WITH {_H}, {_local_sql(f"SELECT 2 * read_id + s AS id, CASE WHEN s = 0 THEN read ELSE {_TURNED} END AS q, {_STRETCH} AS t FROM h, (SELECT unnest(range(2)) AS s) WHERE n > 0", 1, 3, 5, 2)},
    b AS (SELECT id // 2 AS read_id, max(score) FILTER (id % 2 = 0) AS f, max(score) FILTER (id % 2 = 1) AS r FROM best GROUP BY 1) SELECT read_id, CASE WHEN r > f THEN '-' ELSE '+' END AS strand, greatest(f, r) AS score FROM b""")
def l7_strand_scores(spark, d):
    """The strand that scores more, with other penalties."""
    return better_strand(R._pairs(spark, d), "read_seq", "window_seq", match=1, mismatch=3, open_=5, extend=2).select("read_id", "strand", "alignment.score")


@query(f"""WITH {_H}, {_local_sql(f"SELECT 2 * read_id + s AS id, replace(CASE WHEN s = 0 THEN read ELSE {_TURNED} END, 'C', 'T') AS q, replace({_STRETCH}, 'C', 'T') AS t FROM h, (SELECT unnest(range(2)) AS s) WHERE n > 0")}
    SELECT id // 2 AS read_id, max(score) FILTER (id % 2 = 0) AS plus, max(score) FILTER (id % 2 = 1) AS minus, max(ref_end) FILTER (id % 2 = 0) AS plus_end, max(ref_end) FILTER (id % 2 = 1) AS minus_end FROM best GROUP BY 1""")
def l14_converted_scores(spark, d):
    """Both strands after C to T conversion, before they are rescored."""
    both = spread(R._pairs(spark, d)).withColumn("ref", three_letter("window_seq")).withColumn("f", local_align(three_letter("read_seq"), F.col("ref"))).withColumn("r", local_align(three_letter(reverse_complement("read_seq")), F.col("ref")))
    return both.select("read_id", F.col("f.score").alias("plus"), F.col("r.score").alias("minus"), F.col("f.ref_end").alias("plus_end"), F.col("r.ref_end").alias("minus_end"))


def _places(spark, d, mode: str):
    found = spread(R._oriented_pairs(spark, d)).withColumn("e", edit_align("oriented", "target", mode))
    ends = F.col("e.locations.end")
    return found.select("read_id", "e.edit_distance", F.size("e.locations").cast("long").alias("n_places"), F.array_min(ends).alias("first_end"), F.array_max(ends).alias("last_end"))


_PLACES = "SELECT id AS read_id, CAST(d AS INT) AS edit_distance, count(*) AS n_places, CAST(min(e) AS INT) AS first_end, CAST(max(e) AS INT) AS last_end FROM ends GROUP BY ALL"


@query(f"WITH {_H}, {_edit_sql(_ORIENTED, True)} {_PLACES}")
def l9_all_places(spark, d):
    """Each oriented read anywhere in its stretch: distance and all ends."""
    return _places(spark, d, "HW")


@query(f"WITH {_H}, {_edit_sql(_ORIENTED, False)} {_PLACES}")
def l9_prefix_places(spark, d):
    """Each oriented read from the start of its stretch, with a free end."""
    return _places(spark, d, "SHW")


@query(f"""WITH {_R}, k AS (SELECT read_id, regexp_replace(substr(seq, i, 16), '[^ACGT]', 'A', 'g') AS k FROM (SELECT *, unnest(range(1, length(seq) - 14)) AS i FROM r WHERE length(seq) >= 16)),
    n AS (SELECT DISTINCT read_id, CAST('0b' || replace(replace(replace(replace(least(k, reverse(translate(k, 'ACGT', 'TGCA'))), 'A', '00'), 'C', '01'), 'G', '10'), 'T', '11') AS UBIGINT) AS x FROM k),
    b AS (SELECT read_id, ((xor(x, x >> 33)::UHUGEINT * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM n),
    e AS (SELECT read_id, ((xor(x, x >> 33)::UHUGEINT * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM b),
    m AS (SELECT read_id, xor(x, x >> 33) AS x FROM e), l AS (SELECT read_id, list_sort(list(x))[1:8] AS l FROM m GROUP BY 1)
    SELECT read_id, array_to_string(list_transform(l, lambda x: CASE WHEN x > 9223372036854775807 THEN CAST(x AS HUGEINT) - 18446744073709551616 ELSE CAST(x AS HUGEINT) END), ',') AS sketch FROM l""")
def a3_least_hashes(spark, d):
    """The eight least hashes of each read, in order (A3)."""
    return bottom_sketch(reads(spark, d), ["read_id"], "seq", 16, 8).select("read_id", F.array_join(F.transform("sketch", lambda x: x.cast("string")), ",").alias("sketch"))


#: hits as alignments with a clip, an insertion and a deletion at fixed places, whatever the read; aligned pairs without gaps stand in three runs (reference, query, length)
_GAPPED = f"""{R._H}, x AS (SELECT *, substr(whole, pos + 1, n + 10) AS t FROM h WHERE n > 60 AND 60 - hamming >= 58),
    runs AS (SELECT * FROM (VALUES (0, 5, 20), (20, 27, 15), (38, 42, NULL)) AS v(r, a, k)),
    s AS (SELECT chrom_id, CAST(pos + r + i AS INT) AS pos, t[CAST(r + i + 1 AS INT)] AS ref, oriented[CAST(a + i + 1 AS INT)] AS alt FROM (SELECT *, unnest(range(coalesce(k, n - 42))) AS i FROM x, runs)),
    v AS (SELECT * FROM s WHERE ref <> alt AND ref NOT IN ('N', '') AND alt NOT IN ('N', '')
        UNION ALL SELECT chrom_id, CAST(pos + 20 AS INT), t[20], oriented[25:27] FROM x UNION ALL SELECT chrom_id, CAST(pos + 35 AS INT), t[35:38], oriented[42] FROM x)"""


@query(f"WITH {_GAPPED} SELECT DISTINCT chrom_id, pos, ref, alt FROM v")
def v1_gapped_variants(spark, d):
    """Variants of alignments with M, I, D and S of at least a mapping quality (V1, V3, V4)."""
    h = R.stretched(spark, d, R.hits(spark, d).filter("n > 60"), F.col("pos"), F.col("n") + 10, "ref")
    cigar = F.concat(F.lit("5S20M2I15M3D"), (F.col("n") - 42).cast("string"), F.lit("M"))
    return call_variants(h.select("chrom_id", "pos", (60 - F.col("hamming")).alias("mapq"), cigar.alias("cigar"), F.lit("N").alias("prefix"), "ref", F.col("oriented").alias("alt")), 58)
