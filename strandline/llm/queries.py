"""Queries of the problems tagged llm, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import table
from .leaks import RADIUS, leaked_windows
from .mixing import mix_sources
from .near_reads import alike_groups, alike_pairs
from .pieces import genome_pieces
from .quality import TYPES, text_statistics, text_types
from .spans import shared_spans

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH g AS (SELECT DISTINCT chrom_id, seq, g.profile_id, window_size, min_gap FROM genome g JOIN run_options o ON g.profile_id = o.profile_id WHERE length(seq) > window_size)
    SELECT DISTINCT chrom_id, CASE WHEN list_max(list_transform(regexp_split_to_array(seq, CASE min_gap WHEN 10 THEN '[Nn-]{10,}' WHEN 12 THEN '[Nn-]{12,}' ELSE '[Nn-]{20,}' END),
        lambda x: length(x))) > window_size THEN 'forced' ELSE 'natural' END AS cut FROM g""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = genome_pieces(table(spark, d, "genome"), table(spark, d, "run_options")).filter(F.col("n_pieces") > 1)
    return pieces.groupBy(F.col("record.chrom_id").alias("chrom_id"), F.col("record.profile_id")).agg(F.when(F.max((F.col("cut") == "forced").cast("int")) > 0, "forced").otherwise("natural").alias("cut")).select("chrom_id", "cut")


@query()
def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = genome_pieces(table(spark, d, "genome"), table(spark, d, "run_options"))
    return pieces.select("record.chrom_id", "piece_no", "piece_start", "piece", "cut")


def _span_length(spark: SparkSession, d: str) -> int:
    return 4 * table(spark, d, "run_options").filter("profile_id = 1").agg(F.max("kmerlength")).first()[0]


_P3 = """WITH g AS (SELECT DISTINCT chrom_id, upper(seq) AS s FROM genome WHERE length(seq) >= 64),
    w AS (SELECT chrom_id, i, substr(s, i + 1, 64) AS t FROM (SELECT *, unnest(range(length(s) - 63)) AS i FROM g)),
    c AS (SELECT * FROM w WHERE regexp_full_match(t, '[ACGT]{64}')),
    k AS (SELECT t FROM c GROUP BY t HAVING min(chrom_id) <> max(chrom_id)),
    x AS (SELECT chrom_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY chrom_id ORDER BY i) <= 64 THEN 0 ELSE 1 END AS n FROM c SEMI JOIN k USING (t)),
    y AS (SELECT chrom_id, i, sum(n) OVER (PARTITION BY chrom_id ORDER BY i) AS z FROM x),
    spans AS (SELECT chrom_id, CAST(min(i) AS INT) AS span_start, CAST(max(i) + 64 AS INT) AS span_end FROM y GROUP BY chrom_id, z)"""


@query(f"{_P3} SELECT * FROM spans")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    spans = shared_spans(table(spark, d, "genome"), "chrom_id", "seq", _span_length(spark, d))
    return spans.select(F.col("id").cast("int").alias("chrom_id"), "span_start", "span_end")


@query(f"{_P3} SELECT chrom_id, length(s) AS n_letters, coalesce(n, 0) AS n_shared, CASE WHEN length(s) > 0 THEN round(coalesce(n, 0) / length(s), 6) END AS share FROM (SELECT DISTINCT chrom_id, seq AS s FROM genome) LEFT JOIN (SELECT chrom_id, CAST(sum(span_end - span_start) AS BIGINT) AS n FROM spans GROUP BY chrom_id) USING (chrom_id)")
def p3_share(spark: SparkSession, d: str) -> DataFrame:
    genome = table(spark, d, "genome")
    spans = shared_spans(genome, "chrom_id", "seq", _span_length(spark, d)).groupBy("id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n"))
    whole = genome.select("chrom_id", F.length("seq").cast("long").alias("n_letters")).distinct().join(spans, F.col("chrom_id") == F.col("id"), "left")
    return whole.select("chrom_id", "n_letters", F.coalesce("n", F.lit(0)).alias("n_shared"), F.when(F.col("n_letters") > 0, F.round(F.coalesce("n", F.lit(0)) / F.col("n_letters"), 6)).alias("share"))


def _likeness(spark: SparkSession, d: str) -> float:
    return (100 - 10 * table(spark, d, "run_options").filter("profile_id = 1").agg(F.max("max_hamming_percent")).first()[0]) / 100


_P5 = """WITH r AS (SELECT DISTINCT read_id, upper(seq) AS s FROM read_records WHERE length(seq) >= 8),
    t AS (SELECT DISTINCT read_id, substr(s, i, 8) AS k FROM (SELECT *, unnest(range(1, length(s) - 6)) AS i FROM r)),
    c AS (SELECT * FROM t WHERE regexp_full_match(k, '[ACGT]{8}')),
    n AS (SELECT read_id, count(*) AS n FROM c GROUP BY read_id HAVING count(*) >= 20),
    o AS (SELECT a.read_id AS x, b.read_id AS y, count(*) AS o FROM c a JOIN c b ON a.k = b.k AND a.read_id < b.read_id GROUP BY ALL),
    pairs AS (SELECT x AS read_id_a, y AS read_id_b, o, nx.n + ny.n - o AS u FROM o JOIN n nx ON nx.read_id = x JOIN n ny ON ny.read_id = y
        WHERE o * 100 >= (SELECT 100 - 10 * max_hamming_percent FROM run_options WHERE profile_id = 1) * (nx.n + ny.n - o))"""


@query(f"{_P5} SELECT read_id_a, read_id_b FROM pairs")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return alike_pairs(table(spark, d, "read_records"), "read_id", "seq", _likeness(spark, d)).select(F.col("a").alias("read_id_a"), F.col("b").alias("read_id_b"))



@query(f"""{_P5}, l AS (SELECT x, y FROM (SELECT read_id_a AS x, read_id_b AS y FROM pairs UNION ALL SELECT read_id_b, read_id_a FROM pairs)), links AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
    SELECT n.read_id, coalesce(links.n, 0) AS n_links FROM n LEFT JOIN links ON links.x = n.read_id""")
def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return alike_groups(table(spark, d, "read_records"), "read_id", "seq", _likeness(spark, d)).select(F.col("id").alias("read_id"), "n_links")


@query()
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of each read and the least distance of its hits in mapped_reads."""
    groups = alike_groups(table(spark, d, "read_records"), "read_id", "seq", _likeness(spark, d))
    hamming = table(spark, d, "mapped_reads").filter("hamming >= 0").groupBy("read_id").agg(F.min("hamming").alias("hamming"))
    return groups.join(hamming, F.col("id") == F.col("read_id"), "left").select(F.col("id").alias("read_id"), F.col("group").alias("group_id"), "n_links", "hamming")


_P6 = r"""WITH d AS (SELECT doc_id AS id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents),
    e AS (SELECT DISTINCT item_id AS id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items),
    dw AS (SELECT DISTINCT id, array_to_string(w[i:i+12], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)),
    ew AS (SELECT DISTINCT id, array_to_string(w[i:i+12], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM e)),
    leaks AS (SELECT dw.id AS doc_id, ew.id AS item_id, count(*) AS n_windows FROM dw JOIN ew ON dw.t = ew.t GROUP BY ALL)"""


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_windows(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "item_id")


@query(f"{_P6} SELECT doc_id, item_id FROM leaks")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # equal windows have equal fingerprints: all of these come from the blocks
    return _leaks(spark, d).filter(F.col("same") & (F.col("apart") <= RADIUS)).select("doc_id", "item_id").distinct()


@query()
def p6_windows(spark: SparkSession, d: str) -> DataFrame:
    """For each document and item, how many of the item's windows stand there, equal or nearly so, and how many of those the blocks alone give."""
    return _leaks(spark, d).groupBy("doc_id", "item_id").agg(F.countDistinct("item_at").alias("n_item_windows"), F.countDistinct(F.when(F.col("apart") <= RADIUS, F.col("item_at"))).alias("n_within_radius"), F.max("similarity").alias("similarity"), F.max(F.col("same").cast("int")).alias("same"))


_P8 = r"""WITH c AS (SELECT list(DISTINCT lower(word)) AS cw FROM common_words),
    a AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w, len(regexp_replace(text, '[\p{L}\p{N} \t\r\n]', '', 'g')) AS n_marks,
        list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS l FROM documents),
    s AS (SELECT doc_id, n_marks, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS n_letters, len(l) AS n_lines,
        len(list_filter(w, lambda x: list_contains(cw, lower(x)))) AS n_common,
        len(list_filter(l, lambda x: x[-1] IN ('.', '!', '?', ':', ';', '…', '"', '''', ')'))) AS n_ended_lines FROM a, c)"""
_P8_FOUND = "n_words = 0 OR (n_letters + n_marks >= 20 AND n_marks * 5 > n_letters + n_marks) OR n_letters > 9 * n_words OR (n_words >= 8 AND n_common * 5 < n_words) OR (n_lines >= 5 AND n_ended_lines * 4 < n_lines)"


def _types(spark: SparkSession, d: str) -> DataFrame:
    return text_types(table(spark, d, "documents"), "text", table(spark, d, "common_words"))


@query(f"{_P8} SELECT doc_id FROM s WHERE {_P8_FOUND}")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    # the model holds prose impossible exactly where a stated threshold votes
    return _types(spark, d).filter(F.col("p_prose") == 0).select("document.doc_id")


@query(f"""{_P8} SELECT doc_id, n_words, CASE WHEN n_words > 0 THEN n_letters / n_words END AS mean_word_length, CASE WHEN n_letters + n_marks > 0 THEN n_marks / (n_letters + n_marks) END AS mark_share,
    CASE WHEN n_lines > 0 THEN n_ended_lines / n_lines END AS ended_share, CASE WHEN n_words > 0 THEN n_common / n_words END AS common_share FROM s""")
def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    statistics = text_statistics(table(spark, d, "documents"), "text", table(spark, d, "common_words"))
    return statistics.select("document.doc_id", "n_words", "mean_word_length", "mark_share", "ended_share", "common_share")


@query()
def p8_types(spark: SparkSession, d: str) -> DataFrame:
    """Posterior text types; learned, so SQL has no equal."""
    return _types(spark, d).select("document.doc_id", "text_type", *(F.round(f"p_{t}", 6).alias(f"p_{t}") for t in TYPES))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@query()
def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0].select("document.doc_id", "source", "copy", "n_tokens", "shard", "place")


@query()
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, counted from the mixture itself."""
    mixture, report = _mixture(spark, d)
    counted = mixture.groupBy("source").agg(F.sum("n_tokens").alias("counted_tokens"), F.max(F.col("copy") + 1).alias("most_uses"))
    return report.drop("most_uses").join(counted, "source", "left").withColumn("counted_tokens", F.coalesce("counted_tokens", F.lit(0)))


@query("""WITH n AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents WHERE length(text) > 0 GROUP BY 1), t AS (SELECT source, target_share, max_repeats, coalesce(n, 0) AS n FROM mix_targets LEFT JOIN n USING (source))
    SELECT source, CAST(n AS BIGINT) AS n_documents, round(CASE WHEN n > 0 THEN target_share / (SELECT sum(target_share) FROM t WHERE n > 0) ELSE 0 END, 9) AS share_due, true AS share_met, true AS counts_agree, CAST(0 AS BIGINT) AS over_cap FROM t""")
def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mixture, counted document by document, keeps what is asked: shares up to a block, caps, and the report's own numbers."""
    mixture, report = _mixture(spark, d)
    uses = mixture.groupBy("source", "document.doc_id").agg(F.count("*").alias("uses"), F.countDistinct("copy").alias("copies"), F.sum("n_tokens").alias("tokens"))
    counted = uses.join(table(spark, d, "mix_targets").select("source", F.col("max_repeats").alias("cap")), "source").groupBy("source").agg(
        F.sum("tokens").alias("counted"), F.count_if((F.col("uses") > F.col("cap")) | (F.col("uses") > F.col("copies"))).alias("over_cap")
    )
    n = table(spark, d, "documents").filter(F.length("text") > 0).groupBy("source").agg(F.countDistinct("doc_id").alias("n_documents"))
    quotas = report.agg(F.sum("quota_tokens")).first()[0] or 1.0  # of a table the driver made
    whole = report.join(counted, "source", "left").join(n, "source", "left")
    return whole.select(
        "source", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.round(F.col("quota_tokens") / F.lit(quotas), 9).alias("share_due"),
        (F.abs(F.coalesce("counted", F.lit(0)) - F.col("quota_tokens")) <= F.col("largest_block")).alias("share_met"),
        (F.coalesce("counted", F.lit(0)) == F.col("n_tokens")).alias("counts_agree"), F.coalesce("over_cap", F.lit(0)).alias("over_cap"),
    )
