"""Queries of the numbered problems that belong to the core, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raw_lines import parse_read_lines
from ..operators.tree_buckets import bucket_reads
from ..shared import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_P2_PARSED = f"""
    f AS (SELECT raw_id, line, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*', 's') AS ok,
        len(regexp_extract_all(regexp_replace(line, '"(?:[^"]|"")*"', 'q', 'gs'), ',')) + 1 AS n,
        regexp_extract(line, '^({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD})$', ['a', 'b', 'c', 'd', 'e'], 's') AS p FROM raw_reads),
    u AS (SELECT raw_id, line, ok, n, list_transform([p.a, p.b, p.c, p.d, p.e], lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM f),
    r AS (SELECT raw_id, v, CASE WHEN line IS NOT NULL AND NOT ok THEN 'quoting' WHEN line IS NULL OR n <> 5 THEN 'columns'
        WHEN NOT regexp_full_match(v[1], '[0-9]+') THEN 'record_no' WHEN NOT regexp_full_match(v[2], '[@>][^ ].*', 's') THEN 'header'
        WHEN NOT regexp_full_match(v[3], '[ACGTNacgtn]+') THEN 'seq'
        WHEN CASE WHEN v[2] LIKE '>%' THEN v[4] <> '' ELSE length(v[4]) <> length(v[3]) OR NOT regexp_full_match(v[4], '[!-~]*') END THEN 'qual'
        WHEN NOT regexp_full_match(v[5], '[0-9]{{1,9}}') OR try_cast(v[5] AS INT) <> length(v[3]) THEN 'seq_len' END AS reason FROM u)"""


@query(f"WITH {_P2_PARSED} SELECT raw_id, reason FROM r WHERE reason IS NOT NULL")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_read_lines(table(spark, d, "raw_reads")).filter(F.col("reason").isNotNull()).select("raw_id", "reason")


@query(f"WITH {_P2_PARSED} SELECT raw_id, CAST(v[1] AS DECIMAL(38,0))::VARCHAR AS record_no, v[2] AS header, v[3] AS seq, v[4] AS qual, CAST(v[5] AS INT) AS seq_len FROM r WHERE reason IS NULL")
def p2_records(spark: SparkSession, d: str) -> DataFrame:
    good = parse_read_lines(table(spark, d, "raw_reads")).filter(F.col("reason").isNull())
    return good.select("raw_id", F.col("record_no").cast("string").alias("record_no"), "header", "seq", "qual", "seq_len")


_P4 = """WITH b AS (SELECT s.profile_id, h, bucket_key, count(DISTINCT read_id) AS n, list_sort(list(DISTINCT read_id) FILTER (read_id IS NOT NULL)) AS ids
    FROM read_signatures s WHERE bucket_key IS NOT NULL GROUP BY ALL)"""


@query(f"{_P4} SELECT b.profile_id, h, bucket_key FROM b JOIN run_options o ON b.profile_id = o.profile_id WHERE n > max_results_per_map")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = bucket_reads(table(spark, d, "read_signatures"), table(spark, d, "run_options"))
    return found.filter(F.col("n_reads") > F.col("max_results")).select("profile_id", "h", "bucket_key")


@query(f"""{_P4} SELECT b.profile_id, h, bucket_key, n AS n_reads, least(n, max_results_per_map) AS n_kept,
    array_to_string(ids[1:max_results_per_map], ',') AS kept FROM b JOIN run_options o ON b.profile_id = o.profile_id""")
def p4_buckets(spark: SparkSession, d: str) -> DataFrame:
    found = bucket_reads(table(spark, d, "read_signatures"), table(spark, d, "run_options"))
    return found.select("profile_id", "h", "bucket_key", "n_reads", F.size("first_reads").cast("long").alias("n_kept"), F.array_join(F.col("first_reads").cast("array<string>"), ",").alias("kept"))
