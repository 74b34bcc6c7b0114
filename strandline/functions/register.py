"""The functions under SQL names: ``register_functions(spark)``, then ``SELECT revcomp(seq), sw_align(a, b).cigar FROM ...``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.align import edit_align_udf, local_align_udf
from ..operators.minhash import murmur64_column

#: built-in functions as temporary SQL functions: nothing leaves the JVM
_SQL = {
    "revcomp(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGT', 'TGCA'))",
    "three_letter(s STRING) RETURNS STRING": "translate(s, 'C', 'T')",
    "is_ambiguous(s STRING) RETURNS BOOLEAN": "s RLIKE '[^ACGTacgt]'",
    "kmers(s STRING, k INT) RETURNS ARRAY<STRING>": "CASE WHEN length(s) >= k THEN transform(sequence(1, length(s) - k + 1), i -> substring(s, i, k)) ELSE cast(array() AS array<string>) END",
    "cigar_parse(c STRING) RETURNS ARRAY<STRUCT<op: STRING, len: INT>>": "transform(regexp_extract_all(coalesce(c, ''), '([0-9]+[MIDSHNPX=])', 1), p -> named_struct('op', right(p, 1), 'len', cast(left(p, length(p) - 1) AS INT)))",
    "mapq(s1 DOUBLE, s2 DOUBLE) RETURNS INT": "cast(CASE WHEN s1 = 0 THEN 0 WHEN 1 - abs(s1 - s2) / s1 <= 0 THEN 254 ELSE least(254, greatest(0, floor(floor(-4.343 * ln(1 - abs(s1 - s2) / s1)) + 4.99))) END AS INT)",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Registers revcomp, three_letter, is_ambiguous, kmers, cigar_parse, mapq, murmur64, sw_align and edit_align; returns their names."""
    for head, body in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("murmur64", murmur64_column)
    spark.udf.register("sw_align", local_align_udf())
    spark.udf.register("edit_align", edit_align_udf())
    return [*(h.split("(")[0] for h in _SQL), "murmur64", "sw_align", "edit_align"]

