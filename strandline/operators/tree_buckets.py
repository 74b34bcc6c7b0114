"""Per-key results when a few keys hold most rows (problem 4): a multi-level tree of partial states.

A key's state is (number of different values, its first values). Rows are first made distinct over key and value
together, which spreads any key evenly, and kept; all else reads these. A key of at most ``chunk_rows`` values is one chunk; a larger one is divided by a
hash of the value into chunks of about that size. Every chunk is combined on its own, then up to ``fan_in`` states
of neighbouring chunks are merged a round, until one is left: no task receives all rows, nor all partial states, of a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut

CHUNK_ROWS = 4_096
FAN_IN = 8


def tree_buckets(rows: DataFrame, keys: list[str], value: str, limit: str, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``keys, n_values BIGINT, first_values ARRAY`` of each key: its number of different values and the smallest
    ``limit`` (a column of ``rows`` that depends on the keys alone) of them.

    Null values don't count; a key with none but null values has 0 and an empty array. Nulls in the keys are
    values like any other. A null or negative limit counts as 0. An empty table gives no rows. Other columns are ignored.
    """
    by = [f"_k{i}" for i in range(len(keys))]
    named = rows.select(*(F.col(f"`{k}`").alias(b) for k, b in zip(keys, by)), F.col(f"`{value}`").alias("val"), F.greatest(F.coalesce(F.col(f"`{limit}`"), F.lit(0)), F.lit(0)).cast("int").alias("keep"))
    different = cut(named.groupBy(*by, "val").agg(F.max("keep").alias("keep")), "different")
    sizes = different.groupBy(*by).agg(F.count("val").alias("n"))  # combined before the shuffle: a row a key and task
    # only keys of more than one chunk; at most rows / chunk_rows of them
    large = cut(sizes.filter(F.col("n") > chunk_rows).select(*(F.col(b).alias(f"{b}_r") for b in by), F.ceil(F.col("n") / chunk_rows).cast("int").alias("chunks")), "large-keys")
    same = None
    for b in by:
        same = F.col(b).eqNullSafe(F.col(f"{b}_r")) if same is None else same & F.col(b).eqNullSafe(F.col(f"{b}_r"))
    placed = different.join(large, same, "left").select(*by, "val", "keep", F.coalesce("chunks", F.lit(1)).alias("chunks"))
    most = large.agg(F.max("chunks")).first()[0] or 1

    def combined(df: DataFrame, node: list[Column]) -> DataFrame:
        kept = F.slice(F.sort_array(F.collect_list("val")), F.lit(1), F.max("keep"))
        return df.groupBy(*by, *node).agg(F.count("val").alias("n"), kept.alias("vals"), F.max("keep").alias("keep"))

    out = combined(placed.filter(F.col("chunks") == 1), []).select(*by, "n", "vals")
    if most > 1:
        states = combined(placed.filter(F.col("chunks") > 1), [F.pmod(F.xxhash64("val"), F.col("chunks")).cast("int").alias("node")])
        for _ in range(math.ceil(math.log(most, fan_in) - 1e-9)):
            merged = F.slice(F.sort_array(F.flatten(F.collect_list("vals"))), F.lit(1), F.max("keep"))
            states = states.groupBy(*by, F.expr(f"node div {fan_in}").alias("node")).agg(F.sum("n").alias("n"), merged.alias("vals"), F.max("keep").alias("keep"))
        out = out.unionByName(states.select(*by, "n", "vals"))
    return out.select(*(F.col(b).alias(k) for k, b in zip(keys, by)), F.col("n").alias("n_values"), F.col("vals").alias("first_values"))


def bucket_reads(signatures: DataFrame, options: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``profile_id, h, bucket_key, n_reads, max_results, first_reads`` of each bucket with a key.

    A bucket whose profile has no options keeps no reads and has a null max_results.
    """
    of = options.groupBy(F.col("profile_id").alias("_p")).agg(F.max("max_results_per_map").alias("max_results"))
    s = signatures.filter(F.col("bucket_key").isNotNull()).select("profile_id", "h", "bucket_key", "read_id")
    keyed = s.join(of, F.col("profile_id") == F.col("_p"), "left").drop("_p")
    out = tree_buckets(keyed, ["profile_id", "h", "bucket_key", "max_results"], "read_id", "max_results", chunk_rows, fan_in)
    return out.select("profile_id", "h", "bucket_key", F.col("n_values").alias("n_reads"), "max_results", F.col("first_values").alias("first_reads"))
