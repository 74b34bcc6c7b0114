import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.operators.tree_buckets import bucket_reads, tree_buckets


@pytest.mark.parametrize(("chunk", "fan"), [(4, 2), (10, 3), (100_000, 8)])
def test_counts_and_first_values(spark, chunk, fan):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 1, 2, None, rnd.randrange(20)]), rnd.choice([None, *range(150)]), 7) for _ in range(2000)]
    rows += [(99, None, 7)] * 3
    want = defaultdict(set)
    for k, v, _ in rows:
        want[k] |= {v} - {None}
    df = spark.createDataFrame(rows, "k int, v int, most int").withColumn("n_values", F.lit(0))
    got = {r.k: (r.n_values, r.first_values) for r in tree_buckets(df, ["k"], "v", "most", chunk, fan).collect()}
    assert got == {k: (len(v), sorted(v)[:7]) for k, v in want.items()}


def test_no_rows_and_odd_limits(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 6, -3)], "k int, v int, most int")
    assert {r.k: (r.n_values, r.first_values) for r in tree_buckets(df, ["k"], "v", "most").collect()} == {1: (1, []), 2: (1, [])}
    assert tree_buckets(df.filter("k > 9"), ["k"], "v", "most").count() == 0


def test_buckets_follow_their_profile(spark):
    s = spark.createDataFrame([(1, 0, 5, r) for r in (3, 1, 2, 2)] + [(1, 0, None, 9), (7, 0, 5, 1)], "profile_id int, h int, bucket_key long, read_id long")
    o = spark.createDataFrame([(1, 2)], "profile_id int, max_results_per_map int")
    got = {(r.profile_id, r.bucket_key): (r.n_reads, r.max_results, r.first_reads) for r in bucket_reads(s, o).collect()}
    assert got == {(1, 5): (3, 2, [1, 2]), (7, 5): (1, None, [])}
