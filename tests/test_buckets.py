from pyspark.sql import functions as F

from strandline.operators.minhash import candidates
from strandline.options import Options


def test_no_read_of_a_hot_bucket_is_lost(spark):
    n = 70_000
    reads = spark.range(n).select(F.col("id").alias("read_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("h"), F.lit(5).cast("long").alias("key"))
    windows = spark.createDataFrame([(c, p, h, 5) for c, p in ((1, 0), (1, 113), (2, 0)) for h in (0, 1)], "chrom_id long, pos int, h int, key long")
    found = candidates(windows, reads, min_hits=2)
    assert found.count() == 3 * n and found.select("chrom_id", "pos", "read_id").distinct().count() == 3 * n
    assert {r.hits for r in found.select("hits").distinct().collect()} == {2}
    # small parts: the same rows
    few = reads.filter("read_id < 50")
    assert sorted(map(tuple, candidates(windows, few, most=7, min_hits=2).collect())) == sorted(map(tuple, candidates(windows, few, min_hits=2).collect()))
    assert candidates(windows, few, most=7, min_hits=2, mode="truncate").count() == 3 * 7
    assert Options().bucket_mode == "all"
