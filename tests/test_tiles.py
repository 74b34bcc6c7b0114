import pytest
from pyspark.sql import functions as F

from strandline.operators.minhash import candidates
from strandline.operators.windows import load_genome, tiles, windows, with_stretch

TEXTS = {1: "ACGTTGCAAC" * 1234 + "AC", 2: "", 3: "ACG", 4: "AÉ東G" * 700, 5: None}


def genome(spark):
    return load_genome(spark.createDataFrame([(i, f"c{i}", t, 1) for i, t in TEXTS.items()], "chrom_id int, name string, seq string, profile_id int"))


@pytest.mark.parametrize("size, overlap", [(7, 3), (1000, 1000), (1 << 20, 0)])
def test_tiles(spark, size, overlap):
    got = {(r.chrom_id, r.tile): (r.len, r.text) for r in tiles(genome(spark), size, overlap).collect()}
    assert got == {(i, n): (len(t), t[n * size : n * size + size + overlap]) for i, t in TEXTS.items() if t for n in range(-(-len(t) // size))}


def test_windows_of_long_texts(spark):
    got = {(r.chrom_id, r.pos): r.seq for r in windows(genome(spark), 16, 128).collect()}
    assert got == {(i, p): t[p : p + 128] for i, t in TEXTS.items() if t for p in range(0, len(t), 113)}


def test_stretches(spark):
    asked = [(n, i, s, k) for n, (i, s, k) in enumerate([(1, 0, 10), (1, 4090, 20), (1, 12340, 9), (1, 99999, 5), (2, 0, 4), (3, 1, 0), (4, 1300, 5000), (9, 0, 3), (1, 0, 5000)])]
    df = spark.createDataFrame(asked, "n int, chrom_id int, s int, k int")
    got = {r.n: r.t for r in with_stretch(df, genome(spark), "s", F.col("k"), "t", 5000).collect()}
    assert got == {n: (TEXTS.get(i) or "")[s : s + k] for n, i, s, k in asked}


@pytest.mark.parametrize("block", [3, 1000])
def test_hot_buckets_on_both_sides(spark, block):
    w = spark.range(50).selectExpr("cast(id as int) AS chrom_id", "cast(0 as int) AS pos", "explode(array(0, 1)) AS h", "cast(id % 3 as bigint) * h AS key")
    r = spark.range(40).selectExpr("id AS read_id", "explode(array(0, 1)) AS h", "id % 3 * h AS key")
    got = {(x.chrom_id, x.read_id): x.hits for x in candidates(w, r, min_hits=1, block=block).collect()}
    assert got == {(c, i): 1 + (c % 3 == i % 3) for c in range(50) for i in range(40)}
