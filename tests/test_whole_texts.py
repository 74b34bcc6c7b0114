from pyspark.sql import functions as F

from strandline.plans import scalar_queries as Q


def test_whole_reads_are_encoded(spark, data):
    longest = Q.reads(spark, data).filter(F.length("seq") > 31).select("read_id", F.regexp_replace("seq", "[^ACGT]", "A").alias("s"))
    both = Q.f9_encode_words(spark, data).join(longest, "read_id")
    assert both.count() > 0 and both.filter("decoded <> s").count() == 0


def test_sets_take_all_letters(spark, data):
    # the first 800 letters, as before, hold at most 266 of three
    n = Q.genome(spark, data).filter("length(seq) > 1500").select("chrom_id", F.length("seq").alias("n"))
    rows = Q.o1_all_set_operations(spark, data).select("chrom_id", F.size(F.split("merged", ",")).alias("k")).join(n, "chrom_id").collect()
    assert rows and all(r.n // 4 < r.k <= r.n // 3 for r in rows)
