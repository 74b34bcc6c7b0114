import oracle
from pyspark.sql import functions as F

from strandline.plans import relational_queries as Q


def test_reads_with_other_letters_are_mapped(spark, data):
    odd = spark.read.parquet(f"{data}/read_records.parquet").filter(F.col("seq").rlike("[^ACGTacgt]")).select("read_id").distinct()
    # the old query maps none of them; the SQL of the new one decides which are hit
    hit = {r[0] for r in oracle.tables(data).execute(f"SELECT read_id FROM ({Q.SQL['a8_all_best_hits']})").fetchall()}
    odd_ids = {r.read_id for r in odd.collect()}
    assert odd_ids & hit
    assert {r.read_id for r in Q.a8_all_best_hits(spark, data).join(odd, "read_id").collect()} == odd_ids & hit
