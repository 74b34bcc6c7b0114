import random

from pyspark.sql import types as T

from strandline.plans import relational_queries as Q


def test_variants_of_a_long_read(spark, data, tmp_path):
    rnd = random.Random(1)
    whole = "".join(rnd.choice("ACGT") for _ in range(3000))
    read = list(whole[100:2600])
    for at in (10, 999, 1000, 2400):
        read[at] = "ACGT"["ACGT".index(read[at]) - 1]
    def one(table, row):
        schema = spark.read.parquet(f"{data}/{table}.parquet").schema
        spark.createDataFrame([tuple(row.get(f.name) for f in schema)], T.StructType([T.StructField(f.name, f.dataType) for f in schema])).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))

    for table, row in (
        ("genome", dict(chrom_id=1, name="c1 x", seq=whole, profile_id=1)),
        ("read_records", dict(read_id=7, file_id=1, read_id_in_file=0, header="r", seq="".join(read))),
        ("mapped_reads", dict(read_id=7, orientation=1, hamming=4, chrom="c1", window_pos=90, shift=10, read_len=2500)),
    ):
        one(table, row)
    found = Q.v1_variants(spark, str(tmp_path)).collect()
    assert sorted(r.pos for r in found) == [110, 1099, 1100, 2500]
