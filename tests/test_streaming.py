from pyspark.sql import functions as F

from strandline.functions.register import register_functions
from strandline.operators.prefix import prefix_sums
from strandline.options import Options
from strandline.plans import mapper
from strandline.shared import clear, cut, scratch, shared_folder, small_rows
from strandline.streaming.ingest import distinct_hits, hits_per_window, map_stream, merged_hits, run_to_files, run_to_table, stream_table


def test_reads_in_batches_map_like_a_table(spark, data, tmp_path):
    reads = spark.read.parquet(f"{data}/read_records.parquet").select("read_id", "file_id", "read_id_in_file", F.upper("seq").alias("seq")).filter("seq RLIKE '^[ACGT]+$'").distinct()
    genome = spark.read.parquet(f"{data}/genome.parquet")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    options = Options(min_table_hits=2)
    stream = stream_table(spark, str(tmp_path / "in"), files_per_trigger=1)
    map_stream(stream, genome, str(tmp_path / "out"), str(tmp_path / "log"), options).awaitTermination()
    columns = ["read_id", "hamming", "chrom_id", "pos", "orientation", "shift"]
    got = merged_hits(spark, str(tmp_path / "out")).select(columns).collect()
    assert sorted(got) == sorted(mapper.mapped(reads, genome, options).select(columns).collect()) and got


def test_repeated_and_late_hits(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", 1), (1, "2024-01-01 10:00:00", 1), (2, "2024-01-01 10:30:00", 3), (3, "2024-01-01 12:00:00", None)]
    df = spark.createDataFrame(rows, "read_id long, t string, orientation int").select("read_id", F.to_timestamp("t").alias("mapped_at"), "orientation")
    df.write.parquet(str(tmp_path / "in"))
    kept = run_to_files(distinct_hits(stream_table(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "a"))
    assert kept.count() == 3
    counts = run_to_table(hits_per_window(stream_table(spark, str(tmp_path / "out"))), "hits_by_hour", str(tmp_path / "b"))
    assert sorted((r.start.hour, r.mapped, r.unmapped) for r in counts.collect()) == [(10, 1, 1), (12, 0, 1)]


def test_sql_names(spark):
    names = register_functions(spark)
    assert {"revcomp", "sw_align", "edit_align", "murmur64"} <= set(names)
    r = spark.sql("SELECT revcomp('ACGN') AS a, sw_align('ACGT', 'TTACGTTT').cigar AS b, edit_align('ACT', 'ACGT').edit_distance AS c, murmur64(CAST(0 AS BIGINT)) AS d, mapq(100D, 0D) AS e, cigar_parse('3M1I')[1].op AS f, size(kmers('ACGT', 5)) AS g").first()
    assert tuple(r) == ("NCGT", "4=", 1, 0, 254, "I", 0)


def test_prefix_sums_over_blocks(spark):
    df = spark.createDataFrame([(i, i % 7 if i % 11 else None) for i in range(0, 300, 3)], "id int, v int")
    want, total = {}, 0
    for r in sorted(df.collect()):
        before, total = total, total + (r.v or 0)
        want[r.id] = (before, total)
    got = {r.id: (r.x, r.y) for r in prefix_sums(df, "id", "v", inclusive="y", exclusive="x", block=10).collect()}
    assert got == want


def test_shared_helpers(spark):
    df = spark.range(5)
    assert small_rows(df, 4) is None and len(small_rows(df, 5)) == 5
    assert sorted(r.id for r in cut(df, "test").collect()) == list(range(5))


def test_scratch_is_cleared(spark):
    rows, other = cut(spark.range(7), "cleared"), scratch(spark, "never-written")
    assert rows.count() == 7 and other.startswith(shared_folder(spark))
    folder = rows.inputFiles()[0].rsplit("/", 1)[0]
    assert clear(spark) >= 2 and clear(spark) == 0
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
