import gzip

import pytest
from pyspark.sql import functions as F

from strandline.options import Options
from strandline.sources import tables as X
from strandline.sources.fastx import broken_records, global_ids, interleave, paired, read_fastx, records, sniff, write_fastx

MIXED = ">one  x\nacgt\nAC\n\n@two\nACGT\nAC\n+\nII\nIIII\n\n>three\n"


def test_records_on_several_lines(tmp_path):
    p = tmp_path / "a.fq"
    p.write_text(MIXED)
    assert list(records(str(p))) == [("one  x", "acgtAC", None), ("two", "ACGTAC", "IIIIII"), ("three", "", None)]
    with pytest.raises(ValueError):
        sniff(str(p))
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(b">x\nAC\n"))
    assert sniff(str(tmp_path / "b.fa.gz")) == "FASTAGZ"


def test_reading_files_and_ids(spark, tmp_path):
    (tmp_path / "1.fq").write_text("@a\nAC\n+\nII\n@b\nA\n+\nI\n")
    (tmp_path / "2.fq.gz").write_bytes(gzip.compress(b"@c\nACG\n+\n@@@\n@d\nA\n+\n"))
    rows = global_ids(read_fastx(spark, str(tmp_path), "STOP")).orderBy("global_read_id").collect()
    assert [(r.global_read_id, r.header, r.seq, r.qual) for r in rows] == [(0, "a", "AC", "II"), (1, "b", "A", "I"), (2, "c", "ACG", "@@@")]
    with pytest.raises(Exception, match="0 qualities"):
        read_fastx(spark, str(tmp_path)).collect()
    assert read_fastx(spark, f"file://{tmp_path}/*.fq").count() == 2 and read_fastx(spark, f"file:{tmp_path}/1.fq,{tmp_path}/1.fq").count() == 4
    both = interleave(*(read_fastx(spark, str(tmp_path / "1.fq")) for _ in range(2))).orderBy("read_id").collect()
    assert [(r.read_id, r.header) for r in both] == [(0, "a"), (1, "a"), (2, "b"), (3, "b")]


@pytest.mark.parametrize("compressed", [False, True])
def test_round_trip(spark, tmp_path, compressed):
    rows = [(None, "AC", None), ("h x", "ACGT", "IIII"), ("e", "A", "@")]
    df = spark.createDataFrame(rows, "header string, seq string, qual string")
    write_fastx(df, str(tmp_path / "out"), compressed)
    got = {(r.header, r.seq, r.qual) for r in read_fastx(spark, str(tmp_path / "out")).collect()}
    assert got == {("", "AC", None), *rows[1:]}


def test_sam_and_vcf(spark, tmp_path):
    rows = [(1, False, "c", 9, 30, "4M", "ACGT", None, 2, "+"), (2, False, None, None, None, None, "AC", "II", None, None), (3, True, "c", 0, None, "", "AC", "", 0, "-")]
    a = spark.createDataFrame(rows, "read_id long, reverse boolean, chrom string, pos int, mapq int, cigar string, seq string, qual string, conversions int, strand string")
    g = spark.createDataFrame([(0, "c", 100)], "chrom_id int, name string, len int")
    X.write_sam(a, g, str(tmp_path / "sam"))
    got = {r.qname: r for r in X.read_sam(spark, str(tmp_path / "sam/*/*.txt")).collect()}
    assert (got["1"].pos, got["1"].flag, got["1"].cigar, got["1"].tags) == (10, 0, "4M", ["Yf:i:2", "YZ:A:+"])
    assert (got["2"].flag, got["2"].rname, got["2"].qual) == (4, "*", "II") and (got["3"].flag, got["3"].cigar) == (16, "*")
    v = spark.createDataFrame([("c", 7, None, "A", "T", None), ("c", 2, "x", "A", "AT", 5)], "chrom string, pos int, id string, ref string, alt string, qual int")
    X.write_vcf(v, str(tmp_path / "vcf"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "vcf/part=1")).collect()]
    assert sorted(lines) == ["c\t2\tx\tA\tAT\t5\tPASS\t.", "c\t7\t.\tA\tT\t.\tPASS\t."]


def test_small_formats(spark, tmp_path):
    (tmp_path / "s1.csv").write_text("pos,ref,alt\n280,G,T\n")
    (tmp_path / "s2.csv").write_text("280\tC\tTT\n")
    assert {(r.sample, r.pos, r.ref, r.alt) for r in X.read_variants(spark, str(tmp_path / "s*.csv")).collect()} == {("s1.csv", 280, "G", "T"), ("s2.csv", 280, "C", "TT")}
    (tmp_path / "w.txt").write_text("chrA 3\nchrB 0\n")
    assert [(r.read_id, r.chrom, r.window_id) for r in X.read_reference_windows(spark, str(tmp_path / "w.txt")).collect()] == [(0, "chrA", 3), (1, "chrB", 0)]
    (tmp_path / "m.tsv").write_text("0\t2\tCHROMOSOME_I\t1376566\t-4\t100\n")
    assert X.read_mapped(spark, str(tmp_path / "m.tsv")).first().shift == -4
    (tmp_path / "k.csv").write_text("20;41711731;CT;C;SETD2")
    assert X.read_known(spark, str(tmp_path / "k.csv")).first().ref == "CT"
    (tmp_path / "meta.tsv").write_text("RUN1\tlane.bam\n")
    assert X.read_metadata(spark, str(tmp_path / "meta.tsv")).first().file == "RUN1_lane"
    (tmp_path / "g.fai").write_text("CHROMOSOME_I\t15072423\t14\t50\t51\n")
    assert X.read_fasta_index(spark, str(tmp_path / "g.fai")).first().offset == 14
    g = spark.createDataFrame([(0, "CHROMOSOME_I", 120), (1, "B", 10)], "chrom_id int, name string, len int")
    assert [(r.offset, r.line_width) for r in X.fasta_index(g, 50).orderBy("chrom_id").collect()] == [(14, 51), (14 + 123 + 3, 51)]
    X.save(spark.range(3).selectExpr("id AS h"), str(tmp_path / "sig"))
    assert X.load_signatures(spark, str(tmp_path / "sig"), 2).count() == 2
    s = "A" * 20 + "T" * 20 + "C" * 20 + "G" * 29 + "X" + "G" * 10 + "C" * 20 + "T" * 20 + "A" * 40
    slices = spark.createDataFrame([(s, p) for p in (0, 20, 2, 90)], "s string, p int").select(X.reference_slice("s", "p").alias("x")).collect()
    assert [r.x.prefix for r in slices] == ["N", "A", "A", "X"] and slices[0].x.ref == s[:82] and slices[3].x.ref.startswith("G" * 10 + "C" * 20)


def test_options():
    o, rest = Options.parse(["--kmerlength", "12", "map"])
    assert o.kmerlength == 12 and rest == ["map"]
    with pytest.raises(ValueError):
        Options(kmerlength=40)


def test_broken_files_are_reported(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@a\nAC\n+\nII\n@b\nAC\n+\nI\n")
    (tmp_path / "b.fa").write_text(">a\nAC\n")
    (tmp_path / "c.fq.gz").write_bytes(gzip.compress(b"@c\nACG\n+\nIII\n" * 500)[:-20])
    got = {r.path.rsplit("/", 1)[1]: (r.read_id_in_file, r.code) for r in broken_records(spark, str(tmp_path)).collect()}
    assert got["a.fq"] == (1, -2) and got["c.fq.gz"][1] == -3 and set(got) == {"a.fq", "c.fq.gz"}
    assert read_fastx(spark, str(tmp_path), "STOP").filter("path LIKE '%a.f%'").count() == 1


def test_pairs_of_one_file(spark):
    df = spark.createDataFrame([(0, i, f"r{i}") for i in range(5)] + [(1, 0, "x"), (1, 1, "y")], "file_id int, read_id_in_file long, header string")
    got = {(r.file_id, r.pair_id, r.mate, r.header) for r in paired(df).collect()}
    assert got == {(0, 0, 1, "r0"), (0, 0, 2, "r1"), (0, 1, 1, "r2"), (0, 1, 2, "r3"), (1, 0, 1, "x"), (1, 0, 2, "y")}


def test_alignments_as_text_and_tagged_lines(spark):
    rows = [(1, False, "c", 12, 5, 2, 9, 1, 9, "1S3=1X2D2I3=", "GACGTTTAAA", "xxACGCGGAAAyy", 9, None, 1), (2, True, "c", 0, 0, -1, -1, -1, -1, "", "ACGT", "AC", 0, "IIII", 0), (3, True, "c", 8, 0, 0, 3, 0, 3, "4=", "AACC", "GGTTT", 0, "ABCD", 0)]
    names = "read_id long, reverse boolean, chrom string, score int, score2 int, ref_begin int, ref_end int, query_begin int, query_end int, cigar string, query string, ref string, mapq int, qual string, mismatches int"
    df = spark.createDataFrame(rows, names)
    text = {r.read_id: r.value for r in X.alignment_text(df).collect()}
    assert text[1].split("\n") == [
        "target_name: c", "query_name: 1", "optimal_alignment_score: 12\tsuboptimal_alignment_score: 5\tstrand: +\ttarget_begin: 3\ttarget_end: 10\tquery_begin: 2\tquery_end: 10", "",
        "Target:        3    ACGCGG--AAA    11", " " * 20 + "|||*    |||", "Query:         2    ACGT--TTAAA    10", "", "",
    ]
    assert "target_begin" not in text[2] and "Target:" not in text[2]
    lines = {r.value.split("\t")[0]: r.value for r in X.aligner_sam_lines(df.withColumn("seq", F.col("query"))).collect()}
    assert lines["1"] == "1\t0\tc\t3\t9\t1S3=1X2D2I3=\t*\t0\t0\tGACGTTTAAA\t*\tAS:i:12\tNM:i:1\tZS:i:5"
    assert lines["2"] == "2\t4\t*\t0\t255\t*\t*\t0\t0\t*\t*" and lines["3"] == "3\t16\tc\t1\t0\t4=\t*\t0\t0\tGGTT\tDCBA\tAS:i:8\tNM:i:0"
