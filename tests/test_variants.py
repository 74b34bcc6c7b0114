import pytest

from strandline.operators.variants import cigar_variants, concordance, variant_counts

CASES = [
    ("T" * 82, "T" * 82, "82M", []),
    ("T" * 82, "T" * 20 + "AA" + "T" * 60, "82M", [(143, "T", "A"), (144, "T", "A")]),
    ("T" * 82, "T" * 20 + "GT" + "T" * 60, "20M2I60M", [(143, "T", "TGT")]),
    ("T" * 82, "T" * 82, "20M3D62M", [(143, "TTTT", "T")]),
    ("T" * 82, "TCG" + "T" * 79, "3I79M", [(123, "A", "ATCG")]),
    ("TCG" + "T" * 82, "T" * 82, "3D79M", [(123, "ATCG", "A")]),
    ("TTTT", "TNGT", "1S3M", [(124, "T", "G")]),
    ("TTTT", "TTTT", "", []),
    ("TTTT", "TTTT", None, []),
    ("ACGT", "AGT", "1=1D2=", [(124, "AC", "A")]),
    ("ACGTA", "TA", "3N2M", []),
]


@pytest.mark.parametrize(("ref", "alt", "cigar", "want"), CASES)
def test_variants_of_a_read(spark, ref, alt, cigar, want):
    df = spark.createDataFrame([(123, "A", ref, alt, cigar)], "pos int, prefix string, ref string, alt string, cigar string")
    got = df.select(cigar_variants("pos", "prefix", "ref", "alt", "cigar", 82).alias("v")).first().v
    assert [tuple(v) for v in got] == want


def test_cohort_counts(spark):
    one = [(280, "G", "T"), (295, "A", "G"), (331, "T", "A"), (345, "C", "A")]
    two = [(280, "C", "TT"), *one[1:]]
    df = lambda *s: spark.createDataFrame([(str(i), *v) for i, x in enumerate(s) for v in x], "sample string, pos int, ref string, alt string")
    assert {r.n for r in variant_counts(df(one, one)).collect()} == {2}
    assert variant_counts(df(one, two)).count() == 5
    assert {(r.pos, r.n) for r in variant_counts(df(one), 331, 354).collect()} == {(331, 1), (345, 1)}


def test_concordance(spark):
    called = spark.createDataFrame([("1", 5, "A", "C"), ("1", 5, "A", "G"), ("1", 9, "T", "C")], "chrom string, pos int, ref string, alt string")
    known = spark.createDataFrame([("1", 5, "A", "G", "x"), ("1", 5, "C", "G", "x"), ("1", 9, "T", "A", "y"), ("2", 5, "A", "G", "z")], "chrom string, pos int, ref string, alt string, gene string")
    assert sorted((r.gene, r.status) for r in concordance(known, called).collect()) == [("x", "matched"), ("x", "ref_mismatch"), ("y", "alt_mismatch"), ("z", "missing")]
