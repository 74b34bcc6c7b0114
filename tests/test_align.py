import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.sequence import run_lengths
from strandline.operators.align import _after, _table, aligned_pairs, better_strand, bisulfite_align, conversions, dna_scores, edit_align, local_align, pretty, read_scores, rescored


def plain_edit(q, t, mode):
    d = [0 if mode == "HW" else j for j in range(len(t) + 1)]
    for i, a in enumerate(q, 1):
        row = [i]
        for j, b in enumerate(t, 1):
            row.append(min(d[j - 1] + (a != b), d[j] + 1, row[-1] + 1))
        d = row
    return d[-1] if mode == "NW" else min(d), d


def plain_local(q, r, match=2, mismatch=2, open_=3, extend=1):
    best, ends = 0, []
    h = np.zeros((len(q) + 1, len(r) + 1), int)
    e, f = h - 10**6, h - 10**6
    for i in range(1, len(q) + 1):
        for j in range(1, len(r) + 1):
            s = match if q[i - 1] == r[j - 1] and q[i - 1] in "ACGT" else -mismatch
            e[i, j] = max(h[i, j - 1] - open_, e[i, j - 1] - extend)
            f[i, j] = max(h[i - 1, j] - open_, f[i - 1, j] - extend)
            h[i, j] = max(0, h[i - 1, j - 1] + s, e[i, j], f[i, j])
    return h


def cigar_score(q, r, a, match=2, mismatch=2, open_=3, extend=1):
    import re

    i, j, score = 0, a.ref_begin, 0
    for n, op in re.findall(r"(\d+)([=XIDS])", a.cigar):
        n = int(n)
        if op in "=X":
            for x in range(n):
                same = q[i + x] == r[j + x]
                assert same == (op == "=")
                score += match if same and q[i + x] in "ACGT" else -mismatch
            i, j = i + n, j + n
        elif op == "I":
            score, i = score - open_ - (n - 1) * extend, i + n
        elif op == "D":
            score, j = score - open_ - (n - 1) * extend, j + n
        else:
            i += n
    assert i == len(q) and j == a.ref_end + 1
    return score


def mutated(rnd, t):
    out = []
    for c in t:
        x = rnd.random()
        out.append(rnd.choice("ACGT") if x < 0.1 else "" if x < 0.15 else c + rnd.choice("ACGTN") if x < 0.2 else c)
    return "".join(out)


@pytest.fixture(scope="module")
def pairs():
    rnd = random.Random(42)
    out = [("", ""), ("", "ACGT"), ("ACGT", ""), ("A", "A"), ("N", "N"), ("ACGT", "TTTT")]
    for _ in range(150):
        t = "".join(rnd.choice("ACGTN" if rnd.random() < 0.05 else "ACGT") for _ in range(rnd.randrange(1, 70)))
        a = rnd.randrange(len(t))
        out.append((mutated(rnd, t[a : a + 40]), t))
    return out


def test_local_alignment_is_the_best(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)] + [(-1, None, "A")], "id int, q string, r string")
    got = {r.id: r.a for r in df.select("id", local_align("q", "r").alias("a")).collect()}
    assert got[-1] is None or got[-1].score is None
    for i, (q, r) in enumerate(pairs):
        h, a = plain_local(q, r), got[i]
        assert a.score == h.max(initial=0), (q, r)
        if not a.score:
            assert a.cigar == "" and a.flag == 1
            continue
        end = int(h.max(axis=0).argmax())
        assert a.ref_end == end - 1 and a.query_end == int(h[:, end].argmax()) - 1
        assert cigar_score(q, r, a) == a.score
        far = [h[:, j + 1].max() for j in range(len(r)) if abs(j - a.ref_end) > max(15, len(q) // 2)]
        assert a.score2 == max(far, default=0)


@pytest.mark.parametrize("mode", ["NW", "SHW", "HW"])
def test_edit_distance_is_the_least(spark, pairs, mode):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, q string, t string")
    got = {r.id: r.e for r in df.select("id", edit_align("q", "t", mode, True).alias("e")).collect()}
    for i, (q, t) in enumerate(pairs):
        want, last = plain_edit(q, t, mode)
        e = got[i]
        if mode == "NW":
            assert e.edit_distance == want
        else:
            assert e.edit_distance == min(last)
        if q:
            ends = [j - 1 for j, d in enumerate(last) if d == e.edit_distance] if mode != "NW" else [len(t) - 1]
            assert [x.end for x in e.locations] == ends
            for x in e.locations:
                assert plain_edit(q, t[x.start : x.end + 1], "NW")[0] == e.edit_distance
        if e.path:
            assert sum(x != "=" for x in e.path) == e.edit_distance


def one(spark, q, t, *args, **more):
    return spark.createDataFrame([(q, t)], "q string, t string").select(edit_align("q", "t", *args, **more).alias("e")).first().e


def test_known_distances(spark):
    assert one(spark, "telephone", "elephant").edit_distance == 3
    assert one(spark, "ACTG", "CACTRT", "HW", equal=[("R", "A"), ("R", "G")]).edit_distance == 0
    assert one(spark, "", "elephant").edit_distance == 8 and one(spark, "telephone", "").edit_distance == 9
    assert one(spark, "", "elephant", "HW").edit_distance == 0 and one(spark, "telephone", "", "SHW").edit_distance == 9
    assert one(spark, "AA", "B", "HW").edit_distance == 2 and one(spark, "AAABBB", "BBBC", "HW").edit_distance == 3 and one(spark, "BBBAAA", "CBBB", "HW").edit_distance == 3
    wild = [("R", "A"), ("R", "G"), *(("N", x) for x in "ACGT")]
    assert one(spark, "GTGNRTCARCGAANCTTTN", "GTGAGTCATCGAATCTTTGAACGCACCTTGCGCTCCTTGGT", "HW", equal=wild).edit_distance == 1
    e = one(spark, "ты милая", "ты гений")
    assert (e.edit_distance, e.alphabet_length) == (5, 12)
    assert one(spark, "telephone", "elephant", "NW", k=2).edit_distance == -1


def test_pretty_lines_and_cigars(spark):
    df = spark.createDataFrame([("TAAGGATGGTCCCATTC", "AAGGGGTCTCATATC")], "q string, t string").withColumn("e", edit_align("q", "t", "NW", True))
    p = df.select(pretty("e.path", "q", "t").alias("p")).first().p
    assert p.query.replace("-", "") == "TAAGGATGGTCCCATTC" and p.target.replace("-", "") == "AAGGGGTCTCATATC"
    assert len(p.query) == len(p.signs) == len(p.target)
    path = spark.createDataFrame([("==IIIDIIX==",)], "p string").select(run_lengths("p"), run_lengths(F.translate("p", "=X", "MM"))).first()
    assert tuple(path) == ("2=3I1D2I1X2=", "2M3I1D2I3M")


def test_other_matrices(spark):
    letters, scores = read_scores("# a comment\n   A  W\nA  4 -3\nW -3 11\n")
    df = spark.createDataFrame([("AWA", "WAWAW")], "q string, r string")
    a = df.select(local_align("q", "r", scores=(letters, scores)).alias("a")).first().a
    assert a.score == 19 and a.cigar == "3="
    assert _table(dna_scores()[1])[4, 4] < 0


def test_reverse_strand_only_if_better(spark):
    df = spark.createDataFrame([(0, "ACGTTGCAAT", "ATTGCAACGT"), (1, "ACGT", "ACGT")], "id int, q string, r string")
    assert [r.strand for r in better_strand(df, "q", "r").orderBy("id").collect()] == ["-", "+"]


def test_bisulfite_rescoring(spark):
    ref = "ACGTTCAGGCATCCATGACG"
    df = spark.createDataFrame([(0, ref.replace("C", "T"), ref), (1, ref, ref), (2, ref.replace("T", "C"), ref)], "id int, q string, r string")
    rows = bisulfite_align(df, "q", "r").orderBy("id").collect()
    n, t = ref.count("C"), ref.count("T")
    assert (rows[0].strand, rows[0].score, rows[0].conversions) == ("+", 2 * len(ref) - 4 * n, n)
    assert (rows[1].score, rows[1].conversions) == (2 * len(ref), 0) and 0 < rows[1].mapq <= 254
    assert rows[2].conversions == 0 and rows[2].score == max(0, 2 * len(ref) - 4 * t)


def test_conversions_are_those_of_the_aligned_pairs(spark):
    rows = [(0, "2S3=1X1I2D4M", "CTTCTCATTCAC", "GGCTCCAATCTCAGG", 1), (1, "", "ACT", "ACT", -1), (2, None, "A", "A", 0), (3, "5M2N3M", "TTTTTCCC", "CCCCC", 0), (4, "4M", "TCTC", "CTCT", 0), (5, "3M", None, "CCC", 0)]
    df = spark.createDataFrame(rows, "id int, cigar string, query string, ref string, b int").withColumn("a", F.struct("cigar", F.col("b").alias("ref_begin"), F.lit(40).alias("score"), F.lit(3).alias("score2")))
    pairs = aligned_pairs(F.col("a"), F.col("query"), F.col("ref"))
    got = df.select("id", rescored(F.col("a"), pairs).alias("x"), _after(F.col("a"), conversions(F.col("a"), F.col("query"), F.col("ref")), 2, 2).alias("y")).collect()
    for r in got:
        assert r.id in (2, 5) and r.y.conversions is None or r.x == r.y, r
    assert {r.id: r.y.conversions for r in got}[4] == 2


def test_bisulfite_is_the_better_of_two_whole_alignments(spark, pairs, monkeypatch):
    """The same as both strands aligned and rescored, though a strand that can't be the better one isn't aligned."""
    from strandline.functions.sequence import reverse_complement, three_letter
    from strandline.operators import align as A

    rnd = random.Random(12)
    long = ["".join(rnd.choice("ACGT") for _ in range(200)) for _ in range(40)]
    rows = [(i, q, r) for i, (q, r) in enumerate([*pairs, *((r[a : a + 90], r) for a, r in enumerate(long)), *((mutated(rnd, r[30:120]), r) for r in long), (None, "ACGT"), ("ACGT", None)])]
    df = spark.createDataFrame(rows, "id int, q string, r string").withColumn("rc", reverse_complement("q"))
    ref = three_letter(F.upper("r"))
    both = df.withColumn("f", local_align(three_letter("q"), ref)).withColumn("b", local_align(three_letter("rc"), ref))
    both = both.withColumn("fs", _after(F.col("f"), conversions(F.col("f"), F.col("q"), F.upper("r")), 2, 2)).withColumn("bs", _after(F.col("b"), conversions(F.col("b"), F.col("rc"), F.upper("r")), 2, 2))
    want = both.select("id", F.when(F.col("fs.score") >= F.col("bs.score"), F.struct(F.lit("+").alias("strand"), F.col("fs").alias("after"), F.col("f").alias("a"))).otherwise(F.struct(F.lit("-").alias("strand"), F.col("bs").alias("after"), F.col("b").alias("a"))).alias("x")).collect()
    got = {r.id: r for r in bisulfite_align(df.drop("rc"), "q", "r").collect()}
    assert {r.x[0] for r in want} == {"+", "-"}
    for r in want:
        strand, after, alignment = r.x
        assert got[r.id].strand == strand and got[r.id].alignment == alignment, r
        assert (got[r.id].score, got[r.id].score2, got[r.id].conversions) == tuple(after), r

    seen, whole = [], A._local_block
    monkeypatch.setattr(A, "_local_block", lambda x, y, *rest: seen.extend(x) or whole(x, y, *rest))
    q, r, turned = ([f(x, i) for i, x in enumerate(long)] for f in (lambda x, i: x[i : i + 90], lambda x, i: x, lambda x, i: x[i : i + 90][::-1].translate(str.maketrans("ACGT", "TGCA"))))
    A._bisulfite_udf().func(*(A.pd.Series(x) for x in ([s.replace("C", "T") for s in q], [s.replace("C", "T") for s in turned], [s.replace("C", "T") for s in r], q, turned, r)))
    assert len(seen) == len(long)


def test_score2_does_not_depend_on_other_pairs_of_the_block():
    """A shorter query's rows beyond its end count for nothing."""
    from strandline.operators.align import _local_block

    q = "ACGGTCATTGCACGT"
    rows = [(q, q + q + "N" * 10), (q * 2, "T" * 40)]  # the second place ends just inside the mask
    block = _local_block([q for q, _ in rows], [r for _, r in rows], "ACGT", _table(dna_scores()[1]), 3, 1, None, 0, 1 << 30)
    for (q, r), a in zip(rows, block):
        h = plain_local(q, r)
        assert a[0] == h.max() and a[1] == max((h[:, j + 1].max() for j in range(len(r)) if abs(j - a[3]) > max(15, len(q) // 2)), default=0), q
