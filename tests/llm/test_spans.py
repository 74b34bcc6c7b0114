import random

import pytest
from pyspark.sql import functions as F

from strandline.llm.spans import SpanIndex, _runs_are_sorted, shared_spans
from strandline.shared import scratch


def plain(rows, length):
    owners = {}
    for i, s in {r for r in rows if None not in r}:
        s = s.upper()
        for a in range(len(s) - length + 1):
            t = s[a : a + length]
            if set(t) <= set("ACGT"):
                owners.setdefault(t, set()).add(i)
    out = set()
    for i, s in {r for r in rows if None not in r}:
        s, covered = s.upper(), set()
        for a in range(len(s) - length + 1):
            if len(owners.get(s[a : a + length], ())) > 1:
                covered |= set(range(a, a + length))
        for p in sorted(covered):
            if p - 1 not in covered:
                e = p
                while e in covered:
                    e += 1
                out.add((i, p, e))
    return out


def made(seed, n, length):
    rnd = random.Random(seed)
    text = lambda m: "".join(rnd.choice("ACGT") for _ in range(m))
    common = [text(rnd.randrange(length - 2, 3 * length)) for _ in range(5)] + ["A" * (2 * length), "AC" * length]
    rows = []
    for i in range(n):
        parts = [rnd.choice([text(rnd.randrange(30)), rnd.choice(common), "N" * rnd.randrange(4), "é", common[0]]) for _ in range(rnd.randrange(1, 7))]
        s = "".join(parts)
        rows.append((i, s.lower() if rnd.random() < 0.2 else s))
    return [*rows, *rows[:3], (n, None), (n + 1, ""), (None, common[0]), (n + 2, common[1][:-1])]


@pytest.mark.parametrize(("length", "batches", "fan"), [(8, 1, 2), (16, 4, 2), (64, 3, 2), (70, 2, 4), (33, 5, 2)])
def test_spans_are_those_of_brute_force(spark, length, batches, fan):
    rows = made(length, 60, length)
    df = spark.createDataFrame([(*r, 1) for r in rows], "chrom int, seq string, id int")
    got = [(r.id, r.span_start, r.span_end) for r in shared_spans(df, "chrom", "seq", length, batches, fan).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, length)


def test_a_batch_finds_what_came_before(spark):
    index = SpanIndex(spark, 16, 2)
    rows = [(i, t) for i, t in enumerate(["ACGTACCATTGACCATGACC" * 2, "TTTGACGGCATCAGGCTAGC", "GGG" + "ACGTACCATTGACCATGACC", "ACGTACCATTGACCATGACC"])]
    found = []
    for r in rows:
        found.append({x.id for x in index.add(spark.createDataFrame([r], "id long, seq string")).collect()})
        index.compact()
    assert found[:3] == [set(), set(), {0, 2}] and 3 in found[3]
    assert max(level for level, _ in index.runs) >= 1
    index.close()


def test_rows_longer_than_a_piece(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice("ACGT") for _ in range(2_200_000))
    rows = [(0, text), (1, text[1_048_500:1_048_700]), (2, text[5:80] + "N" + text[-70:])]
    got = sorted((r.id, r.span_start, r.span_end) for r in shared_spans(spark.createDataFrame(rows, "id int, seq string"), "id", "seq", 64).collect())
    assert got == [(0, 5, 80), (0, 1_048_500, 1_048_700), (0, 2_199_930, 2_200_000), (1, 0, 200), (2, 0, 75), (2, 76, 146)]


def test_no_rows_and_long_runs(spark):
    df = spark.createDataFrame([(0, "ACGT" * 50_000), (1, "CGTA" * 30_000)], "id int, seq string")
    assert shared_spans(df.filter("id > 5"), "id", "seq", 64).count() == 0
    got = {(r.id, r.span_start, r.span_end) for r in shared_spans(df, "id", "seq", 64).collect()}
    assert got == {(0, 0, 200_000), (1, 0, 120_000)}


def test_all_rows_of_an_id_are_verified(spark):
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    rows, want = [], set()
    for i in range(40):
        t = text(100)
        rows += [(2 * i, t), (2 * i + 1, text(7) + t), (2 * i, text(20) + "N" * rnd.randrange(3)), (2 * i + 1, "N" * 90)]
        want |= {(2 * i, 0, 100), (2 * i + 1, 7, 107)}
    got = {(r.id, r.span_start, r.span_end) for r in shared_spans(spark.createDataFrame(rows, "id int, seq string"), "id", "seq", 64).collect()}
    assert got == want and len(got) == 80


def test_an_index_is_opened_again(spark):
    folder, rnd = scratch(spark, "index"), random.Random(6)
    texts = ["".join(rnd.choice("ACGT") for _ in range(300)) for _ in range(4)]
    first = SpanIndex(spark, 32, 2, folder)
    assert first.add(spark.createDataFrame(list(enumerate(texts)), "id long, seq string")).count() == 0
    first.close()
    for n in range(3):
        index = SpanIndex.open(spark, folder)
        assert {r.id for r in index.add(spark.createDataFrame([(10 + n, "GG" + texts[n])], "id long, seq string")).collect()} == {n, 10 + n}
        index.compact()
        index.close()
    index = SpanIndex.open(spark, folder)
    assert len(index.runs) < 4 and len(index.places) == 4
    index.close(delete=True)


def test_history_is_merged_without_sorting(spark):
    index, rnd = SpanIndex(spark, 32, 4), random.Random(7)
    for n in range(3):
        index.add(spark.createDataFrame([(10 * n + i, "".join(rnd.choice("ACGT") for _ in range(2000))) for i in range(9)], "id long, seq string"))
    names = [name for _, name in index.runs]
    with _runs_are_sorted(spark):
        merged = index._merged(names[2], names[:2])
        assert merged.filter(F.col("old_lo").isNotNull()).count() >= 0
        plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Sort [" not in plan and "Exchange" not in plan
    index.close(delete=True)
