import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.llm.pieces import genome_pieces, split_pieces


def grouped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.record.id, []).append(r)
    return {i: sorted(x, key=lambda r: r.piece_no) for i, x in out.items()}


def test_pieces_hold_the_text_and_cut_at_gaps(spark):
    rnd, rows = random.Random(1), []
    for i in range(1500):
        w, g = rnd.choice([20, 30, 50]), rnd.choice([1, 3, 6, 10])
        k1 = min(rnd.choice([0, 3, 7, 15]), w - g - 1)
        s = ""
        while len(s) < rnd.choice([0, 10, 60, 200, 400]):
            s += "".join(rnd.choice("ACGT") for _ in range(rnd.choice([1, w - k1, w, w - 1, w + 1, 5, k1, 8]))) + rnd.choice("Nn-") * rnd.choice([1, g - 1, g, g + 1, 2 * w, 0, g])
        rows.append((i, s, w, k1, g))
    got = grouped(split_pieces(spark.createDataFrame(rows, "id int, seq string, w int, ov int, g int"), "seq", "w", "ov", "g"))
    for i, s, w, k1, g in rows:
        pieces = got[i]
        assert all(len(p.piece) <= w and s[p.piece_start : p.piece_start + len(p.piece)] == p.piece for p in pieces)
        assert pieces[0].piece_start == 0 and pieces[-1].piece_start + len(pieces[-1].piece) == len(s) and pieces[-1].cut == "end"
        assert all(b.piece_start == a.piece_start + len(a.piece) - k1 for a, b in zip(pieces, pieces[1:]))
        if len(s) > w:
            stretches = re.split("[Nn-]{%d,}" % g, s)
            assert any(p.cut == "forced" for p in pieces) == (max(map(len, stretches)) > w)
            at = 0
            for m in [*re.finditer("[Nn-]{%d,}" % g, s), None]:  # each stretch that fits stands whole in a piece
                end = m.start() if m else len(s)
                if end - at <= w:
                    assert any(p.piece_start <= at and p.piece_start + len(p.piece) >= end for p in pieces), (s, w, k1, g)
                at = m.end() if m else at


def test_odd_rows(spark):
    rows = [(0, None, 5), (1, "", 5), (2, "ACGT", None), (3, "ACGTACGT", 0), (4, "é😀" * 6, 5), (4, "é😀" * 6, 5)]
    df = spark.createDataFrame(rows, "id int, seq string, w int").withColumn("piece", F.lit("mine"))
    got = grouped(split_pieces(df, "seq", "w", 2, 3))
    assert [got[i][0].piece for i in (0, 1, 2, 3)] == [None, "", None, None] and all(len(got[i]) == 1 for i in range(4))
    assert len(got[4]) == 8 and got[4][0].record.piece == "mine" and {len(p.piece) for p in got[4]} == {5, 3}.union({len(p.piece) for p in got[4]} - {5, 3})
    assert split_pieces(df.filter("id > 9"), "seq", "w", 2, 3).count() == 0


def test_a_long_sequence(spark):
    s = ("ACGT" * 300 + "N" * 20) * 400
    df = spark.createDataFrame([(0, s)], "id int, seq string")
    got = grouped(split_pieces(df, "seq", 2048, 15, 10))[0]
    assert all(p.cut != "forced" for p in got) and sum(len(p.piece) for p in got) == len(s) + 15 * (len(got) - 1)


@pytest.mark.parametrize("rows", [[(1, "n", "ACGTACGTACGT", 12, 1)] * 2 + [(2, "n", None, None, 1), (3, "n", "ACGTA", 5, 9)]])
def test_genome_rows_count_once(spark, rows):
    g = spark.createDataFrame(rows, "chrom_id int, name string, seq string, len int, profile_id int")
    o = spark.createDataFrame([(1, 3, 5, 2)], "profile_id int, kmerlength int, window_size int, min_gap int")
    got = [(r.record.chrom_id, r.piece) for r in genome_pieces(g, o).collect()]
    assert sorted(p for c, p in got if c == 1) == sorted(["ACGTA", "TACGT", "GTACG", "CGT"]) and [p for c, p in got if c != 1] == [None, None]


def test_offsets_of_very_many_pieces(spark):
    """More pieces than a block of running sums holds, several times over."""
    s = "".join("ACGT"[i * i % 7 % 4] for i in range(200_000))
    got = grouped(split_pieces(spark.createDataFrame([(0, s), (1, s[:700])], "id int, seq string"), "seq", 40, 15, 3))
    for text, pieces in ((s, got[0]), (s[:700], got[1])):
        assert all(text[p.piece_start : p.piece_start + len(p.piece)] == p.piece for p in pieces) and pieces[-1].piece_start + len(pieces[-1].piece) == len(text)
        assert [p.piece_start for p in pieces[1:]] == [25 * (i + 1) for i in range(len(pieces) - 1)]
