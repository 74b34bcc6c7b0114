import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandline.operators import hamming as H
from strandline.operators.minhash import candidates, signature_rows
from strandline.operators.windows import first_of_equal, load_genome, wide_windows, windows


def test_blocks_find_the_distances_that_count():
    rnd = np.random.default_rng(3)
    letters = np.frombuffer(b"ACGTN-", np.uint8)
    for length, most in ((100, 5), (37, 1), (200, 10), (9, 0), (64, 7)):
        window, w_len = letters[rnd.integers(0, 6, (60, 230))], rnd.integers(0, 231, 60)
        read = window[:, 15 : 15 + length].copy()
        for i in range(60):
            read[i, rnd.integers(0, length, i % (most + 3))] = ord("A")
        window[50:], read[50:] = ord("A"), ord("A")
        whole = H._distances(window, w_len, [read, read[:, ::-1]], 7)
        for (d, at), (want, first) in zip(H._near(window, w_len, [read, read[:, ::-1]], most), whole):
            hit = want <= most
            assert np.array_equal(hit, d <= most) and np.array_equal(d[hit], want[hit]) and np.array_equal(at[hit], first[hit])


def test_reverse_complements_of_any_letters():
    texts = ["ACGTN", "", None, "aC-G", "AÉ東G"]
    for some in (texts[:4], texts):
        column = pa.array(some)
        got, _ = H.matrix(column)
        back = H._reverse_complements(column, got, H.matrix(column)[1])
        assert [bytes(x).rstrip(b"\0").decode() for x in back] == [(x or "").translate(H._PAIR)[::-1] for x in some]


def test_densest_stretches():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("AACGTN") for _ in range(n)) for n in (0, 31, 32, 33, 200, 5, 90)] + [None]
    want = [[max((x[i : i + 32].count(c) for i in range(len(x) - 31)), default=7) if x and len(x) >= 32 else 7 for c in "ACGT"] for x in texts]
    assert H.densest(pa.array(texts), 7).tolist() == want
    assert H.densest(pa.array(["É" * 40]), 7).tolist() == [[32] * 4]


def test_runs_of_other_letters_meet_no_read_of_one_letter(spark):
    """Windows of N and reads of A share their hashes (N counts as A): every pair was compared before, though none can be a hit."""
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    chroms = [text(300) + "N" * 400 + text(300) for _ in range(12)] + [text(500) + "A" * 300 + text(200)]
    genome = load_genome(spark.createDataFrame([(i, f"c{i}", s, 1) for i, s in enumerate([*chroms, chroms[12], chroms[3]])], "chrom_id int, name string, seq string, profile_id int"))
    texts = ["A" * (60 + i) for i in range(20)] + ["T" * 70 + "C", chroms[12][450:550], chroms[3][20:110], chroms[5][210:305]]
    reads = spark.createDataFrame([(i, 0, i, x) for i, x in enumerate(texts)], "read_id long, file_id int, read_id_in_file long, seq string")
    assert sorted(x.chrom_id for x in first_of_equal(genome).collect()) == list(range(13))
    wide = wide_windows(genome, 16, 128, 50)
    assert sorted(map(tuple, wide.select("chrom_id", "pos", "seq").collect())) == sorted(map(tuple, windows(genome, 16, 128).select("chrom_id", "pos", "seq").collect()))
    sides = [signature_rows(H.with_density(wide, "wide"), ["chrom_id", "pos", "have"], "seq", 16, 4), signature_rows(H.with_density(reads, "seq", 0.05), ["read_id", "need", "turned"], "seq", 16, 4)]
    every = candidates(*sides, min_hits=2).filter("read_id < 21")
    assert every.filter("chrom_id < 12").count() > 200
    few = candidates(*sides, min_hits=2, only=H.may_hit()).filter("read_id < 21")
    assert few.filter("chrom_id < 12").count() == 0 < few.count()
    hits = {r.read_id: (r.hamming, r.chrom_id) for r in H.map_reads(reads, genome, hashes=4, min_hits=2).collect()}
    assert {i: hits.get(i) for i in range(20)} == dict.fromkeys(range(20), (0, 12)) and hits[20] == (1, 12)
    assert all(c < 13 for _, c in hits.values())
