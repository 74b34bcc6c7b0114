import random

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions import sequence as S
from strandline.functions.arrow import packed_kmers
from strandline.operators.hamming import NONE, shifted_hamming
from strandline.operators.minhash import bottom_sketch, minhash, murmur64

PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}
MASK = 2**64 - 1


def rc(s):
    return "".join(PAIR.get(c, c) for c in reversed(s))


def murmur(x):
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & MASK
    x = ((x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53) & MASK
    return x ^ (x >> 33)


def code(s):
    return int("".join(str("ACGT".index(c) if c in "ACGT" else 0) for c in s) or "0", 4)


def canonical(s, k):
    clean = "".join(c if c in "ACGT" else "A" for c in s)
    return [min(code(clean[i : i + k]), code(rc(clean[i : i + k]))) for i in range(len(s) - k + 1)]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_murmur_and_packing():
    x = np.array([0, 1, 2**63, MASK, 123456789], dtype=np.uint64)
    assert murmur64(x).tolist() == [murmur(int(v)) for v in x]
    rnd = random.Random(0)
    s = [rnd.randrange(4) for _ in range(100)]
    for k in (1, 2, 3, 7, 16, 31, 32):
        want = [int("".join(map(str, s[i : i + k])), 4) for i in range(100 - k + 1)]
        assert packed_kmers(np.array(s, dtype=np.uint8), k).tolist() == want


def test_minhash_and_sketch(spark):
    rnd = random.Random(5)
    rows = [(i, "".join(rnd.choice("ACGTN" if i % 7 == 0 else "ACGT") for _ in range(rnd.randrange(60)))) for i in range(200)] + [(900, None)]
    df = spark.createDataFrame(rows, "id int, s string")
    for k in (5, 16, 32):
        got = {(r.id, r.h): r.key for r in minhash(df, ["id"], "s", k, 3).collect()}
        sketch = {r.id: r.sketch for r in bottom_sketch(df, ["id"], "s", k, 4).collect()}
        want, want_sketch = {}, {}
        for i, s in rows:
            if s is not None and len(s) >= k:
                c = canonical(s, k)
                for h in range(3):
                    key = min(murmur((x + h) & MASK) for x in c) & (4**k - 1)
                    want[i, h] = key - 2**64 if key >= 2**63 else key
                want_sketch[i] = [x - 2**64 if x >= 2**63 else x for x in sorted({murmur(x) for x in c})[:4]]
        assert got == want and sketch == want_sketch


def test_shifted_hamming(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(300):
        w = "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(5, 60)))
        n = rnd.randrange(1, len(w) + 3)
        at = rnd.randrange(max(1, len(w) - n + 1))
        r = list(w[at : at + n])
        for _ in range(rnd.randrange(3)):
            r[rnd.randrange(len(r))] = rnd.choice("ACGTN")
        rows.append((i, w, rc("".join(r)) if i % 2 else "".join(r)))
    rows += [(900, "ACGT", "ACGTA"), (901, "", "A")]
    got = {r.id: (r.orientation, r.hamming, r.shift) for r in shifted_hamming(spark.createDataFrame(rows, "id int, window_seq string, read_seq string"), 0.2).collect()}
    for i, w, r in rows:
        best = min(((sum(a != b for a, b in zip(x, w[s:])), o, s) for o, x in ((1, r), (2, rc(r))) for s in range(len(w) - len(r) + 1)), default=(10**6, 3, 0))
        want = (best[1], best[0], best[2]) if best[0] <= int(np.floor(np.float32(len(r)) * np.float32(0.2))) else (NONE, None, None)
        assert got[i] == want, (w, r)


def test_scalars(spark):
    r = one(spark, S.reverse_complement(F.lit("ACGNT")).alias("a"), S.encode_2bit(F.lit("ACGT")).alias("b"), S.decode_2bit(F.lit(27), 4).alias("c"), S.mapq(F.lit(100), F.lit(0)).alias("d"), S.mapq(F.lit(0), F.lit(0)).alias("e"), S.mapq(F.lit(100), F.lit(50)).alias("f"), S.split_tokens(F.lit("a:b:"), ":").alias("g"), S.format_cigar(S.parse_cigar(F.lit("3S10M2I"))).alias("h"), S.cigar_span(F.lit("3S10M2I4D"), "MD").alias("i"), S.memory_bytes(F.lit("2K")).alias("j"), S.memory_bytes(F.lit("x")).alias("k"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j, r.k) == ("ANCGT", 27, "ACGT", 254, 0, 7, ["a", "b"], "3S10M2I", 14, 2048, None)
    q = "".join(map(chr, range(33, 127)))
    r = one(spark, S.quality_bins(F.lit(q), 1).alias("a"), S.quality_bins(F.lit(q), 2).alias("b"))
    assert r.a == "".join("(" if ord(c) - 33 <= 13 else "5" for c in q)
    assert r.b == "".join("$" if ord(c) - 33 <= 4 else "(" if ord(c) - 33 <= 13 else "1" if ord(c) - 33 <= 20 else "9" for c in q)
    e = one(spark, S.extend_window(F.lit(0), 128, 50, F.lit(1000)).alias("e"), S.extend_window(F.lit(900), 128, 50, F.lit(1000)).alias("f"), S.window_ids(F.lit(112), F.lit(2), F.lit(1000), 128, 16).alias("g"), S.window_ids(F.lit(5), F.lit(2), F.lit(3), 128, 16).alias("h"))
    assert tuple(e.e) == (0, 50, 0, 178) and tuple(e.f) == (50, 0, 850, 150) and e.g == [0, 1] and e.h == []


def test_set_operations(spark):
    a, b = F.array(*map(F.lit, (3, 1, 1, 2))), F.array(*map(F.lit, (2, 2, 5)))
    r = one(spark, A.merged(a, b).alias("m"), A.union(a, b).alias("u"), A.intersection(a, b).alias("i"), A.difference(a, b).alias("d"), A.symmetric_difference(a, b).alias("s"), A.frequent([a, b], 2).alias("f"), A.frequent([a, b], 2, 1).alias("n"), A.repeated(a, 2).alias("r"), A.first_n(a, 2).alias("t"))
    assert (r.m, r.u, r.i, r.d, r.s, r.f, r.n, r.r, r.t) == ([1, 1, 2, 2, 2, 3, 5], [1, 2, 3, 5], [2], [1, 3], [1, 3, 5], [1, 2], [], [1, 1], [3, 1])
