import random
from collections import Counter

import pytest

from strandline.operators.minhash import _met, candidates


@pytest.mark.parametrize(("min_hits", "block"), [(1, 8192), (2, 8192), (2, 30), (3, 30), (4, 7)])
def test_pairs_that_only_meet_in_heavy_buckets_are_not_joined(spark, min_hits, block):
    rnd = random.Random(min_hits * block)
    # most have key 0 with the first hash function, many with the others
    keys = lambda: [0 if rnd.random() < share else rnd.randrange(1, 60) for share in (0.9, 0.3, 0.1, 0.05)]
    windows, reads = {(i % 7, 113 * i): keys() for i in range(300)}, {i: keys() for i in range(400)}
    w = spark.createDataFrame([(*i, k) for i, k in windows.items()], "chrom_id int, pos int, keys array<long>")
    r = spark.createDataFrame(list(reads.items()), "read_id long, keys array<long>")
    want = {(c, p, i, n) for (c, p), x in windows.items() for i, y in reads.items() if (n := sum(a == b for a, b in zip(x, y))) >= min_hits}
    got = [tuple(x) for x in candidates(w, r, min_hits=min_hits, block=block, heavy=500).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    every = sum(Counter((h, k) for x in windows.values() for h, k in enumerate(x))[b] * n for b, n in Counter((h, k) for y in reads.values() for h, k in enumerate(y)).items())
    assert _met(w, r, min_hits, block, 500).count() < (every + 1 if min_hits == 1 else every / 4)
