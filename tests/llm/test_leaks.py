import random
from collections import Counter

import numpy as np
import pytest
import regex

from strandline.llm import leaks
from strandline.llm.leaks import leaked_windows


def cut(t):
    return [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t or "")]


def shingles(w, n):
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def similar(a, b, n):
    x, y = shingles(a, n), shingles(b, n)
    return sum((x & y).values()) / sum((x | y).values())


def made(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "straße", "東京", "١٢"]
    text = lambda m: " ".join(rnd.choice(words) for _ in range(m))
    items = [(i, text(rnd.randrange(5, 50))) for i in range(20)] + [(90, None), (91, ""), (None, text(30)), (92, "la " * 30)]
    items.append((93, items[3][1] + " end"))
    docs = []
    for i in range(n):
        parts = [text(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            w = (rnd.choice(items[:20])[1]).split()
            a = rnd.randrange(len(w))
            w = w[a : a + rnd.choice([12, 13, 14, 30])]
            if rnd.random() < 0.3:
                w[rnd.randrange(len(w))] = "changed"
            parts += [rnd.choice([" ", ", ", "\n"]).join(w).upper() if rnd.random() < 0.3 else "... ".join(w), text(rnd.randrange(5))]
        docs.append((i, " ".join(parts)))
    return items, [*docs, docs[0], (n, None), (n + 1, ""), (n + 2, "la " * 14), (None, items[0][1])]


@pytest.mark.parametrize("most", [leaks.MOST_WINDOWS, 10])
def test_leaks_are_those_of_brute_force(spark, most):
    items, docs = made(4, 120)
    want, like = set(), set()
    for i, t in items:
        for d, x in docs:
            if None in (i, d):
                continue
            a, b = cut(x), cut(t)
            for p in range(len(a) - 12):
                for q in range(len(b) - 12):
                    if a[p : p + 13] == b[q : q + 13]:
                        want.add((d, p, i, q))
    dd = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    ii = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = leaked_windows(dd, ii, "doc_id", "item_id", most_windows=most).collect()
    assert {(r.doc_id, r.doc_at, r.item_id, r.item_at) for r in got if r.same} == want and want
    texts, held = dict(docs), dict(items)
    for r in got:
        a, b = cut(texts[r.doc_id])[r.doc_at : r.doc_at + 13], cut(held[r.item_id])[r.item_at : r.item_at + 13]
        assert abs(r.similarity - similar(a, b, 5)) < 1e-9 and r.similarity >= 0.8


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**63, 400).astype(np.int64)
    index = leaks._Index(np.array([400]), hashes, 13, 5, 8)
    mine = index.prints.copy()
    for i in range(len(mine)):
        for bit in rng.choice(64, size=i % (leaks.RADIUS + 3), replace=False):
            mine[i] ^= np.uint64(1) << np.uint64(bit)
    got = set(zip(*map(list, index.within(mine))))
    assert got == {(i, j) for i, a in enumerate(mine) for j, b in enumerate(index.prints) if int(a ^ b).bit_count() <= leaks.RADIUS}


def test_share_of_near_windows_within_the_radius():
    """A window with its first or last word changed has the similarity of the threshold, 0.8: at least nine of ten must come from the blocks alone."""
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**63, 13 * 4000).astype(np.uint64).reshape(-1, 13)
    other = words.copy()
    other[np.arange(4000), np.where(np.arange(4000) % 2, 0, 12)] = rng.integers(0, 2**63, 4000).astype(np.uint64)
    prints = [leaks._prints(leaks._sets(leaks._shingles(x.ravel(), 5), np.arange(4000) * 13, 9)) for x in (words, other)]
    assert (np.bitwise_count(prints[0] ^ prints[1]) <= leaks.RADIUS).mean() > 0.97


def test_repeated_ids_are_texts_of_their_own(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, "other words " + text), (1, "short")], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(f"x{i}" for i in range(20))), (5, "a b " + " ".join(f"w{i}" for i in range(15)))], "item_id long, text string")
    got = {(r.doc_at, r.item_at) for r in leaked_windows(docs, items, "doc_id", "item_id", most_windows=1).filter("same").collect()}
    assert got == {(i, i + 2) for i in range(3)} | {(i + 2, i + 2) for i in range(3)}


def test_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert leaked_windows(df, items, "doc_id", "item_id").count() == 0
    assert leaked_windows(df.filter("doc_id > 1"), items.filter("item_id > 1"), "doc_id", "item_id").count() == 0


@pytest.mark.parametrize("most", [leaks.MOST_WINDOWS, 10])
@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_all_windows_of_the_similarity_are_found(spark, most, similarity):
    items, docs = made(7, 60)
    items, docs = [*((i, t) for i, t in items if i is not None), (94, "la la la la la tu " * 4)], [*((i, t) for i, t in docs if i is not None), (200, "la la la la tu la " * 4)]
    want, n = set(), 0
    windows = {(side, i): [w[p : p + 13] for p in range(len(w) - 12)] for side, rows in ((0, docs), (1, items)) for i, t in rows for w in [cut(t)]}
    sets = {k: [set(shingles(w, 5)) for w in v] for k, v in windows.items()}
    for (_, d), x in ((k, v) for k, v in windows.items() if k[0] == 0):
        for (_, i), y in ((k, v) for k, v in windows.items() if k[0] == 1):
            for p, a in enumerate(x):
                for q, b in enumerate(y):
                    if not sets[0, d][p].isdisjoint(sets[1, i][q]) and (a == b or similar(a, b, 5) >= similarity):
                        want.add((d, p, i, q))
                        n += a != b
    got = leaked_windows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), "doc_id", "item_id", similarity=similarity, most_windows=most)
    assert {(r.doc_id, r.doc_at, r.item_id, r.item_at) for r in got.collect()} == want and n > 100
