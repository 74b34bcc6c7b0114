import random

import numpy as np
import pytest
import regex

from strandline.llm import quality
from strandline.llm.quality import NOT_PROSE, TYPES, learn, text_statistics, text_types

COMMON = ["the", "and", "Of", None, "in", "die"]


def plain(t):
    t = t or ""
    words = regex.findall(r"[\p{L}\p{N}]+", t)
    lines = [x.strip(" \t\r") for x in t.split("\n")]
    lines = [x for x in lines if x]
    letters = sum(map(len, words))
    marks = len(regex.sub(r"[\p{L}\p{N} \t\r\n]", "", t))
    common = sum(w.lower() in {c.lower() for c in COMMON if c} for w in words)
    ended = sum(x[-1] in ".!?:;…\"')" for x in lines)
    return len(words), letters, marks, common, len(lines), ended


def found(t):
    n, letters, marks, common, lines, ended = plain(t)
    return n == 0 or (letters + marks >= 20 and marks > 0.2 * (letters + marks)) or letters / n > 9 or (n >= 8 and common / n < 0.2) or (lines >= 5 and ended / lines < 0.25)


def made():
    rnd = random.Random(2)
    bits = ["the", "and", "of", "house", "Wörter", "東京", "١٢", ".", ",", "\n", "\r\n", "\t", " ", "|", "…", ")", "é", "​", " ", "😀", "supercalifragilistic", "!\n", "- item\n", "1. x\n", "DIE", "In"]
    texts = [None, "", " \n ", "word", "a\r\nb\r\nc.\r\nd\r\ne", "x" * 100, "the " * 8, "a b c d e f g h", "|" * 40]
    return [*texts, *("".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randrange(40))) for _ in range(400))]


@pytest.mark.parametrize("most", [100, 2])
def test_statistics(spark, most):
    texts = made()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, words string")
    common = spark.createDataFrame([(c,) for c in COMMON], "word string")
    got = {r.document.id: r for r in text_statistics(df, "text", common, max_common=most).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_letters, r.n_marks, r.n_common, r.n_lines, r.n_ended_lines) == plain(t), repr(t)
        assert (r.mean_word_length is None) == (r.n_words == 0) and (r.ended_share is None) == (r.n_lines == 0)


def test_types_and_the_rule(spark):
    texts = made()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    common = spark.createDataFrame([(c,) for c in COMMON], "word string")
    rows = text_types(df, "text", common).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert any(r[f"v_{n}"] for n in NOT_PROSE) == found(texts[r.document.id]) == (r.p_prose == 0)
        p = [r.p_prose, r.p_list, r.p_table, r.p_junk]
        assert abs(sum(p) - 1) < 1e-9 and r.text_type == ["prose", "list", "table", "junk"][p.index(max(p))]
    assert text_types(df.filter("id < 0"), "text", common).count() == 0
    assert text_types(df, "text", common.filter("false")).count() == len(texts)


def planted(n, rnd):
    """Texts of known type: prose and lists, tables and junk of several kinds."""
    usual = "the and of in to a is that it was for on with as by at from this be are".split()
    rare = ["".join(rnd.choice("bdfglmnprstv") + rnd.choice("aeiou") for _ in range(rnd.randrange(2, 5))) for _ in range(500)]
    word = lambda: rnd.choice(usual) if rnd.random() < 0.45 else rnd.choice(rare)
    sentence = lambda: " ".join(word() for _ in range(rnd.randrange(6, 16))).capitalize() + rnd.choice([".", ".", "?", "!"])
    some = lambda low, high, f, by: by.join(f() for _ in range(rnd.randrange(low, high)))
    cell = lambda: rnd.choice([str(rnd.randrange(9999)), f"{rnd.random() * 99:.2f}", rnd.choice(rare)])
    symbols = lambda: "".join(rnd.choice("=&!*.-$#~?^%@ ") for _ in range(rnd.randrange(20, 200)))
    letters = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(rnd.randrange(80, 400)))
    kinds = {
        "prose": [lambda: some(1, 12, sentence, " "), lambda: some(1, 8, sentence, "\n\n")],
        "list": [lambda: some(5, 20, lambda: "* " + some(1, 4, lambda: rnd.choice(rare), " "), "\n"), lambda: some(5, 20, lambda: f"{rnd.randrange(1, 99)}. " + some(1, 4, word, " "), "\n")],
        "table": [lambda: some(5, 20, lambda: "| " + " | ".join(cell() for _ in range(4)) + " |", "\n"), lambda: some(5, 20, lambda: "\t".join(cell() for _ in range(4)), "\n")],
        "junk": [symbols, letters, lambda: "\n\n", lambda: some(10, 40, lambda: rnd.choice(rare), " ")],
    }
    share = {"prose": 0.85, "list": 0.06, "table": 0.04, "junk": 0.05}
    return [(t, rnd.choice(kinds[t])()) for t in rnd.choices(list(share), list(share.values()), k=n)], usual


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_types_are_told_apart(spark, seed):
    rows, usual = planted(3000, random.Random(seed))
    df = spark.createDataFrame([(i, t, kind) for i, (kind, t) in enumerate(rows)], "id int, text string, kind string")
    common = spark.createDataFrame([(w,) for w in usual], "word string")
    got = [(r.document.kind, r.text_type) for r in text_types(df, "text", common).collect()]
    for t in TYPES:
        right = sum(kind == t == said for kind, said in got)
        assert right >= 0.9 * sum(kind == t for kind, _ in got), (t, right)
        assert right >= 0.9 * sum(said == t for _, said in got), (t, right)


def test_learning_recovers_rates_and_types():
    """Votes drawn from the model itself: rates, shares and classes come back, none of them at a bound."""
    rnd = np.random.default_rng(8)
    n_types = quality._VOTES_FOR.shape[1]
    real = np.where(quality._IMPOSSIBLE, 0, np.where(quality._VOTES_FOR, rnd.uniform(0.6, 0.95, quality._VOTES_FOR.shape), rnd.uniform(0.01, 0.06, quality._VOTES_FOR.shape)))
    truth = rnd.choice(n_types, 20000, p=[0.5, 0.1] + [0.4 / (n_types - 2)] * (n_types - 2))
    votes = rnd.random((len(truth), len(real))) < real[:, truth].T
    patterns, inverse, number = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = learn([(tuple(p), int(n)) for p, n in zip(patterns, number)])
    assert np.abs(model.rates - real).max() < 0.12 and abs(model.shares[0] - 0.5) < 0.06
    free = ~quality._IMPOSSIBLE & ~quality._VOTES_FOR
    assert (model.rates[free] < quality._MOST_OUTSIDE).all() and (model.rates[quality._IMPOSSIBLE] == 0).all()
    said = (model.posterior @ quality._TYPE_OF).argmax(axis=1)[inverse.ravel()]
    assert (said == quality._TYPE_OF[truth].argmax(axis=1)).mean() > 0.9


def test_learning_from_nothing():
    assert learn([]).posterior.shape == (0, quality._VOTES_FOR.shape[1])
