import numpy as np
from pyspark.sql import functions as F

from strandline.llm.mixing import _steps, count_tokens, mix_sources, split_draws


def docs(spark, n=900):
    rows = [(i, "word " * (1 + i % 17), ["a", "a", "a", "a", "b", "b", "c", "x", None][i % 9]) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", "b"), (n + 2, "one", None), (None, "no id", "a")]
    return spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, shard int")


TARGETS = [("a", 0.3, 1), ("b", 0.3, None), ("c", 0.3, 4), ("empty", 0.1, 2), ("zero", 0.0, None), (None, 0.5, 1)]


def test_shares_caps_and_disjoint_copies(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixture, report = mix_sources(docs(spark), targets, blocks=64, shard_tokens=500)
    rows = mixture.select("document.doc_id", "document.shard", "source", "copy", mixture["shard"].alias("s"), "place", "n_tokens").collect()
    got = {r.source: r for r in report.collect()}
    total = sum(r.n_tokens for r in rows)
    for s in "abc":
        assert abs(sum(r.n_tokens for r in rows if r.source == s) / total - 1 / 3) < 0.02
        assert abs(got[s].reached_share - sum(r.n_tokens for r in rows if r.source == s) / total) < 1e-9
    assert got["empty"].n_tokens == got["zero"].n_tokens == 0 and {r.source for r in rows} == {"a", "b", "c"}
    uses = [(r.source, r.doc_id, r.copy) for r in rows]
    assert len(uses) == len(set(uses))
    most = {s: max(r.copy for r in rows if r.source == s) + 1 for s in "abc"}
    assert most["a"] == 1 and most["c"] <= 4 and all(most[s] <= got[s].most_uses for s in "abc")
    for s in {r.s for r in rows}:
        assert sorted(r.place for r in rows if r.s == s) == list(range(1, 1 + sum(r.s == s for r in rows)))
    assert len({r.s for r in rows}) > 3
    again = mix_sources(docs(spark), targets, blocks=64, shard_tokens=500)[0].select("document.doc_id", "copy", "shard", "place").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, mixture.select("document.doc_id", "copy", mixture["shard"], "place").collect()))


def test_a_given_total_repeats_small_sources(spark):
    targets = spark.createDataFrame([("b", 0.5, None), ("c", 0.5, 2)], "source string, target_share double, max_repeats int")
    mixture, report = mix_sources(docs(spark), targets, total=20_000, blocks=32)
    got = {r.source: r for r in report.collect()}
    assert got["c"].n_tokens == 2 * got["c"].available_tokens and got["c"].most_uses == 2
    assert abs(got["b"].n_tokens - 10_000) < got["b"].available_tokens / 16
    assert mixture.groupBy("source", "document.doc_id").count().filter("source = 'c'").agg(F.max("count")).first()[0] == 2


def test_the_tree_keeps_every_draw():
    for shards in (1, 2, 7, 32):
        out = split_draws([1000, 0, 3, 250], shards, 5)
        assert out.sum(axis=0).tolist() == [1000, 0, 3, 250] and out.min() >= 0
        assert out.sum(axis=1).max() - out.sum(axis=1).min() <= max(1, shards.bit_length())
    a, c = _steps(12, 3, np.arange(20))
    assert all(sorted((a[p] * np.arange(12) + c[p]) % 12) == list(range(12)) for p in range(20))


def test_shards_are_many_and_alike(spark):
    """Two levels of the tree, repeated rows once, one source of nearly all documents, and no shard far over the mean."""
    rows = [(i, "word " * (1 + i % 17), "ab"[i % 10 == 0]) for i in range(4000)]
    df = spark.createDataFrame(rows + rows[:500], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, None)], "source string, target_share double, max_repeats int")
    mixture, report = mix_sources(df, targets, blocks=256, shard_tokens=400)
    sizes = [r.n for r in mixture.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()]
    assert len(sizes) == max(32, -(-sum(sizes) // 400)) >= 100 and max(sizes) < 2 * sum(sizes) / len(sizes)
    uses = mixture.groupBy("source", "document.doc_id").count().collect()
    assert sum(r.source == "a" for r in uses) > 1500 and all(r["count"] == 1 for r in uses if r.source == "a")
    counted = {r.source: r.n for r in mixture.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert counted == {r.source: r.n_tokens for r in report.collect()}


def test_very_many_uses_of_one_document(spark):
    df = spark.createDataFrame([(1, "one two", "a"), (2, "x " * 3000, "b")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.9, None), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    mixture, _ = mix_sources(df, targets, total=30_000)
    copies = sorted(r.copy for r in mixture.filter("source = 'a'").select("copy").collect())
    assert copies == list(range(len(copies))) and len(copies) > 8192


def test_no_rows(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    mixture, report = mix_sources(docs(spark).filter("doc_id < 0"), targets)
    assert mixture.count() == 0 and {r.reached_share for r in report.collect()} == {0.0}
    mixture, report = mix_sources(docs(spark), targets.filter("false"))
    assert mixture.count() == report.count() == 0


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([("Hello world",), (None,), ("",), ("<|endoftext|> é" * 5000,)], "t string")
    n = [r.n for r in df.select(count_tokens()("t").alias("n")).collect()]
    assert n[:3] == [2, 0, 0] and n[3] > 20_000
