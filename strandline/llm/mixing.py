"""Mixing sources to target weights (problem 7), by a multivariate-hypergeometric splitting tree.

The documents of a source are divided into blocks by a hash. A source's quota of tokens is met by whole passes over its blocks and a last,
partial pass, each in a fresh random order: the first so many blocks of that sequence are its draws. The draws of all
sources are dealt to the output shards down a binary tree: a node's draws of each source are split between its two sides by one
multivariate-hypergeometric draw, so every shard is as random a sample of the mixture as sampling without replacement gives, and the
numbers add up exactly. Shards then take disjoint ranges of each source's sequence, and shuffle their documents locally.

The tree has two levels. The driver deals the blocks (``blocks`` a source, a table of fixed size) to at most GROUPS groups of shards. Where blocks are large, each is divided into
parts of about 1/64 of a shard by a second hash, and the tree below a group, which deals these parts to its shards, is grown in the workers from the group's numbers and
seed (4 bytes for each shard and source). Everything else is arithmetic on the hashes of a document; texts are shuffled once, to their shards.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrow import mix64
from ..shared import cut, small_rows

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: how the tokenizer of that file divides a text before merging; fixed by its vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCKS, GROUPS = 4096, 16
SHARD_TOKENS, LEAST_SHARDS = 4_000_000, 32
MAX_SOURCES = 256

_encoders: dict = {}


def _encoder(path: str):
    """One encoder a worker process, from the file as Spark sent it there."""
    if path not in _encoders:
        import base64

        import tiktoken

        sent = SparkFiles.get(os.path.basename(path))
        with open(sent if os.path.exists(sent) else path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(path: str = TOKENIZER):
    """A function of a text column: its number of tokens of the public tokenizer at ``path`` (null: 0). Long texts are counted whole.

    The file needs to be on the driver only; Spark sends it to the executors.
    """
    if os.path.exists(path):
        SparkSession.active().sparkContext.addFile(path)

    @F.pandas_udf("long")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(path)
        for series in texts:
            yield pd.Series([len(encoder.encode_ordinary(t)) if t else 0 for t in series], dtype="int64")

    return tokens


@dataclass(frozen=True)
class Source:
    """A source's part of the mixture. tokens and draws: of the whole mixture; blocks: those that hold documents; largest: tokens of the largest of them."""

    name: str
    share: float
    most: int | None
    available: int
    quota: float
    blocks: int
    draws: int
    tokens: int
    largest: int


def _steps(n: int, seed: int, passes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pass a permutation of 0..n-1 of the form (a x + c) mod n: a prime to n."""
    a = (mix64(passes.astype(np.uint64) * np.uint64(2) + np.uint64(seed)) % np.uint64(max(n, 1))).astype(np.int64)
    c = (mix64(passes.astype(np.uint64) * np.uint64(2) + np.uint64(seed + 1)) % np.uint64(max(n, 1))).astype(np.int64)
    while (bad := np.gcd(a, n) != 1).any():
        a = np.where(bad, (a + 1) % n if n > 1 else 1, a)
    return a, c


def plan_mixture(blocks: pd.DataFrame, targets: pd.DataFrame, total: int | None, seed: int) -> tuple[list[Source], dict[str, np.ndarray]]:
    """The quotas, and for each source the token counts of its blocks in their order.

    blocks: source, block, tokens. total: tokens of the mixture; by default the most that all caps allow, and never more than the sources hold.
    Shares are taken relative to the sum of the shares of the sources that have tokens.
    """
    order = {s: g.sort_values("block")["tokens"].to_numpy(np.int64) for s, g in blocks.groupby("source")}
    live = [t for t in targets.itertuples() if t.target_share > 0 and order.get(t.source, np.zeros(0)).sum() > 0 and (pd.isna(t.max_repeats) or t.max_repeats > 0)]
    whole = sum(t.target_share for t in live)
    size = {s: int(x.sum()) for s, x in order.items()}
    if total is None:
        caps = [size[t.source] * int(t.max_repeats) * whole / t.target_share for t in live if not pd.isna(t.max_repeats)]
        total = int(min([*caps, sum(size[t.source] for t in live)])) if live else 0
    plan = []
    for t in targets.itertuples():
        x, share = order.get(t.source, np.zeros(0, np.int64)), float(t.target_share) if not pd.isna(t.target_share) else 0.0
        cap = None if pd.isna(t.max_repeats) else int(t.max_repeats)
        available, quota, draws, tokens = int(x.sum()), 0.0, 0, 0
        if any(t.source == u.source for u in live):
            quota = total * share / whole
            if cap is not None:
                quota = min(quota, float(cap * available))
            full = int(Fraction(quota) // available)
            a, c = _steps(len(x), seed, np.array([full]))
            run = np.zeros(len(x), np.int64)
            run[(a[0] * np.arange(len(x)) + c[0]) % len(x)] = x
            run = np.concatenate([[0], np.cumsum(run)])
            more = int(np.argmin(np.abs(run - (quota - full * available)))) if cap is None or full < cap else 0
            draws, tokens = full * len(x) + more, full * available + int(run[more])
        plan.append(Source(t.source, share, cap, available, quota, len(x), draws, tokens, int(x.max(initial=0))))
    return plan, order


def split_draws(draws: list[int], shards: int | list[int], seed: int | list[int]) -> np.ndarray:
    """Draws of each shard (rows) and source (columns), dealt down a binary tree of multivariate-hypergeometric splits.

    shards: how many, or for each its weight.
    """
    weights = np.ones(shards, dtype=np.int64) if isinstance(shards, int) else np.array(shards, dtype=np.int64)
    before, seeds = np.concatenate([[0], np.cumsum(weights)]), [seed] if isinstance(seed, int) else list(seed)
    out = np.zeros((len(weights), len(draws)), dtype=np.int64)
    nodes = [(0, len(weights), np.array(draws, dtype=np.int64))] if len(weights) else []
    while nodes:
        lo, hi, have = nodes.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        left = int(have.sum()) * int(before[mid] - before[lo]) // int(before[hi] - before[lo])
        rng = np.random.default_rng([*seeds, lo, hi])
        taken = rng.multivariate_hypergeometric(have, left, method="marginals") if have.sum() else have * 0
        nodes += [(lo, mid, taken), (mid, hi, have - taken)]
    return out


class _Deal:
    """Where each use of a document goes: arithmetic on (source, rank of its block, part of the block)."""

    def __init__(self, blocks: list[int], draws: list[int], parts: list[int], ends: np.ndarray, shards: list[int], seed: int):
        self.blocks, self.draws, self.parts, self.ends, self.shards, self.seed = blocks, draws, parts, ends, shards, seed
        self.first = np.concatenate([[0], np.cumsum(shards)])
        self.below: dict = {}

    def _subtree(self, g: int) -> np.ndarray:
        """The ends of each shard of the group in the sequences of the sources."""
        if g not in self.below:
            have = (self.ends[g] - (self.ends[g - 1] if g else 0)) * np.array(self.parts)
            self.below[g] = np.cumsum(split_draws(have.tolist(), self.shards[g], [self.seed, 1, g]), axis=0).astype(np.int64 if have.max(initial=0) >= 2**31 else np.int32)
        return self.below[g]

    def uses(self, s: int, rank: int, part: int, passes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The passes that use the document, of those given, and the shard of each use."""
        n, many = self.blocks[s], self.parts[s]
        a, c = _steps(n, self.seed, passes)
        at = passes * n + (a * rank + c) % max(n, 1)
        used = at < self.draws[s]
        at, passes = at[used], passes[used]
        group = np.searchsorted(self.ends[:, s], at, side="right")
        shard = np.empty(len(at), dtype=np.int64)
        for g in np.unique(group):
            of = group == g
            begin = int(self.ends[g - 1, s]) if g else 0
            total = (int(self.ends[g, s]) - begin) * many
            a, c = _steps(total, self.seed + 7 * s + 1, np.array([g]))
            place = ((at[of] - begin) * many + part) % total
            place = np.array([(int(a[0]) * int(x) + int(c[0])) % total for x in place])
            shard[of] = self.first[g] + np.searchsorted(self._subtree(int(g))[:, s], place, side="right")
        return passes, shard


def mix_sources(
    documents: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", total: int | None = None,
    tokenizer: str = TOKENIZER, blocks: int = BLOCKS, shard_tokens: int = SHARD_TOKENS, least_shards: int = LEAST_SHARDS, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    Mixture: ``document`` (a struct of all columns of ``documents``), ``source, n_tokens, copy`` (0 for a document's first use), ``shard`` and ``place``, the
    random order inside the shard. Report: ``source, target_share, reached_share, quota_tokens, n_tokens, available_tokens, largest_block, max_repeats, most_uses``
    of every target. Shares are met up to one block (a source divided by ``blocks``); targets whose source has no documents reach 0 and
    the others share the total in proportion. A null max_repeats sets no cap. Documents with a null source or one without a
    target stay out, as do rows repeated whole; a null text has no tokens but takes part. ``id`` names a document; a null id is a value like any other.
    There are as many shards as tokens of the mixture in ``shard_tokens``, and no fewer than ``least_shards``.
    Of a target named several times the largest share holds; more than MAX_SOURCES targets are an error. Empty tables give an empty mixture.
    """
    spark = documents.sparkSession
    wanted = targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    named = small_rows(wanted, MAX_SOURCES)
    if named is None:
        raise ValueError(f"more than {MAX_SOURCES} targets")
    aim = pd.DataFrame([r.asDict() for r in named], columns=["source", "target_share", "max_repeats"])
    every = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    rows = documents.select(every.alias("document"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("_t"), F.col(f"`{id}`").alias("_id"))
    rows = rows.filter(F.col("source").isin(list(aim["source"]))).withColumn("_h", F.xxhash64(F.lit(seed), "source", "_id")).withColumn("_d", F.xxhash64(F.lit(seed + 1), "document"))
    sized = rows.withColumn("n_tokens", count_tokens(tokenizer)("_t")).withColumn("block", F.pmod("_h", F.lit(blocks)).cast("int")).drop("_t", "_id")
    sized = cut(sized, "sized")
    # repeated rows count once: two 64-bit hashes name a row, so no text is shuffled for it
    per = sized.select("source", "block", "_h", "_d", "n_tokens").distinct().groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")).toPandas()  # at most MAX_SOURCES x blocks rows
    plan, order = plan_mixture(per, aim, total, seed)
    mixed = sum(p.tokens for p in plan)
    shards = max(least_shards, math.ceil(mixed / shard_tokens))
    groups = min(shards, GROUPS)
    weights = [shards // groups + (g < shards % groups) for g in range(groups)]
    ends = np.cumsum(split_draws([p.draws for p in plan], weights, seed), axis=0)
    parts = [max(1, math.ceil(p.available / max(1, p.blocks) / max(1, shard_tokens // 64))) for p in plan]
    deal = _Deal([p.blocks for p in plan], [p.draws for p in plan], parts, ends, weights, seed)

    number = {p.name: i for i, p in enumerate(plan)}
    passes = [-(-p.draws // p.blocks) if p.blocks else 0 for p in plan]
    ranks = [(s, int(b), i, number[s], parts[number[s]], passes[number[s]]) for s, g in per.groupby("source") for i, b in enumerate(sorted(g["block"]))]
    ranked = spark.createDataFrame(ranks, "source string, block int, rank int, s int, parts int, passes long")

    @F.pandas_udf("array<struct<copy: long, shard: int>>")
    def uses(s: pd.Series, rank: pd.Series, part: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
        out, memo = [], {}
        for key in zip(s, rank, part, first, last):
            if key not in memo:
                copies, shard = deal.uses(int(key[0]), int(key[1]), int(key[2]), np.arange(int(key[3]), int(key[4])))
                memo[key] = [{"copy": int(x), "shard": int(y)} for x, y in zip(copies, shard)]
            out.append(memo[key])
        return pd.Series(out)

    # a document used very often comes in rows of 4,096 passes
    turns = sized.join(F.broadcast(ranked), ["source", "block"]).filter("passes > 0").withColumn("first", F.explode(F.expr("sequence(0L, passes - 1, 4096L)")))
    turns = turns.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 2), "_h"), F.col("parts")).cast("int")).withColumn("last", F.least(F.col("first") + 4096, F.col("passes")))
    used = turns.withColumn("u", F.explode(uses("s", "rank", "part", "first", "last"))).select("document", "source", "n_tokens", "u.copy", "u.shard", "_h", "_d")
    same = ["_h", "_d", "source", "copy"]
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "_h", "copy", "shard"), *same)
    again = F.lag(F.struct(*same)).over(local).eqNullSafe(F.struct(*same))
    mixture = used.withColumn("place", F.dense_rank().over(local)).withColumn("_again", again).filter("NOT _again").drop("_h", "_d", "_again")
    report = spark.createDataFrame(
        [(p.name, p.share, p.tokens / mixed if mixed else 0.0, float(p.quota), p.tokens, p.available, p.largest, p.most, k) for p, k in zip(plan, passes)],
        "source string, target_share double, reached_share double, quota_tokens double, n_tokens long, available_tokens long, largest_block long, max_repeats int, most_uses long",
    )
    return mixture, report
