"""Per-document text statistics, and text types learned from them (problem 8).

The statistics are SQL expressions, one pass over the text, no shuffle. Thresholds on them act as noisy labelling functions: each votes
for one or several types, or abstains. How often each votes in documents of each type isn't set but learned, by expectation-maximization on
how they agree, from the number of documents of each pattern of votes. There are at most 2 ^ (number of functions) patterns whatever the
corpus holds, so what the driver sees is of fixed size while every document counts. Each document then gets the posterior of its pattern.

The thresholds that the statement of the problem fixes are functions like the others, but known never to vote in prose: the rate of their votes in
prose is held at 0. So the posterior of prose is 0 exactly where one of them votes, and which of the other types it is remains to be learned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut as cut_lineage
from ..shared import small_rows

TYPES = ("prose", "list", "table", "junk")
#: fixed by the statement of the problem
SENTENCE_ENDS = (".", "!", "?", ":", ";", "…", '"', "'", ")")
MAX_COMMON = 50_000

STATISTICS = {
    "n_words": "bigint", "n_letters": "bigint", "n_marks": "bigint", "mean_word_length": "double", "mark_share": "double", "n_common": "bigint",
    "common_share": "double", "n_lines": "bigint", "n_ended_lines": "bigint", "ended_share": "double", "digit_share": "double", "n_separators": "bigint", "bulleted_share": "double",
}


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def text_statistics(documents: DataFrame, text: str, common: DataFrame, word: str = "word", max_common: int = MAX_COMMON) -> DataFrame:
    """``document`` (a struct of the other columns) and the STATISTICS of each text; a ratio to nothing is null.

    Words are runs of letters and digits in lower case; marks are what is neither letter, digit, space, tab, CR nor LF; lines are
    split at LF, trimmed, empty ones dropped. A null text counts as empty. Repeated rows stay. ``common`` holds the common words in any
    column ``word`` (case doesn't matter, nulls are ignored): up to ``max_common`` of them become a hash set inside the expression; a longer
    list is joined with the words instead.
    """
    own = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns if c != text)).alias("document"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    lines = F.filter(F.transform(F.split("t", "\\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+\z", "")), lambda x: x != "")
    cut = own.select(
        "document", F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"), lines.alias("lines"),
        F.length(F.regexp_replace("t", r"[\p{L}\p{N} \t\r\n]+", "")).cast("long").alias("n_marks"),
        F.length(F.regexp_replace("t", r"[^\p{N}]+", "")).alias("digits"), F.length(F.regexp_replace("t", r"[^|\t;]+", "")).cast("long").alias("n_separators"),
    )
    lower = common.select(F.lower(f"`{word}`").alias("w")).filter(F.col("w").isNotNull()).distinct()
    known = small_rows(lower, max_common)
    if known is not None:
        is_common = lambda x: F.lower(x).isin([r["w"] for r in known]) if known else F.lit(False)
        n_common = F.size(F.filter("words", is_common)).cast("long")
    else:
        cut = cut_lineage(cut.withColumn("key", F.expr("uuid()")), "texts")
        hits = cut.select("key", F.explode(F.transform("words", F.lower)).alias("w")).groupBy("key", "w").count().join(lower, "w", "left_semi").groupBy("key").agg(F.sum("count").alias("n"))
        cut = cut.join(hits, "key", "left")
        n_common = F.coalesce("n", F.lit(0)).cast("long")
    counted = cut.select(
        "document", F.size("words").cast("long").alias("n_words"), F.aggregate("words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("n_letters"), "n_marks", n_common.alias("n_common"),
        F.size("lines").cast("long").alias("n_lines"), F.size(F.filter("lines", lambda x: F.right(x, F.lit(1)).isin(list(SENTENCE_ENDS)))).cast("long").alias("n_ended_lines"), "digits", "n_separators",
        F.size(F.filter("lines", lambda x: x.rlike(r"^(?:[-*•+]|\d{1,3}[.)])\s"))).alias("bulleted"),
    )
    return counted.withColumn("n_visible", F.col("n_letters") + F.col("n_marks")).select(
        "document", "n_words", "n_letters", "n_marks", _ratio("n_letters", "n_words").alias("mean_word_length"), _ratio("n_marks", "n_visible").alias("mark_share"), "n_common",
        _ratio("n_common", "n_words").alias("common_share"), "n_lines", "n_ended_lines", _ratio("n_ended_lines", "n_lines").alias("ended_share"),
        _ratio("digits", "n_letters").alias("digit_share"), "n_separators", _ratio("bulleted", "n_lines").alias("bulleted_share"),
    )


#: Latent classes of documents and their types: the ways of being prose, a list or junk differ too much for one set of rates.
CLASSES = {"prose": "prose", "casual": "prose", "bullets": "list", "lines": "list", "table": "table", "noise": "junk", "terms": "junk"}
#: Name -> (condition of its vote, classes it votes for). The first five are the thresholds fixed by the statement of the problem.
FUNCTIONS = {
    "wordless": ("n_words = 0", ("noise",)),
    "marked": ("n_letters + n_marks >= 20 AND n_marks * 5 > n_letters + n_marks", ("table", "noise")),
    "long_worded": ("n_words > 0 AND n_letters > 9 * n_words", ("noise", "terms")),
    "uncommon": ("n_words >= 8 AND n_common * 5 < n_words", ("bullets", "table", "noise", "terms")),
    "unended": ("n_lines >= 5 AND n_ended_lines * 4 < n_lines", ("bullets", "lines", "table")),
    "separated": ("n_lines >= 3 AND n_separators >= 2 * n_lines", ("table",)),
    "digits": ("n_letters >= 20 AND digit_share > 0.3", ("table",)),
    "bulleted": ("n_lines >= 3 AND bulleted_share >= 0.5", ("bullets",)),
    "short_lined": ("n_lines >= 3 AND n_words > 0 AND n_words <= 6 * n_lines", ("bullets", "table")),
    "fluent": ("n_words >= 2 AND n_common * 10 >= 3 * n_words", ("prose", "casual", "lines")),
    "sentences": ("n_words >= 3 * n_lines AND n_lines > 0 AND n_ended_lines * 2 >= n_lines", ("prose",)),
}
NOT_PROSE = ("wordless", "marked", "long_worded", "uncommon", "unended")
_VOTES_FOR = np.array([[c in of for c in CLASSES] for _, of in FUNCTIONS.values()])
_IMPOSSIBLE = np.array([[name in NOT_PROSE and t == "prose" for t in CLASSES.values()] for name in FUNCTIONS])
_TYPE_OF = np.array([[t == u for u in TYPES] for t in CLASSES.values()], dtype=float)
#: what is believed before any document is seen: rates of votes inside and outside the classes voted for, worth so many documents of each class
_INSIDE, _OUTSIDE, _WORTH = 0.6, 0.05, 20.0
#: bounds of the model: functions are one-sided, so they vote seldom outside their classes; no class dies out
_MOST_OUTSIDE, _LEAST_SHARE = 0.15, 0.005


@dataclass(frozen=True)
class LabelModel:
    """rates (functions, classes): how often each function votes in documents of each class; shares of the classes; posterior (patterns, classes)."""

    rates: np.ndarray
    shares: np.ndarray
    posterior: np.ndarray


def _posterior(votes: np.ndarray, rates: np.ndarray, shares: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        yes, no = np.log(rates), np.log1p(-rates)
    score = np.log(shares) + np.where(votes[:, :, None], yes, no).sum(axis=1)
    possible = np.isfinite(score)
    out = np.exp(score - score.max(axis=1, keepdims=True, initial=-1e300))
    out = np.where(possible, np.maximum(out, 1e-12), 0.0)  # improbable isn't impossible
    return out / out.sum(axis=1, keepdims=True)


def learn(patterns: list[tuple[tuple[bool, ...], int]], votes_for: np.ndarray = _VOTES_FOR, impossible: np.ndarray = _IMPOSSIBLE, rounds: int = 200) -> LabelModel:
    """Expectation-maximization over patterns of votes and their numbers of documents.

    Functions are independent inside a class; both a vote and an abstention are evidence. ``votes_for`` (functions, classes) gives the beliefs to start from and the
    side on which a function may vote often, ``impossible`` the pairs whose rate is 0.
    """
    votes = np.array([p for p, _ in patterns], dtype=bool).reshape(len(patterns), len(votes_for))
    number = np.array([n for _, n in patterns], dtype=float)
    believed = np.where(votes_for, _INSIDE, _OUTSIDE)
    rates = np.where(impossible, 0.0, believed)
    shares = np.where(np.arange(votes_for.shape[1]) == 0, 0.7, 0.3 / (votes_for.shape[1] - 1))
    for _ in range(rounds):
        weight = _posterior(votes, rates, shares) * number[:, None]
        new = (votes.T.astype(float) @ weight + believed * _WORTH) / (weight.sum(axis=0) + _WORTH)
        new = np.where(impossible, 0.0, np.where(votes_for, new, np.minimum(new, _MOST_OUTSIDE)))
        shares = np.maximum((weight.sum(axis=0) + 1) / (number.sum() + len(shares)), _LEAST_SHARE)
        shares, moved, rates = shares / shares.sum(), np.abs(new - rates).max(), new
        if moved < 1e-6:
            break
    return LabelModel(rates, shares, _posterior(votes, rates, shares))


def text_types(documents: DataFrame, text: str, common: DataFrame, word: str = "word", rounds: int = 200) -> DataFrame:
    """The statistics of each text, whether each labelling function votes (``v_`` and its name; false: it abstains), the posterior of each type
    (``p_`` and its name) and ``text_type``, the likeliest (at a tie the first of prose, list, table, junk).

    ``p_prose`` is 0 exactly where a threshold of NOT_PROSE holds. Nulls, empty texts and extra columns: as in ``text_statistics``. An empty table gives no rows.
    """
    spark = documents.sparkSession
    names = [f"v_{name}" for name in FUNCTIONS]
    voted = text_statistics(documents, text, common, word)
    voted = voted.select("*", *(F.coalesce(F.expr(says), F.lit(False)).alias(v) for v, (says, _) in zip(names, FUNCTIONS.values())))
    voted = voted.withColumn("pattern", sum((F.col(v).cast("int") * 2**i for i, v in enumerate(names)), F.lit(0)))
    voted = cut_lineage(voted, "statistics")  # without the texts; they are read and counted once
    rows = voted.groupBy("pattern").count().collect()  # at most 2 ^ len(FUNCTIONS) rows
    model = learn([(tuple(bool(r["pattern"] >> i & 1) for i in range(len(names))), r["count"]) for r in rows], rounds=rounds)
    table = [(r["pattern"], *map(float, p), TYPES[int(np.argmax(p))]) for r, p in zip(rows, model.posterior @ _TYPE_OF)]
    schema = "pattern int, " + ", ".join(f"p_{t} double" for t in TYPES) + ", text_type string"
    return voted.join(F.broadcast(spark.createDataFrame(table, schema)), "pattern").drop("pattern")
