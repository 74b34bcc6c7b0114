"""Local alignment with affine gaps (L1 - L7), edit distance (L8 - L12) and C to T alignment.

Pairs are aligned in Arrow batches: one numpy step for each row of the score matrix, over all pairs of a block and all columns at once. Gaps along
the reference are a running maximum, so no step looks at single cells.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import mapq, parse_cigar, reverse_complement, three_letter
from ..shared import spread

LOW = -(1 << 20)
BLOCK = 256

LOCAL_SCHEMA = "score int, score2 int, ref_begin int, ref_end int, query_begin int, query_end int, ref_end2 int, mismatches int, cigar string, flag int"
EDIT_SCHEMA = "edit_distance int, locations array<struct<start: int, end: int>>, cigar string, path string, alphabet_length int"


def dna_scores(match: int = 2, mismatch: int = 2) -> tuple[str, np.ndarray]:
    """Letters and scores; letters that aren't listed never match."""
    return "ACGT", np.where(np.eye(4, dtype=bool), match, -mismatch)


def read_scores(text: str) -> tuple[str, np.ndarray]:
    """A substitution matrix in the usual text form (# comments, a row of letters, then a letter and its scores)."""
    rows = [line.split() for line in text.splitlines() if line.strip() and not line.startswith("#")]
    letters = "".join(rows[0])
    return letters, np.array([[int(x) for x in r[1 : len(letters) + 1]] for r in rows[1:]], dtype=np.int64)


def _coded(texts: list[str], letters: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters, len(letters) for others, len(letters) + 1 beyond the end; and lengths."""
    table = np.full(256, len(letters), dtype=np.int32)
    for i, c in enumerate(letters):
        table[ord(c.lower())] = table[ord(c)] = i
    length = np.array([len(t) for t in texts])
    out = np.full((len(texts), int(length.max(initial=0))), len(letters) + 1, dtype=np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = table[np.frombuffer(t.encode("latin-1", "replace"), dtype=np.uint8)]
    return out, length


def _table(scores: np.ndarray) -> np.ndarray:
    """Scores with a row and column for unknown letters, and one that forbids what lies beyond an end."""
    n = len(scores)
    out = np.full((n + 2, n + 2), LOW, dtype=np.int64)
    out[: n + 1, : n + 1] = min(int(scores.min()), -1)
    out[:n, :n] = scores
    return out


def _kind(table: np.ndarray, open_: int, extend: int, n: int, m: int) -> type:
    """The narrowest type that holds every score of pairs of these lengths."""
    inside = np.abs(table[table > LOW])
    return np.int16 if int(inside.max(initial=1)) * min(n, m) + open_ + extend * (n + m) < -_LOW[np.int16] else np.int32


#: less than any score, and far enough from the type's end to be added to
_LOW = {np.int16: -15_000, np.int32: LOW}


def _scores_of(table: np.ndarray, kind: type):
    """The scores of one query position of all pairs against all reference columns; a comparison instead of a lookup where only equality counts."""
    n = len(table) - 2
    match, other = int(table[0, 0]), int(table[0, 1]) if n > 1 else 0
    if n > 1 and (table[:n, :n] == np.where(np.eye(n, dtype=bool), match, other)).all() and table[n, n] == other:
        # letters that never match get codes that differ; rows beyond a query's end are forbidden, else they would lose less than a gap and raise other columns
        return lambda q, r: (r == np.where(q < n, q, q.dtype.type(-1))) * kind(match - other) + np.where(q > n, kind(_LOW[kind]), kind(other))
    narrow = np.maximum(table, _LOW[kind]).astype(kind)
    return lambda q, r: narrow[q, r]


def _running(x: np.ndarray, better: np.ufunc) -> np.ndarray:
    """Running maximum or minimum down the columns, in steps that double."""
    step, y = 1, np.empty_like(x)
    while step < len(x):
        y[:step] = x[:step]
        better(x[step:], x[:-step], out=y[step:])
        x, y, step = y, x, 2 * step
    return x


def _rows(q: np.ndarray, r: np.ndarray, table: np.ndarray, open_: int, extend: int, local: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row by row: H, gaps along the query (F) and along the reference (E), each (columns + 1, pairs): what lies side by side in memory is alike work."""
    pairs, m = r.shape
    kind = _kind(table, open_, extend, q.shape[1], m)
    score, low = _scores_of(table, kind), _LOW[kind]
    q, r = (np.ascontiguousarray(x.T.astype(np.int8) if len(table) < 120 else x.T) for x in (q, r))
    column = np.arange(m + 1, dtype=kind)[:, None]
    slope, back = column * kind(extend), kind(open_) + (column[1:] - kind(1)) * kind(extend)
    h = np.zeros((m + 1, pairs), dtype=kind)
    if not local:
        h[1:] = -back
    f = np.full_like(h, low)
    for i in range(len(q)):
        f = np.maximum(h - kind(open_), f - kind(extend))
        now = np.empty_like(h)
        np.add(h[:-1], score(q[i], r), out=now[1:])
        now[0] = 0 if local else -open_ - extend * i
        f[0] = low
        np.maximum(now, f, out=now)
        if local:
            np.maximum(now, 0, out=now)
        e = np.empty_like(h)
        e[0] = low
        np.subtract(_running(now + slope, np.maximum)[:-1], back, out=e[1:])
        h = np.maximum(now, e)
        yield h, f, e


def _best(q: np.ndarray, r: np.ndarray, table: np.ndarray, open_: int, extend: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best local score, its first reference end with its least query end, and the best score of each column."""
    pairs, m = r.shape
    top, rows = np.zeros((m + 1, pairs), dtype=_kind(table, open_, extend, q.shape[1], m)), []
    for h, _, _ in _rows(q, r, table, open_, extend, True):
        np.maximum(top, h, out=top)
        rows.append(h)
    score = top.max(axis=0).astype(np.int64)
    end, p = top.argmax(axis=0), np.arange(pairs)
    first = (np.stack([h[end, p] for h in rows]) == score).argmax(axis=0) if rows else np.zeros(pairs, np.int64)
    return score, end - 1, np.where(score > 0, first, 0), top[1:].T


def _ungapped(q_back: np.ndarray, r_back: np.ndarray, score: np.ndarray, table: np.ndarray, open_: int) -> np.ndarray:
    """How long the alignment of ``score`` is that ends at the first letters of both (reversed) texts, if it has no gap and none with a gap is as short; else 0.

    One with a gap that is no longer on the reference, or on the query, has at most all letters but one matched, less a gap.
    """
    width = min(q_back.shape[1], r_back.shape[1])
    total = np.cumsum(table[q_back[:, :width], r_back[:, :width]], axis=1)
    reached = total == score[:, None]
    length = reached.argmax(axis=1) + 1 if width else np.zeros(len(score), np.int64)
    return np.where((score > 0) & reached.any(axis=1) & (score > max(0, int(table[:-2, :-2].max(initial=0))) * (length - 1) - open_), length, 0)


def _window(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, fill: int, back: bool = False) -> np.ndarray:
    """Each row from begin to end (inclusive), optionally reversed, padded."""
    width = int((end - begin + 1).max(initial=0))
    at = (end[:, None] - np.arange(width)) if back else (begin[:, None] + np.arange(width))
    inside = np.arange(width) < (end - begin + 1)[:, None]
    return np.where(inside, np.take_along_axis(codes, np.clip(at, 0, max(codes.shape[1] - 1, 0)), axis=1), fill) if codes.shape[1] else np.full((len(codes), 0), fill)


def _paths(q: np.ndarray, r: np.ndarray, n: np.ndarray, m: np.ndarray, table: np.ndarray, open_: int, extend: int) -> list[str]:
    """Operations (M, I, D) of the best whole alignment of each pair, all pairs traced back in step."""
    kept = [(x, y.copy(), z) for x, y, z in _rows(q, r, table, open_, extend, False)]
    pairs = len(q)
    kind = _kind(table, open_, extend, q.shape[1], r.shape[1])
    first = np.zeros((1, r.shape[1] + 1, pairs), kind)
    first[0, 1:] = (-open_ - extend * np.arange(r.shape[1]))[:, None]
    low = np.full_like(first, _LOW[kind])
    h, f, e = (np.concatenate([z, np.stack([row[x] for row in kept])]) if kept else z for x, z in ((0, first), (1, low), (2, low)))
    e[0] = first[0]
    i, j, p, state = n.copy(), m.copy(), np.arange(pairs), np.zeros(pairs, dtype=np.int64)
    steps = []
    while True:
        active = (i > 0) | (j > 0)
        if not active.any():
            break
        hij = h[i, j, p]
        s = table[q[p, np.maximum(i - 1, 0)], r[p, np.maximum(j - 1, 0)]]
        diagonal = (i > 0) & (j > 0) & (state == 0) & (h[np.maximum(i - 1, 0), np.maximum(j - 1, 0), p] + s == hij)
        fv, ev = np.where(i > 0, f[i, j, p], _LOW[kind]), np.where(j > 0, e[i, j, p], _LOW[kind])
        ev = np.where(i == 0, hij, ev)
        fv = np.where((j == 0) & (i > 0), hij, fv)
        insert = active & ~diagonal & np.where(state == 0, (fv == hij) & ((ev != hij) | (fv > ev)), state == 1)
        insert &= i > 0
        delete = active & ~diagonal & ~insert
        steps.append(np.where(~active, 0, np.where(diagonal, ord("M"), np.where(insert, ord("I"), ord("D")))).astype(np.uint8))
        up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        f_now, e_now = np.where(insert, np.where(j == 0, h[i, j, p], f[i, j, p]), 0), np.where(delete, np.where(i == 0, h[i, j, p], e[i, j, p]), 0)
        opened = np.where(insert, f_now == h[up, j, p] - open_, e_now == h[i, left, p] - open_)
        state = np.where(diagonal | opened, 0, np.where(insert, 1, 2))
        i, j = np.where(diagonal | insert, up, i), np.where(diagonal | delete, left, j)
    lines = np.stack(steps, axis=1)[:, ::-1] if steps else np.zeros((pairs, 0), np.uint8)
    return [bytes(x[x > 0]).decode() for x in lines]


def _runs(path: str) -> str:
    """A path's runs of equal operations, as in a CIGAR."""
    ops = np.frombuffer(path.encode("ascii"), dtype=np.uint8)
    ends = np.append(np.flatnonzero(ops[1:] != ops[:-1]), len(ops) - 1) if len(ops) else np.zeros(0, np.int64)
    return "".join(f"{n}{path[e]}" for n, e in zip(np.diff(ends, prepend=-1).tolist(), ends.tolist()))


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _marked(path: str, query: str, ref: str) -> tuple[str, int]:
    """M as = or X; the number of mismatches, with the lengths of gaps."""
    ops = np.frombuffer(path.encode("ascii"), dtype=np.uint8).copy()
    both = ops == ord("M")
    q, r = np.cumsum(ops != ord("D")) - 1, np.cumsum(ops != ord("I")) - 1
    ops[both] = np.where(_letters(query)[q[both]] == _letters(ref)[r[both]], ord("="), ord("X"))
    return ops.tobytes().decode("ascii"), int((ops != ord("=")).sum())


def _local_block(queries: list[str], refs: list[str], letters: str, table: np.ndarray, open_: int, extend: int, mask: int | None, score_filter: int, distance_filter: int) -> list[tuple]:
    (q, n), (r, m) = _coded(queries, letters), _coded(refs, letters)
    fill = len(letters) + 1
    score, r_end, q_end, top = _best(q, r, table, open_, extend)
    away = np.maximum(n // 2, 15) if mask is None else np.full(len(n), mask)
    column = np.arange(r.shape[1])
    far = np.where((np.abs(column - r_end[:, None]) > away[:, None]) & (column < m[:, None]), top, 0)
    score2 = far.max(axis=1, initial=0)
    end2 = np.where(score2 > 0, far.argmax(axis=1) if far.shape[1] else 0, -1)
    hit = score > 0
    zero = np.zeros(len(n), dtype=np.int64)
    q_back, r_back = _window(q, zero, np.where(hit, q_end, -1), fill, True), _window(r, zero, np.where(hit, r_end, -1), fill, True)
    plain = _ungapped(q_back, r_back, score, table, open_)
    r_far, q_far, paths = plain - 1, plain - 1, ["M" * x for x in plain.tolist()]
    some = np.flatnonzero(hit & (plain == 0))
    if len(some):
        _, r_far[some], q_far[some], _ = _best(q_back[some], r_back[some], table, open_, extend)
    r_begin, q_begin = np.where(hit, r_end - r_far, 0), np.where(hit, q_end - q_far, 0)
    if len(some):
        x, y, u, v = q_begin[some], q_end[some], r_begin[some], r_end[some]
        for i, path in zip(some.tolist(), _paths(_window(q[some], x, y, fill), _window(r[some], u, v, fill), y - x + 1, v - u + 1, table, open_, extend)):
            paths[i] = path
    out = []
    for i, path in enumerate(paths):
        if not hit[i]:
            out.append((0, 0, -1, -1, -1, -1, -1, 0, "", 1))
            continue
        path, wrong = _marked(path, queries[i][q_begin[i] :], refs[i][r_begin[i] :])
        path = "S" * int(q_begin[i]) + path + "S" * int(n[i] - 1 - q_end[i])
        shown = score[i] >= score_filter and r_end[i] - r_begin[i] < distance_filter
        out.append((int(score[i]), int(score2[i]), int(r_begin[i]), int(r_end[i]), int(q_begin[i]), int(q_end[i]), int(end2[i]), int(wrong), _runs(path) if shown else "", 0))
    return out


def _in_blocks(align: Callable[[list[str], list[str]], list[tuple]], a: pd.Series, b: pd.Series, names: list[str], cells: int = 4_000_000) -> pd.DataFrame:
    """Pairs as from ``_blocks``; a pair with a null text gets nulls."""
    out = _blocks(align, a.tolist(), b.tolist(), cells)
    return pd.DataFrame([x if x is not None else (None,) * len(names) for x in out], columns=names).astype(object)


def _blocks(align: Callable[[list[str], list[str]], list[tuple]], a: list, b: list, cells: int = 4_000_000) -> list:
    """Pairs in blocks of like size, so that padding and memory stay small; None for a pair with a null text."""
    out: list = [None] * len(a)
    order = sorted((i for i in range(len(a)) if a[i] is not None and b[i] is not None), key=lambda i: (len(a[i]), len(b[i])))
    at = 0
    while at < len(order):
        size = max(1, min(BLOCK, cells // max(1, (len(a[order[at]]) + 1) * (len(b[order[at]]) + 1))))
        part = order[at : at + size]
        for i, x in zip(part, align([a[i] for i in part], [b[i] for i in part])):
            out[i] = x
        at += size
    return out


def _least_edits(queries: list[str], refs: list[str], letters: str, chunk: int = 4096) -> np.ndarray:
    """The least edit distance of each query to any part of its reference, a bit for each letter of the query (Myers); letters that aren't listed match none."""
    out = np.zeros(len(queries), dtype=np.int64)
    order = np.array(sorted(range(len(queries)), key=lambda i: (len(queries[i]), len(refs[i]))), dtype=np.int64)
    for low in range(0, len(order), chunk):
        some = order[low : low + chunk]
        (q, n), (r, _) = _coded([queries[i] for i in some], letters), _coded([refs[i] for i in some], letters)
        words = max(1, -(-q.shape[1] // 64))
        equal = np.zeros((len(letters) + 2, words, len(some)), dtype=np.uint64)
        for code in range(len(letters)):
            bits = np.zeros((len(some), 8 * words), dtype=np.uint8)
            packed = np.packbits(q == code, axis=1, bitorder="little")
            bits[:, : packed.shape[1]] = packed
            equal[code] = bits.view("<u8").T
        p, last = np.arange(len(some)), np.zeros((words, len(some)), dtype=np.uint64)
        last[np.maximum(n - 1, 0) // 64, p] = np.where(n > 0, np.uint64(1) << (np.maximum(n - 1, 0) % 64).astype(np.uint64), np.uint64(0))
        plus, minus = np.full((words, len(some)), ~np.uint64(0)), np.zeros((words, len(some)), dtype=np.uint64)
        now, best, one, high = n.copy(), n.copy(), np.uint64(1), np.uint64(63)
        for codes in np.ascontiguousarray(r.T):
            carry = up = down = np.uint64(0)
            change = np.zeros(len(some), dtype=np.int64)
            for w in range(words):
                eq, pv, mv = equal[codes, w, p], plus[w], minus[w]
                xv, both = eq | mv, eq & pv
                total = both + pv
                over = total < pv
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
                xh = (total ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                change += ((ph & last[w]) != 0).astype(np.int64) - ((mh & last[w]) != 0)
                next_up, next_down = ph >> high, mh >> high
                ph, mh = ph << one | up, mh << one | down
                up, down = next_up, next_down
                plus[w], minus[w] = mh | ~(xv | ph), ph & xv
            now += change
            np.minimum(best, now, out=best)
        out[some] = best
    return out


def local_align_udf(
    match: int = 2, mismatch: int = 2, open_: int = 3, extend: int = 1, mask: int | None = None, score_filter: int = 0, distance_filter: int = 1 << 30, scores: tuple[str, np.ndarray] | None = None
):
    """L4: a local aligner with its settings, as a function of a query and a reference column."""
    letters, values = scores or dna_scores(match, mismatch)
    table, names = _table(values), [x.split()[0] for x in LOCAL_SCHEMA.split(", ")]

    @F.pandas_udf(LOCAL_SCHEMA)
    def align(queries: pd.Series, refs: pd.Series) -> pd.DataFrame:
        return _in_blocks(lambda x, y: _local_block(x, y, letters, table, open_, extend, mask, score_filter, distance_filter), queries, refs, names)

    return align


def local_align(query: Column | str, ref: Column | str, **settings) -> Column:
    """Struct of the best local alignment: score, score2 (best elsewhere), begins and ends (0-based, inclusive), mismatches, CIGAR with S, =, X, I, D.

    A gap's first base costs ``open_``, each further one ``extend``. Ties: first reference end, then least query end, then nearest begins. score2 is the best of the
    columns more than ``mask`` (default: half the query, at least 15) from the end. A score of 0 has begins and ends -1, no CIGAR and flag 1; there is no flag 2, as paths are never cut by a band. The CIGAR is given from
    ``score_filter`` on and for reference spans up to ``distance_filter``. scores: other letters and their matrix.
    """
    return local_align_udf(**settings)(query, ref)


def better_strand(df: DataFrame, query: str, ref: str, **options) -> DataFrame:
    """Adds ``alignment`` and ``strand``: the reverse complement only if it scores strictly more."""
    both = spread(df).withColumn("_f", local_align(query, ref, **options)).withColumn("_rq", reverse_complement(query)).withColumn("_r", local_align("_rq", ref, **options))
    return both.withColumn("strand", F.when(F.col("_r.score") > F.col("_f.score"), "-").otherwise("+")).withColumn("alignment", F.when(F.col("strand") == "-", F.col("_r")).otherwise(F.col("_f"))).drop("_f", "_r", "_rq")


def _edit_block(queries: list[str], targets: list[str], mode: str, path: bool, k: int, equal: list[tuple[str, str]]) -> list[tuple]:
    def coded(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(t) for t in texts])
        out = np.full((len(texts), int(length.max(initial=0))), fill, dtype=np.int64)
        for i, t in enumerate(texts):
            out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
        return out, length

    def narrow(*codes: np.ndarray) -> list[np.ndarray]:
        return [c.astype(np.int8) for c in codes] if all(c.max(initial=0) < 128 for c in codes) else list(codes)

    def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = x != y
        for a, b in equal:
            out &= ~(((x == ord(a)) & (y == ord(b))) | ((x == ord(b)) & (y == ord(a))))
        return out

    def rows(q: np.ndarray, t: np.ndarray, free: bool) -> Iterator[np.ndarray]:
        kind = np.int16 if q.shape[1] + t.shape[1] < 15_000 else np.int32
        q, t = np.ascontiguousarray(q.T), np.ascontiguousarray(t.T)
        column = np.arange(len(t) + 1, dtype=kind)[:, None]
        d = np.zeros((len(column), t.shape[1]), dtype=kind) + (kind(0) if free else column)
        yield d
        for i in range(len(q)):
            now = d + kind(1)
            now[1:] = np.minimum(now[1:], d[:-1] + differ(q[i], t))
            d = _running(now - column, np.minimum) + column
            yield d

    (q, n), (t, m) = coded(queries, -1), coded(targets, -2)
    q, t = narrow(q, t)
    pairs, column = len(queries), np.arange(t.shape[1] + 1)

    def final(x: np.ndarray, length: np.ndarray, y: np.ndarray, free: bool) -> np.ndarray:
        """Each pair's row of distances after its whole query."""
        out = np.zeros((len(x), y.shape[1] + 1), dtype=np.int32)
        for i, d in enumerate(rows(x, y, free)):
            done = np.flatnonzero(length == i)
            out[done] = d[:, done].T
        return out

    last = np.where(column <= m[:, None], final(q, n, t, mode == "HW"), 1 << 30)
    if mode == "NW":
        last = np.where(column == m[:, None], last, 1 << 30)
    best = last.min(axis=1)
    kept = ((k < 0) | (best <= k)) & (n > 0)
    row, end = np.nonzero((last == best[:, None]) & kept[:, None])
    start = np.zeros(len(row), dtype=np.int64)
    if mode == "HW":  # where each starts: the reversed query against the reversed target, the farthest best end
        for at in range(0, len(row), BLOCK):
            x, e = row[at : at + BLOCK], end[at : at + BLOCK]
            zero = np.zeros(len(x), dtype=np.int64)
            back = final(_window(q[x], zero, n[x] - 1, -1, True), n[x], _window(t[x], zero, e - 1, -2, True), False)
            good = (back == best[x, None]) & (np.arange(back.shape[1]) <= e[:, None])
            start[at : at + BLOCK] = e - (back.shape[1] - 1 - good[:, ::-1].argmax(axis=1))
    first = np.searchsorted(row, np.arange(pairs))
    texts: list = [None] * pairs
    if path:
        some = np.flatnonzero(kept)
        s, e = start[first[some]], end[first[some]]
        for p, line in zip(some, _edit_paths(q[some], n[some], _window(t[some], s, e - 1, -2), e - s, rows)):
            texts[p] = line
    out = []
    for p in range(pairs):
        letters = len({*queries[p], *targets[p]})
        if 0 <= k < best[p]:
            out.append((-1, [], None, None, letters))
        elif n[p] == 0:
            text = ("D" * int(m[p]) if mode == "NW" else "") if path else None
            out.append((int(best[p]), [{"start": None, "end": int(m[p]) - 1 if mode == "NW" else -1}], None if text is None else _runs(text), text, letters))
        else:
            stop = first[p + 1] if p + 1 < pairs else len(row)
            where = [{"start": int(a), "end": int(b) - 1} for a, b in zip(start[first[p] : stop], end[first[p] : stop])]
            out.append((int(best[p]), where, None if texts[p] is None else _runs(texts[p]), texts[p], letters))
    return out


def _edit_paths(q: np.ndarray, n: np.ndarray, t: np.ndarray, m: np.ndarray, rows: Callable) -> list[str]:
    """Operations (=, X, I, D) of each pair; an insertion is preferred, then a deletion, seen from the end."""
    d = np.stack(list(rows(q, t, False)))
    i, j, p, steps = n.copy(), m.copy(), np.arange(len(n)), []
    while ((i > 0) | (j > 0)).any():
        here, up, left = d[i, j, p], np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        insert = (i > 0) & (d[up, j, p] + 1 == here)
        delete = ~insert & (j > 0) & (d[i, left, p] + 1 == here)
        both = ~insert & ~delete & (i > 0) & (j > 0)
        steps.append(np.where(insert, ord("I"), np.where(delete, ord("D"), np.where(both, np.where(d[up, left, p] == here, ord("="), ord("X")), 0))).astype(np.uint8))
        i, j = np.where(insert | both, up, i), np.where(delete | both, left, j)
    lines = np.stack(steps, axis=1)[:, ::-1] if steps else np.zeros((len(n), 0), np.uint8)
    return [bytes(x[x > 0]).decode() for x in lines]


def edit_align_udf(mode: str = "NW", path: bool = False, k: int = -1, equal: list[tuple[str, str]] | None = None):
    """An edit-distance aligner with its settings, as a function of a query and a target column."""
    names = ["edit_distance", "locations", "cigar", "path", "alphabet_length"]

    @F.pandas_udf(EDIT_SCHEMA)
    def align(queries: pd.Series, targets: pd.Series) -> pd.DataFrame:
        return _in_blocks(lambda x, y: _edit_block(x, y, mode, path, k, equal or []), queries, targets, names)

    return align


def edit_align(query: Column | str, target: Column | str, mode: str = "NW", path: bool = False, k: int = -1, equal: list[tuple[str, str]] | None = None) -> Column:
    """Struct of edit distance, all end locations with their starts (0-based, inclusive), CIGAR (=, X, I, D) and alphabet length.

    mode: NW whole against whole, SHW the target's end is free, HW both ends are free. k: -1 for no bound, else distances above it give -1 and no locations.
    equal: further pairs of letters that match. An empty query is 0 off at the target's start, or NW all deletions.
    """
    return edit_align_udf(mode, path, k, equal)(query, target)


def pretty(path: Column | str, query: Column | str, target: Column | str) -> Column:
    """struct of three lines: query, signs (| equal, . different, - gap), target, from a path of =, X, I and D."""
    path, query, target = (F.col(x) if isinstance(x, str) else x for x in (path, query, target))
    ops = F.split(path, "")
    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("t"), F.lit("").alias("a"), F.lit("").alias("s"), F.lit("").alias("b"))

    def step(x: Column, op: Column) -> Column:
        uses_q, uses_t = (op != "D") & (op != ""), (op != "I") & (op != "")
        return F.struct(
            (x["q"] + uses_q.cast("int")).alias("q"), (x["t"] + uses_t.cast("int")).alias("t"),
            F.concat(x["a"], F.when(uses_q, F.substring(query, x["q"] + 1, F.lit(1))).when(op == "", "").otherwise("-")).alias("a"),
            F.concat(x["s"], F.when(op == "=", "|").when(op == "X", ".").when(op == "", "").otherwise("-")).alias("s"),
            F.concat(x["b"], F.when(uses_t, F.substring(target, x["t"] + 1, F.lit(1))).when(op == "", "").otherwise("-")).alias("b"),
        )

    done = F.aggregate(ops, start, step)
    return F.struct(done["a"].alias("query"), done["s"].alias("signs"), done["b"].alias("target"))


def _walked(cigar: Column, ref_begin: Column, query: Column, ref: Column, span: int | None) -> Column:
    """Pairs (query base, reference base) of the aligned columns."""
    start = F.struct(F.lit(0).alias("q"), ref_begin.alias("r"), F.array().cast("array<struct<q: string, r: string>>").alias("pairs"))

    def step(x: Column, e: Column) -> Column:
        both, q_only, r_only = e["op"].isin("M", "=", "X"), e["op"].isin("I", "S"), e["op"].isin("D", "N")
        n = e["len"] if span is None else F.greatest(F.lit(0), F.least(e["len"], F.lit(span) - F.greatest(x["q"], x["r"] - ref_begin)))
        pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(query, x["q"] + i, F.lit(1)).alias("q"), F.substring(ref, x["r"] + i, F.lit(1)).alias("r")))
        return F.struct(
            (x["q"] + F.when(both | q_only, n).otherwise(0)).alias("q"), (x["r"] + F.when(both | r_only, n).otherwise(0)).alias("r"),
            F.when(both & (n > 0), F.concat(x["pairs"], pairs)).otherwise(x["pairs"]).alias("pairs"),
        )

    return F.aggregate(parse_cigar(cigar), start, step)["pairs"]


def aligned_pairs(alignment: Column, query: Column, ref: Column, span: int | None = None) -> Column:
    """The aligned columns of an alignment as array of (q, r), from the texts as they were before conversion."""
    return _walked(alignment["cigar"], alignment["ref_begin"], query, ref, span)


def rescored(alignment: Column, pairs: Column, match: int = 2, mismatch: int = 2) -> Column:
    """Struct (score, score2, conversions) after the original bases (``aligned_pairs``, as a column of its own) are looked at again.

    A query C on a reference T matched only after conversion: the match is taken back. A query T on a reference C is a conversion: it is counted and its match taken
    back as well. Scores don't go below 0.
    """
    count = lambda q, r: F.size(F.filter(pairs, lambda x: (x["q"] == q) & (x["r"] == r)))
    found = F.struct(count("T", "C").alias("conversions"), count("C", "T").alias("undone"))
    # one element, so that the counts are made once
    return F.transform(F.array(found), lambda n: _after(alignment, n, match, mismatch))[0]


def _count_conversions(cigar: str, begin: int, query: str, ref: str) -> tuple[int, int]:
    q, r, found, false = _letters(query), _letters(ref)[max(0, begin) :], 0, 0
    for n, op in _OPERATION.findall(cigar):
        n = int(n)
        if op in "M=X":
            a, b = q[:n], r[:n]
            a, b = a[: len(b)], b[: len(a)]
            found += int(((a == ord("T")) & (b == ord("C"))).sum())
            false += int(((a == ord("C")) & (b == ord("T"))).sum())
        q, r = q[n if op in "M=XIS" else 0 :], r[n if op in "M=XDN" else 0 :]
    return found, false


_OPERATION = re.compile(r"(\d+)([MIDNSHP=X])")


def conversions(alignment: Column, query: Column, ref: Column) -> Column:
    """Struct of the aligned columns of query T on reference C (conversions) and of C on T (undone), from the texts as they were before conversion; null for a null alignment."""

    @F.pandas_udf("conversions int, undone int")
    def count(cigar: pd.Series, begin: pd.Series, queries: pd.Series, refs: pd.Series) -> pd.DataFrame:
        rows = [_count_conversions(c, int(b), q, r) if c is not None and q is not None and r is not None else (None, None) for c, b, q, r in zip(cigar, begin, queries, refs)]
        return pd.DataFrame(rows, columns=["conversions", "undone"]).astype(object)

    return count(alignment["cigar"], alignment["ref_begin"], query, ref)


def _after(alignment: Column, found: Column, match: int, mismatch: int) -> Column:
    """Struct (score, score2, conversions): matches that only conversion made are taken back, scores don't go below 0."""
    return F.struct(*(F.greatest(F.lit(0), alignment[s] - (found["conversions"] + found["undone"]) * (match + mismatch)).alias(s) for s in ("score", "score2")), found["conversions"].alias("conversions"))


def bisulfite_align(pairs: DataFrame, query: str, ref: str, **options) -> DataFrame:
    """Adds ``alignment`` (of the three-letter texts), ``strand``, ``score``, ``score2``, ``conversions`` and ``mapq``.

    The query and its reverse complement, both C to T converted, are aligned with the converted reference, then rescored on the original bases; + unless - scores more.
    """
    rc, converted = reverse_complement(query), three_letter(F.upper(ref))
    both = spread(pairs).withColumn("_rc", rc).withColumn("_b", _bisulfite_udf(**options)(three_letter(query), three_letter("_rc"), converted, query, "_rc", F.upper(ref)))
    out = both.withColumn("alignment", F.struct(*(F.col(f"_b.{x.split()[0]}").alias(x.split()[0]) for x in LOCAL_SCHEMA.split(", "))))
    out = out.withColumn("strand", F.when(F.col("_b.minus"), "-").otherwise("+")).withColumn("score", F.coalesce("_b.after", F.lit(0))).withColumn("score2", F.coalesce("_b.after2", F.lit(0))).withColumn("conversions", F.col("_b.conversions"))
    return out.withColumn("mapq", mapq("score", "score2")).drop("_rc", "_b")


def _bisulfite_udf(match: int = 2, mismatch: int = 2, open_: int = 3, extend: int = 1, mask: int | None = None, score_filter: int = 0, distance_filter: int = 1 << 30, scores: tuple[str, np.ndarray] | None = None):
    """The better strand of converted texts, rescored on the texts before conversion.

    A strand is aligned only where it may be the better one: no local score is above that of a whole match less, for each edit that the query is away from any part of the
    reference, the least that one costs; and rescoring only takes away.
    """
    letters, values = scores or dna_scores(match, mismatch)
    table, names = _table(values), [x.split()[0] for x in LOCAL_SCHEMA.split(", ")] + ["minus", "after", "after2", "conversions"]
    reward = max(0, int(values.max()))
    cost = max(0, min(reward, reward + min(open_, extend), open_, extend, reward - int(table[:-1, :-1][~np.eye(len(table) - 1, dtype=bool)].max())))

    @F.pandas_udf(f"{LOCAL_SCHEMA}, minus boolean, after int, after2 int, conversions int")
    def align(plus: pd.Series, minus: pd.Series, ref: pd.Series, query: pd.Series, turned: pd.Series, whole: pd.Series) -> pd.DataFrame:
        texts, refs, originals, wholes = (plus.tolist(), minus.tolist()), ref.tolist(), (query.tolist(), turned.tolist()), whole.tolist()
        some = np.flatnonzero((plus.notna() & ref.notna()).to_numpy())
        most = np.zeros((2, len(refs)), dtype=np.int64)
        for strand in (0, 1):
            own = [texts[strand][i] for i in some]
            most[strand, some] = reward * np.array([len(x) for x in own], dtype=np.int64) - cost * _least_edits(own, [refs[i] for i in some], letters)
        found: list = [[None] * len(refs), [None] * len(refs)]

        def aligned(strand: int, rows: list[int]) -> None:
            lines = _blocks(lambda x, y: _local_block(x, y, letters, table, open_, extend, mask, score_filter, distance_filter), [texts[strand][i] for i in rows], [refs[i] for i in rows])
            for i, x in zip(rows, lines):
                converted, undone = _count_conversions(x[8], x[2], originals[strand][i], wholes[i])
                after, after2 = (max(0, y - (converted + undone) * 4) for y in x[:2])
                found[strand][i] = (*x, bool(strand), after, after2, converted)

        turn = most[1] > most[0]
        for strand in (0, 1):
            aligned(strand, some[turn[some] == bool(strand)].tolist())
        # + wins ties
        aligned(1, [i for i in some.tolist() if not turn[i] and most[1, i] > found[0][i][11]])
        aligned(0, [i for i in some.tolist() if turn[i] and most[0, i] >= found[1][i][11]])
        rows = []
        for x, y in zip(*found):
            rows.append(x if y is None else y if x is None or y[11] > x[11] else x)
        return pd.DataFrame([x if x is not None else (None,) * len(names) for x in rows], columns=names).astype(object)

    return align
