"""Splitting oversized sequences at natural boundaries (problem 1).

One bounded-quantifier regular expression cuts a sequence into consecutive chunks. Its alternatives stand in order of
boundary strength: up to the limit and ending where the sequence ends or where a gap makes the cut harmless; up to the
limit and ending after a single gap character in the further half; and, as a fallback, exactly the limit. Each piece is
its chunk with the ``overlap`` characters before it (the lookback). Only SQL functions are used, nothing leaves the JVM.

A cut is harmless where a gap (a run of at least ``min_gap`` characters of N, n or -) begins right after it, or has ended
within the lookback: the stretch on either side then stands whole in one piece. So, as long as the limit is at least overlap
plus min_gap, a record is free of forced cuts exactly if none of its stretches between gaps is longer than the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = "[Nn-]"


def _harmless(overlap: str = "_overlap", gap: str = "_gap") -> str:
    """SQL for the pattern of a position where a cut divides no stretch."""
    return f"'(?:(?<={GAP}{{', {gap}, '}}[\\\\s\\\\S]{{0,', {overlap}, '}})|(?={GAP}{{', {gap}, '}}))'"


def _chunk_pattern() -> Column:
    """First chunk up to the limit, the others up to the limit less the lookback."""
    any_ = "[\\\\s\\\\S]"
    whole, cut = "'\\\\z'", _harmless()

    def alternatives(anchor: str, least: str, most: str) -> str:
        half = f"greatest({least}, int({most} / 2))"
        # looking for gaps at every place is dear, and vain in a text that has none
        return ", ".join([
            f"'{anchor}{any_}{{', {least}, ',', {most}, '}}(?:', {whole}, IF(_seq RLIKE concat('{GAP}{{', _gap, '}}'), concat('|', {cut}), ''), ')'",
            f"'|{anchor}{any_}{{', {half}, ',', {most}, '}}(?<={GAP})'",
            f"'|{anchor}{any_}{{', {most}, '}}'",
        ])

    first, later = alternatives("\\\\A", "(_overlap + 1)", "_limit"), alternatives("(?!\\\\A)", "1", "(_limit - _overlap)")
    return F.expr(f"concat({first}, '|', {later})")


def split_pieces(records: DataFrame, seq: str, limit: str | int, overlap: str | int, min_gap: str | int) -> DataFrame:
    """The pieces of each record: all its other columns as ``record`` (a struct), ``piece_no`` from 0, ``n_pieces``, ``piece_start``
    (characters from 0), ``piece`` and ``cut``, the kind of cut after the piece: natural, forced or end.

    ``limit``, ``overlap`` and ``min_gap`` are numbers or names of columns. Pieces are at most ``limit`` characters long and consecutive ones share
    exactly ``overlap`` characters. A record not over the limit is one piece, an empty text one empty piece; a null
    text or a null limit gives one null piece. Overlap counts as at least 0 and at most limit - 1, min_gap as at least 1.
    Rows are kept as they are, repeated ones too.
    """
    number = lambda x: F.lit(x) if isinstance(x, int) else F.col(f"`{x}`")
    others = [F.col(f"`{c}`") for c in records.columns if c != seq]
    base = records.select(F.struct(*others).alias("record"), F.col(f"`{seq}`").alias("_seq"), number(limit).alias("_limit"), number(overlap).alias("_overlap"), number(min_gap).alias("_gap"))
    base = base.withColumn("_limit", F.when(F.col("_limit") >= 1, F.col("_limit"))).withColumn("_gap", F.greatest(F.coalesce("_gap", F.lit(1)), F.lit(1)))
    base = base.withColumn("_overlap", F.least(F.greatest(F.coalesce("_overlap", F.lit(0)), F.lit(0)), F.col("_limit") - 1))
    chunks = F.when(F.length("_seq") > F.col("_limit"), F.regexp_extract_all("_seq", _chunk_pattern(), F.lit(0))).when(F.col("_seq").isNotNull() & F.col("_limit").isNotNull(), F.array("_seq")).otherwise(F.array(F.lit(None).cast("string")))
    cutup = base.withColumn("_chunks", chunks).withColumn("_lengths", F.transform("_chunks", F.length))
    # the characters before and after a cut: nearly always one chunk holds them, else so many chunks that they surely do
    seen = "_overlap + _gap"
    before = f"CASE WHEN i = 0 THEN '' WHEN _lengths[i - 1] >= {seen} THEN right(_chunks[i - 1], {seen}) ELSE right(array_join(slice(_chunks, greatest(1, i - ({seen}) + 1), least(i, {seen})), ''), {seen}) END"
    after = "CASE WHEN i + 1 >= size(_chunks) THEN '' WHEN _lengths[i + 1] >= _gap THEN left(_chunks[i + 1], _gap) ELSE left(array_join(slice(_chunks, i + 2, _gap), ''), _gap) END"
    framed = f"transform(_chunks, (c, i) -> named_struct('c', c, 'before', {before}, 'after', {after}, 'last', i + 1 = size(_chunks)))"
    run = f"concat('{GAP}{{', _gap, '}}')"
    cut = f"CASE WHEN p.last THEN 'end' WHEN right(concat(p.before, p.c), {seen}) RLIKE {run} OR p.after RLIKE {run} THEN 'natural' ELSE 'forced' END"
    pieces = F.expr(f"transform({framed}, p -> named_struct('piece', concat(IF(_overlap > 0, right(p.before, _overlap), ''), p.c), 'cut', {cut}))")
    # running sums over blocks of 256 chunks, so that their work doesn't grow as the square of the chunks
    total = lambda x: f"aggregate({x}, 0L, (a, y) -> a + y)"
    sums = f"transform(sequence(0, (size(_lengths) - 1) div 256), b -> {total('slice(_lengths, 256 * b + 1, 256)')})"
    before = f"transform(array({sums}), s -> transform(s, (x, b) -> {total('slice(s, 1, b)')}))[0]"
    # an array of one struct, so that what the lambda below uses is made once and not for each chunk
    offsets = F.expr(f"""transform(array(named_struct('l', _lengths, 'before', {before})),
        z -> transform(z.l, (n, i) -> greatest(0L, z.before[i div 256] + {total('slice(z.l, 256 * (i div 256) + 1, i % 256)')} - _overlap)))[0]""")
    placed = cutup.select("record", F.size("_chunks").alias("n_pieces"), offsets.alias("_at"), pieces.alias("_pieces"))
    return placed.select("record", "n_pieces", F.posexplode(F.arrays_zip("_at", "_pieces")).alias("piece_no", "_p")).select("record", "piece_no", "n_pieces", F.col("_p._at").alias("piece_start"), F.col("_p._pieces.piece").alias("piece"), F.col("_p._pieces.cut").alias("cut"))


def genome_pieces(genome: DataFrame, options: DataFrame) -> DataFrame:
    """Pieces of genome records under their profile's options: limit window_size, overlap kmerlength - 1.

    Rows repeated whole count once. A record whose profile has no options comes out as one null piece. Columns beside
    chrom_id, name, seq, len and profile_id are carried along in ``record`` as they are.
    """
    of = options.groupBy(F.col("profile_id").alias("_profile")).agg(F.max("window_size").alias("_window"), (F.max("kmerlength") - 1).alias("_k1"), F.max("min_gap").alias("_min_gap"))
    joined = genome.dropDuplicates().join(of, F.col("profile_id") == F.col("_profile"), "left")
    return split_pieces(joined, "seq", "_window", "_k1", "_min_gap")
