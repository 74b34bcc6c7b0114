"""Column functions on sequences, CIGAR strings and qualities. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: base pairing and two-bit codes
BASES, PAIRED, DIGITS = "ACGT", "TGCA", "0123"
#: fixed values: SAM flags
REVERSE, UNMAPPED, SECONDARY, SUPPLEMENTARY = 0x10, 0x4, 0x100, 0x800


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def upper(s: Column | str) -> Column:
    """upper case."""
    return F.upper(_c(s))


def split_tokens(s: Column | str, sep: str) -> Column:
    """split at a character; an empty last token is dropped (one only), as is the whole of an empty text."""
    parts = F.split(_c(s), f"[{sep}]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def is_ambiguous(s: Column | str) -> Column:
    """holds anything but A, C, G and T in either case."""
    return _c(s).rlike("[^ACGTacgt]")


def complement(s: Column | str) -> Column:
    """paired bases; other letters stay."""
    return F.translate(_c(s), BASES, PAIRED)


def is_at(base: Column | str) -> Column:
    """false for C and G, true for anything else."""
    return ~_c(base).isin("C", "G")


def reverse_complement(s: Column | str) -> Column:
    """Reverse complement; other letters stay where their mirror is."""
    return F.reverse(complement(s))


def encode_2bit(s: Column | str) -> Column:
    """two bits a base as one LONG, first base highest; anything but C, G and T counts as A. Up to 31 bases, else null."""
    clean = F.regexp_replace(_c(s), "[^ACGT]", "A")
    return F.when(F.length(clean) == 0, F.lit(0).cast("long")).when(F.length(clean) <= 31, F.conv(F.translate(clean, BASES, DIGITS), 4, 10).cast("long"))


def decode_2bit(code: Column | str, length: Column | int) -> Column:
    """the inverse of encode_2bit for a given length."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.when(n > 0, F.translate(F.lpad(F.conv(_c(code).cast("string"), 10, 4), n, "0"), DIGITS, BASES)).when(n == 0, "")


def encode_planes(s: Column | str) -> Column:
    """the high and the low bits of the two-bit codes, each as a text of 0 and 1."""
    clean = F.regexp_replace(_c(s), "[^ACGT]", "A")
    return F.struct(F.translate(clean, BASES, "0011").alias("hi"), F.translate(clean, BASES, "0101").alias("lo"))


def decode_planes(planes: Column) -> Column:
    """the inverse of encode_planes."""
    return F.array_join(F.zip_with(F.split(planes["hi"], ""), F.split(planes["lo"], ""), lambda h, l: F.when(h == "", "").otherwise(F.element_at(F.array(*map(F.lit, BASES)), (h.cast("int") * 2 + l.cast("int") + 1)))), "")


def three_letter(s: Column | str) -> Column:
    """C to T conversion."""
    return F.translate(_c(s), "C", "T")


def n_kmers(s: Column | str, k: int) -> Column:
    """number of k-mers."""
    return F.greatest(F.length(_c(s)) - (k - 1), F.lit(0))


def kmers(s: Column | str, k: int) -> Column:
    """the k-mers in order; empty if the text is shorter than k."""
    s = _c(s)
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column | str) -> Column:
    """the lesser of a k-mer and its reverse complement; texts order like two-bit codes."""
    return F.least(_c(kmer), reverse_complement(kmer))


def canonical_kmers(s: Column | str, k: int) -> Column:
    return F.transform(kmers(s, k), canonical)


def hamming_full(a: Column | str, b: Column | str) -> Column:
    """differing positions; what one text is longer counts too."""
    a, b = _c(a), _c(b)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.greatest(F.length(a), F.length(b))).otherwise(F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def mapq(score: Column | str, second: Column | str) -> Column:
    """mapping quality of the best and the second best score; 254 at most, and where there is no second; 0 without a score."""
    s1, s2 = _c(score).cast("double"), _c(second).cast("double")
    ratio = 1 - F.abs(s1 - s2) / s1
    value = F.floor(F.floor(-4.343 * F.log(ratio)) + 4.99)
    return F.when(s1 == 0, 0).when(ratio <= 0, 254).otherwise(F.least(F.lit(254), F.greatest(value, F.lit(0)))).cast("int")


def substitution(a: Column | str, b: Column | str, match: int = 2, mismatch: int = -2) -> Column:
    """score of two bases; N and other letters never match."""
    a, b = F.upper(_c(a)), F.upper(_c(b))
    return F.when((a == b) & a.isin(*BASES), match).otherwise(mismatch)


def parse_cigar(cigar: Column | str) -> Column:
    """array of (op, len); anything that isn't a number and an operation is skipped; * and null give no entries."""
    parts = F.regexp_extract_all(F.coalesce(_c(cigar), F.lit("")), F.lit(r"(\d+[MIDSHNPX=])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.left(p, F.length(p) - 1).cast("int").alias("len")))


def format_cigar(entries: Column | str) -> Column:
    """the text of array of (op, len)."""
    return F.array_join(F.transform(_c(entries), lambda e: F.concat(e["len"].cast("string"), e["op"])), "")


def run_lengths(path: Column | str) -> Column:
    """run-length encoding of a text of operations, one letter each, as a CIGAR string."""
    runs = F.regexp_extract_all(_c(path), F.lit(r"((.)\2*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.left(r, F.lit(1)))), "")


def cigar_span(cigar: Column | str, ops: str) -> Column:
    """The total length of some operations of a CIGAR string."""
    return F.aggregate(F.filter(parse_cigar(cigar), lambda e: e["op"].isin(*ops)), F.lit(0), lambda s, e: s + e["len"])


def quality_bins(qual: Column | str, bits: int) -> Column:
    """qualities in 1 bit (boundary 13), 2 bits (4, 13, 20) or 8 bits, each bin shown by its letter."""
    bounds = {1: [(13, "(")], 2: [(4, "$"), (13, "("), (20, "1")], 8: []}[bits]  # fixed values
    last = {1: "5", 2: "9", 8: None}[bits]
    if last is None:
        return _c(qual)
    out, lo = _c(qual), 33
    for top, letter in bounds:  # ascending ranges of characters, each to a private mark first, so that no range meets a letter already put
        out = F.regexp_replace(out, f"[\\x{lo:02x}-\\x{top + 33:02x}]", chr(ord(letter) + 0x400))
        lo = top + 34
    out = F.regexp_replace(out, f"[\\x{lo:02x}-\\x7e]", chr(ord(last) + 0x400))
    letters = "".join(letter for _, letter in bounds) + last
    return F.translate(out, "".join(chr(ord(x) + 0x400) for x in letters), letters)


def memory_bytes(text: Column | str) -> Column:
    """a size such as 4G, 512M or 100K in bytes; other texts give null."""
    number, unit = F.regexp_extract(_c(text), r"^(\d+)([KMG]?)$", 1), F.regexp_extract(_c(text), r"^(\d+)([KMG]?)$", 2)
    power = F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).otherwise(1)
    return F.when(number != "", number.cast("long") * power)


def window_ids(pos: Column | str, length: Column | str, chrom_len: Column | str, w: int, k: int) -> Column:
    """ids of the windows that a stretch of a chromosome meets; none if it lies outside."""
    stride, pos = w - k + 1, _c(pos)
    last = F.least(pos + _c(length), _c(chrom_len)) - 1
    return F.when((last >= pos) & (pos >= 0), F.sequence(F.floor(pos / stride).cast("int"), F.floor(last / stride).cast("int"))).otherwise(F.array().cast("array<int>"))


def window_with_overlap(pos: Column | str, length: Column | str, chrom_len: Column | str, w: int, k: int, overlap: int) -> Column:
    """the first window whose part up to the next one shares ``overlap`` bases with the stretch; null if none does."""
    stride, pos = w - k + 1, _c(pos)
    end = F.least(pos + _c(length), _c(chrom_len))
    good = F.filter(window_ids(pos, length, chrom_len, w, k), lambda i: F.least((i + 1) * stride, end) - F.greatest(i * stride, pos) >= overlap)
    return F.get(good, F.lit(0))


def extend_window(pos: Column | str, w: int, extension: Column | int, chrom_len: Column | str) -> Column:
    """Struct (left, right, start, len) of a window widened on both sides. The left side is widened only if all of it fits."""
    pos, end = _c(pos), _c(chrom_len)
    ext = F.lit(extension) if isinstance(extension, int) else extension
    left = F.when(ext < pos, ext).otherwise(0)
    inside = pos + w <= end
    right = F.when(~inside, 0).when(pos + w + ext < end, ext).otherwise(end - (pos + w))
    length = w + left + right - F.when(inside, 0).otherwise(pos + w - end)
    return F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"), (pos - left).cast("int").alias("start"), length.cast("int").alias("len"))


def clip_section(begin: Column | str, end: Column | str, chrom_len: Column | str) -> Column:
    """Struct (begin, end) of a stretch clipped to its chromosome."""
    b = F.greatest(F.lit(0), F.least(_c(begin), _c(chrom_len)))
    return F.struct(b.cast("int").alias("begin"), F.greatest(b, F.least(_c(end), _c(chrom_len))).cast("int").alias("end"))


def clean_reads(reads, k_batch: int = 65_536):
    """upper case, and each invalid base of a file replaced by A, C, G, T in turn; the turn starts anew every ``k_batch`` reads.

    reads: file_id, read_id_in_file, seq and others. Adds ``clean`` and ``ambiguous``. A read counts the invalid bases before it in its batch by a window
    over small numbers, not texts.
    """
    from pyspark.sql import Window

    batch = Window.partitionBy("file_id", F.expr(f"read_id_in_file div {k_batch}")).orderBy("read_id_in_file").rowsBetween(Window.unboundedPreceding, -1)
    up = reads.withColumn("_u", F.upper("seq"))
    # a read of bases only counts nothing and stays where it is
    plain = F.coalesce(~F.col("_u").rlike("[^ACGT]"), F.lit(False))
    odd = up.filter(~plain).withColumn("_bad", F.length(F.regexp_replace("_u", "[ACGT]", ""))).withColumn("_before", F.coalesce(F.sum("_bad").over(batch), F.lit(0)))
    up = up.filter(plain).withColumn("_bad", F.lit(0)).withColumn("_before", F.lit(0).cast("long")).unionByName(odd)
    # stretches of bases between invalid ones, put together again with the letter that is due
    parts = F.split("_u", "[^ACGT]", -1)
    turned = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.substring(F.lit(BASES), ((F.col("_before") + i - 1) % 4 + 1).cast("int"), F.lit(1)), p)))
    return up.withColumn("clean", F.when(F.col("_bad") == 0, F.col("_u")).otherwise(F.array_join(turned, ""))).withColumn("ambiguous", F.col("_bad") > 0).drop("_u", "_bad", "_before")
