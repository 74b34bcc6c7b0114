import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.operators.raw_lines import parse_read_lines, tokenize_lines

FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'


def fields_of(line):
    """Plain reference: None if the line breaks the quoting rules."""
    if not re.fullmatch(f"{FIELD}(?:,{FIELD})*", line, re.S):
        return None
    out, at = [], 0
    while True:
        m = re.compile(FIELD, re.S).match(line, at)
        out.append(m[0][1:-1].replace('""', '"') if m[0][:1] == '"' else m[0])
        at = m.end()
        if at == len(line):
            return out
        at += 1


def reason_of(line):
    fields = None if line is None else fields_of(line)
    if line is not None and fields is None:
        return "quoting"
    if line is None or len(fields) != 5:
        return "columns"
    no, header, seq, qual, size = fields
    if not re.fullmatch("[0-9]+", no):
        return "record_no"
    if not re.fullmatch("[@>][^ ].*", header, re.S):
        return "header"
    if not re.fullmatch("[ACGTNacgtn]+", seq):
        return "seq"
    if (qual != "") if header[0] == ">" else (len(qual) != len(seq) or not re.fullmatch("[!-~]*", qual)):
        return "qual"
    return None if re.fullmatch("[0-9]{1,9}", size) and int(size) == len(seq) else "seq_len"


def random_lines(n, seed=7):
    rnd = random.Random(seed)
    lines = [None, "", '"', '""', '"a""b",c', "é,ü\n,ß", ",,,,", '1,@h,AC,II,2', '1,>h,AC,,2', '1,>h,AC,,002', '1,@h,AC,II,2\n', '1,"@h, ""x""",AC,"I,",2', "1,@ h,AC,II,2", '1,@h,AC,II,"2"', "9" * 50 + ",>h,AC,,2"]
    while len(lines) < n:
        lines.append("".join(rnd.choice('ab,"\né😀') for _ in range(rnd.randrange(40))))
    return lines


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_tokens_are_those_of_a_plain_parser(spark, chunk):
    lines = random_lines(600)
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    got = {r.rest.id: r for r in tokenize_lines(df, "line", chunk).collect()}
    assert len(got) == len(lines)
    for i, line in enumerate(lines):
        if line is None:
            assert got[i].fields is None
        elif (want := fields_of(line)) is None:
            assert got[i].broken_at >= 0
        else:
            assert got[i].broken_at == -1
            assert got[i].fields == want, line
            starts = [m for m in got[i].field_at]
            assert starts[0] == 0 and all(line[s - 1] == "," for s in starts[1:])


@pytest.mark.parametrize("chunk", [5, 4096])
def test_reasons(spark, chunk):
    rnd = random.Random(3)
    lines = random_lines(100)
    for _ in range(400):
        seq = "".join(rnd.choice("ACGTNacgtn" + "x" * rnd.randrange(2)) for _ in range(rnd.randrange(8)))
        head = rnd.choice(["@h", ">h", "@ h", "h", "@", ">é"])
        qual = "" if head[:1] == ">" and rnd.random() < 0.8 else "".join(rnd.choice('!I~"') for _ in seq)
        cells = [rnd.choice(["1", "007", "x", "٣", ""]), head, seq, qual, str(len(seq) + (rnd.random() < 0.1))]
        lines.append(",".join('"' + c.replace('"', '""') + '"' if '"' in c or rnd.random() < 0.2 else c for c in cells))
    df = spark.createDataFrame(list(enumerate(lines)), "raw_id int, line string")
    got = {r.raw_id: r for r in parse_read_lines(df, chunk=chunk).collect()}
    assert {i: r.reason for i, r in got.items()} == {i: reason_of(x) for i, x in enumerate(lines)}
    for i, r in got.items():
        if r.reason is None:
            fields = fields_of(lines[i])
            assert (r.header, r.seq, r.qual, r.seq_len) == (fields[1], fields[2], fields[3], int(fields[4]))


def test_clashing_names_repeats_and_no_rows(spark):
    rows = [(1, "x", '1,>h,AC,,2'), (1, "x", '1,>h,AC,,2'), (None, None, None)]
    df = spark.createDataFrame(rows, "id int, seq string, line string")
    out = parse_read_lines(df)
    assert out.columns[:2] == ["id", "seq_in"] and out.count() == 3
    assert parse_read_lines(df.filter(F.lit(False))).count() == 0


def test_offsets_name_the_place(spark):
    df = spark.createDataFrame([(0, 'ab"c'), (1, 'a,"bc'), (2, "1,>h,AxC,,3"), (3, "a,b,c,d,e,f")], "id int, line string")
    got = {r.id: (r.reason, r.error_at) for r in parse_read_lines(df).collect()}
    assert got == {0: ("quoting", 2), 1: ("quoting", 5), 2: ("seq", 5), 3: ("columns", 9)}


def test_a_very_long_line(spark):
    line = "1,>h," + "ACGT" * 50_000 + ",,200000"
    df = spark.createDataFrame([(0, line), (1, "1,>h,\"" + '""' * 100_000 + '",,1')], "id int, line string")
    got = {r.id: r for r in parse_read_lines(df).collect()}
    assert got[0].reason is None and got[0].seq_len == 200_000
    assert got[1].reason == "seq"


def test_lines_alone(spark):
    df = spark.createDataFrame([('"' + "x," * 5000 + '"',), ("a,b",)], "line string")
    assert sorted(len(r.fields) for r in tokenize_lines(df, "line").collect()) == [1, 2]
    assert {r.reason for r in parse_read_lines(df).collect()} == {"columns"}


@pytest.mark.parametrize("chunk", [7, 4096])
def test_long_rows_stay_apart(spark, chunk):
    """Equal rows, and rows that differ by a microsecond, come out as often as they came in, whatever the length of the line."""
    line = "1,>h," + "ACGT" * 2000 + ",,8000"
    df = spark.sql(f"SELECT * FROM VALUES (1, TIMESTAMP'2024-01-01 00:00:00.000001'), (1, TIMESTAMP'2024-01-01 00:00:00.000002'), (1, TIMESTAMP'2024-01-01 00:00:00.000001') AS t(id, at), (SELECT '{line}' AS line)")
    got = parse_read_lines(df, chunk=chunk).collect()
    assert sorted(r.at.microsecond for r in got) == [1, 1, 2] and {r.seq_len for r in got} == {8000} and {r.reason for r in got} == {None}
