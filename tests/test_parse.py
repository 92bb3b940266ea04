import csv
import io

import pytest

from cloakframe.operators import parse

RAW = "row_id long, upload_id long, line_no int, raw_line string, kind string, bad string"
PARSED = "row_id long, upload_id long, row_index int, cells array<string>, headers string"
UPLOADS = "upload_id long, headers array<string>, delimiter_char string, value string"
HEADS = ["Name", "DOB", "Score (%)", "Comments"]


def tables(spark, raw=(), parsed=(), uploads=((1, HEADS, ",", None), (2, HEADS, ";", None), (3, HEADS, "\t", None))):
    r = spark.createDataFrame([(i, u, i, line, "x", "y") for i, u, line in raw], RAW)
    p = spark.createDataFrame([(i, u, i, c, "h") for i, u, c in parsed], PARSED)
    return r, p, spark.createDataFrame(list(uploads), UPLOADS)


def reasons(spark, **k):
    return {(r["origin"], r["row_id"]): r["reason"] for r in parse.rejected(*tables(spark, **k)).collect()}


def test_reasons_of_raw_lines(spark):
    lines = {
        1: ("A,01/02/2010,5,ok", None), 2: ('A,2010-02-01,"5","a, ""b"", c"', None), 3: ('"A,B",,Absent,', None), 4: ('A,,5,say "x"', "quoting"), 5: ('A,,5,"open', "quoting"),
        6: ('A,,5,"x" !', "quoting"), 7: ("A,,5", "column_count"), 8: ("A,,5,x,y", "column_count"), 9: ("A,31/02/2010,5,", "value"), 10: ("A,,101,", "value"), 11: ("A,, 99.5% ,", None),
        12: ("A,,1e2,", "value"), 13: ("A,1/2/2010,5,", "value"), 14: ('A,,5,"line\nbreak"', None), 15: ("   ", None), 16: (None, None), 17: ('A,,-,"', "quoting"), 18: ("A,2010-02-30,,", "value"),
        19: ("", None), 20: ('"",,,', None), 21: (',,5,"x""', "quoting"),
    }
    got = reasons(spark, raw=[(i, 1, line) for i, (line, _) in lines.items()])
    assert got == {("raw_rows", i): r for i, (_, r) in lines.items() if r}


def test_other_delimiters_repeats_and_unknown_uploads(spark):
    raw = [(1, 2, "A;;5;a,b"), (2, 3, "A\t\t5\tx"), (2, 3, "A\t\t5\tx"), (3, 9, "A,,5,x"), (4, 2, "A;;sixty;"), (4, 2, "A;;sixty;")]
    assert reasons(spark, raw=raw) == {("raw_rows", 3): "column_count", ("raw_rows", 4): "value"}


def test_parsed_rows_with_nulls(spark):
    parsed = [(1, 1, ["A", None, None, None]), (2, 1, ["A", "x", "5", ""]), (3, 1, ["A"]), (4, 1, None), (5, 1, ["A", None, "X", None])]
    assert reasons(spark, parsed=parsed) == {("parsed_rows", 2): "value", ("parsed_rows", 3): "column_count", ("parsed_rows", 4): "column_count"}


def test_empty_tables(spark):
    assert reasons(spark) == {}
    assert parse.loaded(*tables(spark)).count() == 0


def test_very_long_cells_do_not_overflow(spark):
    quoted = '"' + 'x""' * 60_000 + '"'
    got = reasons(spark, raw=[(1, 1, f"A,,5,{quoted}"), (2, 1, f"A,,5,{quoted[:-1]}"), (3, 1, "A,,5," + "y" * 300_000)])
    assert got == {("raw_rows", 2): "quoting"}


@pytest.mark.parametrize("cells", [["a", "b,c", 'd"e', ""], ["", "", "", ""], ["x\ny", '"', ",", "z"]])
def test_loads_what_a_writer_wrote(spark, cells):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    heads = ["a", "b", "c", "d"]
    row = parse.loaded(*tables(spark, raw=[(1, 1, out.getvalue())], uploads=[(1, heads, ",", None)])).collect()
    want = dict(zip(heads, cells))
    assert not any(cells) or row[0]["record"] == want


def test_distinct_values_are_cast_once_with_their_reasons(spark):
    lines = ["A,,bad,"] * 50 + ["A,,101,", "A,31/02/2010,5,", "A,1/2/2010,5,", "A,,Absent,", "A,, ,"]
    bad = parse.value_faults(*tables(spark, raw=[(i, 1, x) for i, x in enumerate(lines)])).collect()
    assert {(r["kind"], r["value"], r["why"], r["n"]) for r in bad} == {("number", "bad", "not a number", 50), ("number", "101", "out of range", 1), ("date", "31/02/2010", "no such date", 1), ("date", "1/2/2010", "not a date", 1)}
