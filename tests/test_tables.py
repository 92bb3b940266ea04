import math
import re

import parity
import pytest
from pyspark.sql import functions as F

from cloakframe.functions.prng import generator
from cloakframe.operators import columns, profile, prompt, scan
from cloakframe.operators.noise import noised_column, noised_table
from cloakframe.operators.order import numbered
from cloakframe.sources import csv
from cloakframe.streaming import one_pending, relay, scanned

def test_csv_text(spark):
    df = csv.from_text(spark, ' A,B\n"x, ""y""",1\n\n2\n3,4,5 ')
    assert [tuple(r) for r in df.orderBy("_ord").collect()] == [('x, "y"', "1", 0), ("2", "", 1), ("3", "4", 2)]
    assert csv.from_text(spark, "A,B").count() == 0


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([("=1", 'a "q"'), ("-2", "b")], "x string, y string")
    csv.write(df, str(tmp_path / "out"))
    back = csv.read(spark, str(tmp_path / "out"), strict=True)
    assert sorted(map(tuple, back.collect())) == [("'-2", "b"), ("'=1", 'a "q"')]
    csv.write(df.limit(0), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        csv.read(spark, str(tmp_path / "none"), strict=True)


def test_numbering_is_complete(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = numbered(df, ["k"], "n").collect()
    assert all(r["n"] == r["k"] + 1 for r in got) and len(got) == 1000
    assert numbered(df.limit(0), ["k"], "n").count() == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, "u", "b", "s")], "Name int, UPN string, `Date of Birth` string, Score string")
    assert columns.strip_identifiers(df).columns == ["Name", "Score"]
    assert columns.apply_actions(df, {"UPN": "remove", "Score": "redact"}).first().asDict() == {"Name": 1, "Date of Birth": "b", "Score": "[REMOVED]"}
    with pytest.raises(ValueError):
        columns.apply_actions(df, {"UPN": "burn"})
    first, rest = columns.preview(spark.range(20).toDF("o"), "o")
    assert first.count() == 8 and rest.first()["remaining"] == 12


def test_profile_of_a_class_sheet(spark):
    n = 15
    rows = [(f"Ann{chr(97 + i)} Lee{chr(97 + i)}", "MF"[i % 2], ("72", "Absent", "6.5", "88%")[i % 4], f"A long and rather different remark number {i} about the work in this class", "01/02/2010", None) for i in range(n)]
    df = spark.createDataFrame(rows, "`Student Name` string, Gender string, `Maths Score` string, `Teacher Comment` string, DOB string, Blank string")
    got = {r["name"]: (r["type"], r["reviewRequired"]) for r in profile.profile(df).collect()}
    assert got == {
        "Student Name": ("name", False), "Gender": ("categorical", False), "Maths Score": ("numerical", False), "Teacher Comment": ("free-text", False), "DOB": ("identifier", False), "Blank": ("categorical", True),
    }
    r = profile.roles(df)
    assert (r.name, r.gender, r.numeric, r.free_text) == ("Student Name", "Gender", ("Maths Score",), ("Teacher Comment",))


@pytest.mark.parametrize(("value", "want"), [("Ann Lee", True), ("Barker, Jo", True), ("O'Neil Mary-Ann", True), ("D.B.", False), ("Ann", False), ("a b c d e", False), ("AB CD", False), ("Ann 2", False), ("Mr. J Smith", True)])
def test_looks_like_name(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(profile.looks_like_name(F.col("v")).alias("x")).first()["x"] is want


def test_noise_uses_one_draw_per_number(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["65", "Absent", "72%", None, "58", "Withdrawn", "81"])], "o int, s string")
    out = {r["o"]: r["s"] for r in noised_column(df, "s", ["o"], 42, boundaries=(40, 50, 60, 70, 80)).collect()}
    assert [out[i] is None for i in range(7)] == [False, True, False, True, False, True, False]
    table, failures, used = noised_table(df, ["s"], ["o"], 42)
    cells = {r["o"]: r["s"] for r in table.collect()}
    assert used == 4 and cells[1] == "Absent" and cells[3] is None and cells[2].isdigit() and failures.first()["failures"] == 0


def test_prompts(spark):
    df = spark.createDataFrame([("a", 2, 'x "y"'), ("a", 1, "p,q"), ("b", 1, None)], "c string, o int, v string")
    got = {r["c"]: r for r in prompt.assemble(df, "write-report-comments", {"subject": "Art", "tone": "formal", "wordCount": "50"}, ["v"], "o", "c").collect()}
    assert '```csv\nv\r\n"p,q"\r\n"x ""y"""\n```' in got["a"]["prompt"] and got["a"]["strategy"] == "id-first"
    assert "5. Copy all" in got["b"]["prompt"] and "json" not in got["b"]["prompt"]
    with pytest.raises(ValueError):
        prompt.frame("write-report-comments", {"subject": "Art", "tone": "", "wordCount": "50"})
    with pytest.raises(KeyError):
        prompt.get_template("none")
    assert "Additional context: c" in prompt.frame("analyse-class-performance", {"subject": "s", "focus": "f", "context": "c"})[0]


@pytest.mark.skipif(not parity.templates(), reason="no given templates")
def test_templates_equal_the_given_ones():
    for given in parity.templates():
        own = prompt.get_template(given["id"])
        assert all(own[k] == given[k] for k in prompt.SUMMARY) and own.get("jsonSchema") == given.get("jsonSchema")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a@b.org"), (2, "none")], "id int, t string").write.parquet(src)
    stream = scanned(spark.readStream.schema("id int, t string").parquet(src), "t")
    stream.select("id", "cleaned").writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start().awaitTermination()
    assert {r["id"]: r["cleaned"] for r in spark.sql("SELECT * FROM cleaned").collect()} == {1: "[REDACTED EMAIL]", 2: "none"}


def test_relay(spark):
    p = spark.sql("SELECT 1 AS id, timestamp'2024-01-01 10:00:00' AS asked, 'q' AS prompt UNION ALL SELECT 2, timestamp'2024-01-01 10:00:00', 'late'")
    a = spark.sql("SELECT 1 AS id, timestamp'2024-01-01 10:30:00' AS said, 'a' AS answer UNION ALL SELECT 2, timestamp'2024-01-01 12:00:00', 'b'")
    assert [(r["id"], r["prompt"], r["answer"]) for r in relay(p, a, "id", "asked", "said").collect()] == [(1, "q", "a")]


def test_one_prompt_waits(spark, tmp_path):
    rows = [(1, 1, "prompt", "a"), (1, 2, "prompt", "b"), (1, 3, "answer", "x"), (1, 4, "answer", "y"), (2, 1, "answer", "z"), (2, 2, "prompt", "c"), (3, 1, "prompt", "d")]
    later = [(2, 5, "answer", "w"), (3, 6, "prompt", "e"), (3, 7, "answer", "v")]
    schema = "id long, at long, kind string, body string"
    for part in (rows, later):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = one_pending(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "id", ["at"], "kind", "body")
        s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "b", "x"), (2, "c", "w"), (3, "e", "v")}


def test_draws_of_several_columns_follow_one_another(spark):
    cells = [(i, f"{i}" if i % 3 else "Absent", None if i % 4 == 0 else f"{50 + i}%") for i in range(40)]
    df = spark.createDataFrame(cells, "o long, a string, b string").repartition(5)
    got = {r["o"]: (r["a"], r["b"]) for r in noised_table(df, ["a", "b"], ["o"], 7, used=3)[0].collect()}
    following, want = generator(7, 3), {o: [a, b] for o, a, b in cells}
    for k in (0, 1):
        for o, *row in cells:
            m = re.match(r"\d+", row[k] or "")
            if m:
                u = following() - 0.5
                noise = 0.0 if u == 0 else -2.5 * math.copysign(1, u) * math.log(1 - 2 * abs(u))
                y = float(m[0]) + max(-5.0, min(5.0, noise))
                want[o][k] = str(int(min(100, max(0, math.copysign(math.floor(abs(y) + 0.5), y)))))
    assert got == {o: tuple(v) for o, v in want.items()}


def test_roster_terms_of_many_pieces(spark):
    name = "Ana-Lu Bo Ci Di-Ef Ga Ha Il"
    texts = spark.createDataFrame([(1, f"Today {name} sang. Ana alone. Bo too.")], "id long, t string")
    hits = scan.roster_hits(texts, "id", "t", spark.createDataFrame([(name,), ("Ana",), ("Bo",)], "n string"), "n").collect()
    assert {(r["position"], r["value"]) for r in hits} == {(6, name), (40, "Ana"), (51, "Bo")}
