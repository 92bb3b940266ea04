from collections import Counter

import pytest

from cloakframe.operators import risk


def people(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "o long, gender string, `SEN (x)` string")


ROWS = [("F", "No")] * 10 + [("M", "No")] * 8 + [("F", "K")] * 3 + [("M", None)]


def test_small_groups(spark):
    got = risk.small_group_rows(people(spark, ROWS), ["gender", "SEN (x)"], 3, "o").collect()
    assert [(r["attributes"], r["count"], r["row_ids"]) for r in got] == [({"gender": "M", "SEN (x)": ""}, 1, [21])]
    s = risk.k_summary(people(spark, ROWS), ["gender", "SEN (x)"], 3).first()
    assert (s["threshold"], s["total"], s["safe"]) == (3, 22, 21)


def test_no_attributes_or_rows(spark):
    df = people(spark, ROWS)
    assert risk.k_summary(df, [], 3).first()["safe"] == 22 and risk.small_groups(df, [], 3).count() == 0
    empty = df.limit(0)
    r = risk.analyse(empty, ["gender"], ["gender"], "o")
    assert r.k == 5 and [x["text"] for x in r.recommendations.collect()] == ["No data to analyse."]


@pytest.mark.parametrize(("n", "k"), [(0, 5), (19, 5), (20, 3)])
def test_auto_k(n, k):
    assert risk.auto_k(n) == k


def test_rare_values_and_suggestions(spark):
    df = spark.createDataFrame([("ehcp", "A")] + [("No", "b")] * 4 + [("weird", "ADHD")], "SEN string, Other string")
    got = {(r["columnName"], r["value"]): (r["count"], r["suggestion"]) for r in risk.with_suggestions(risk.rare_values(df, ["SEN", "Other"], 5)).collect()}
    assert got == {("SEN", "ehcp"): (1, "SEN: Yes"), ("SEN", "weird"): (1, None), ("Other", "A"): (1, "Additional support: Yes"), ("Other", "ADHD"): (1, "Medical: Yes")}


def test_recommendations(spark):
    r = risk.analyse(people(spark, ROWS), ["gender", "SEN (x)"], ["SEN (x)"], "o", 3)
    texts = [x["text"] for x in r.recommendations.orderBy("part", "place").collect()]
    assert texts == [
        "21 of 22 students are in groups of 3+. 1 student has attribute combinations shared by fewer than 3 others.",
        "Group (gender=M, SEN (x)=): 1 student — consider generalising or suppressing distinguishing attributes.",
        'Rare category in "SEN (x)": "" appears only 1 time.',
    ]
    safe = risk.analyse(people(spark, [("F", "No")] * 20), ["gender"], [], "o").recommendations.collect()
    assert [x["text"] for x in safe] == ["All 20 students are in groups of 3+. No re-identification risk detected from quasi-identifiers."]


def test_bands_and_attributes(spark):
    df = spark.createDataFrame([("71", "85%", "x")], "`Maths Score` string, Attendance string, Other string")
    out, grades, attendances = risk.with_bands(df, ["Maths Score", "Attendance"])
    assert (grades, attendances) == (["Maths Score Band"], ["Attendance Band"])
    assert out.first()["Maths Score Band"] == "70-79" and out.first()["Attendance Band"] == "80-89%"
    assert risk.quasi_identifiers(["a", "g"], "g", grades, attendances) == ["a", "g", "Maths Score Band", "Attendance Band"]


def test_tiers(spark):
    df = spark.createDataFrame([("a",)] * 11 + [("b",)] * 19 + [("c",)] * 20, "c string")
    got = {r["c"]: (r["tier"], r["small"]) for r in risk.cohorts(df, "c").collect()}
    assert got == {"a": ("high", True), "b": ("medium", False), "c": ("low", False)}
    assert {r["tier"] for r in risk.cohorts(df.selectExpr("c", "1 AS `LAC status`"), "c").collect()} == {"high"}


def test_cube_against_counting(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("b", "y"), ("b", None)]
    df = spark.createDataFrame(rows, "p string, q string")
    got = {r["subset"]: (r["groups"], r["small_groups"], r["exposed_rows"]) for r in risk.attribute_cube(df, ["p", "q"], 2).collect()}
    for subset, cut in (("p,q", lambda r: r), ("p", lambda r: r[0]), ("q", lambda r: r[1] or ""), ("", lambda r: 0)):
        n = Counter(map(cut, rows))
        assert got[subset] == (len(n), sum(v < 2 for v in n.values()), sum(v for v in n.values() if v < 2))
