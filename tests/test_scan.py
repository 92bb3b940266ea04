import pytest
from pyspark.sql import functions as F

from cloakframe.operators import scan

CONFIG = scan.ScanConfig(names=("Mary Sole",), staff=("Mr Tarn",), keywords={"medical": ("epilepsy", "foster carer"), "family": ("mum", "foster carer"), "safeguarding": ()}, extra=((r"(?i)room \d+", "room"),))


def scanned(spark, value, config=CONFIG, overlapping=False):
    return spark.createDataFrame([(value,)], "v string").select(scan.scan_text(F.col("v"), config, overlapping).alias("x")).first()["x"]


def test_all_types(spark):
    r = scanned(spark, "mary saw Mr Tarn on 3/4/2024 in Room 12, AB1 2CD, mum: 07123 456 789 or a.b@c.org re epilepsy")
    assert [(f["type"], f["subtype"], f["value"]) for f in r["flags"]] == [
        ("name", None, "mary"), ("name", None, "Mr Tarn"), ("date", None, "3/4/2024"), ("room", None, "Room 12"), ("postcode", None, "AB1 2CD"), ("keyword", "family", "mum"),
        ("phone", None, "07123 456 789"), ("email", None, "a.b@c.org"), ("keyword", "medical", "epilepsy"),
    ]
    assert r["cleaned"] == "[REDACTED NAME] saw [REDACTED NAME] on [REDACTED DATE] in [REDACTED], [REDACTED POSTCODE], [PARENT/GUARDIAN]: [REDACTED PHONE] or [REDACTED EMAIL] re [ADDITIONAL NEEDS]"


@pytest.mark.parametrize("value", ["", None])
def test_nothing_to_scan(spark, value):
    assert scanned(spark, value)["flags"] == []


def test_overlapping_flags_are_made_disjoint(spark):
    r = scanned(spark, "her foster carer came")
    assert len(r["flags"]) == 2 and r["cleaned"].startswith("her [") and r["cleaned"].endswith("] came")


def test_long_text_and_ascii_edges(spark):
    r = scanned(spark, "x " * 20_000 + "mum éabsent")
    assert [f["position"] for f in r["flags"]] == [40_000]


def test_roster_equals_one_alternation(spark):
    texts = ["Mary Sole met Ann Lee and ann", "SOLE mary-ann Lee", "nothing", None, "Lee Lee Mary Sole's"]
    terms = ["Mary Sole", "Mary", "Sole", "Ann Lee", "Ann", "Lee"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    roster = spark.createDataFrame([(t,) for t in terms], "term string")
    got = sorted((r["id"], r["position"], r["value"]) for r in scan.roster_hits(df, "id", "t", roster, "term").collect())
    want = sorted((r["id"], r["f"]["position"], r["f"]["value"]) for r in df.select("id", F.explode(scan.scan_names(F.col("t"), terms)).alias("f")).collect())
    assert got == want and len(got) == 9


def test_table_and_decisions(spark):
    df = spark.createDataFrame([(1, "call a@b.org", "on 1/2/2020"), (2, None, " ")], "id int, a string, b string")
    flags = scan.scan_table(df, "id", ["a", "b"], scan.ScanConfig(keywords={}))
    assert sorted((r["id"], r["column"], r["type"]) for r in flags.collect()) == [(1, "a", "email"), (1, "b", "date")]
    refused = spark.createDataFrame([(1, "a", False), (1, "b", True)], "id int, column string, accepted boolean")
    assert [r["column"] for r in scan.approved_only(flags, refused, ["id", "column"]).collect()] == ["b"]
