import json

import parity
import pytest

from cloakframe.operators import pseudonym, restore
from cloakframe.plans import pipeline
from cloakframe.sources import csv
from cloakframe.sources.lexicon import name_bank


def test_bank_has_no_repeats():
    bank = name_bank()
    every = [n for v in bank.values() for n in v]
    assert {k: len(v) for k, v in bank.items()} == {"male": 250, "female": 250, "neutral": 50, "surnames": 500} or len(every) > 800
    assert len(set(every)) == len(every)


def test_blocked_tokens(spark):
    df = spark.createDataFrame([("Barker, Jo",), ("  Ann  Lee ",), (None,), ("",)], "n string")
    flags = spark.createDataFrame([("Epilepsy",)], "value string")
    got = {r["token"] for r in pseudonym.blocked_tokens(df, "n", flags, ["Mr Tarn"]).collect()}
    assert got == {"barker", "jo", "ann", "lee", "epilepsy", "mr", "tarn"}


def test_exact_mode_is_seeded_unique_and_avoids_blocked(spark):
    df = spark.createDataFrame([(i, f"Real {i}", "FMX"[i % 3], f"c{i % 2}") for i in range(40)], "o long, n string, g string, c string")
    first = name_bank()["male"][0].lower()
    run = lambda: pseudonym.exact(df, "n", "o", 5, "c", "g", blocked=[first]).orderBy("cohort", "ord").collect()
    a = run()
    assert a == run()
    for c in ("c0", "c1"):
        own = [r for r in a if r["cohort"] == c]
        assert [r["id_token"] for r in own][:10] == [f"S{i:02d}" for i in range(1, 11)]
        for part in (0, 1):
            names = [r["fake_name"].split()[part] for r in own]
            assert len(set(names)) == len(names) and first not in [n.lower() for n in names]


def test_exhausted_bank_is_an_error():
    bank = {"male": ["A"], "female": [], "neutral": ["B"], "surnames": ["C", "D", "E"]}
    with pytest.raises(pseudonym.NamesExhausted):
        pseudonym.exact_cohort(["x", "y"], ["neutral", "neutral"], bank, [], 1)


def test_scale_mode_never_repeats(spark):
    bank = {"male": ["A", "B"], "female": ["C"], "neutral": ["D", "Real"], "surnames": ["X", "Y", "Z"]}
    df = spark.range(30).selectExpr("id", "'Real Name' AS n")
    out = pseudonym.scale(df, "n", ["id"], 9, pseudonym.blocked_tokens(df, "n"), bank).orderBy("ord").collect()
    fakes = [r["fake_name"] for r in out]
    assert len(set(fakes)) == 30 and all("Real" not in f for f in fakes)
    assert [r["id_token"] for r in out][8:11] == ["S09", "S10", "S11"] and sorted(fakes[:12])[0] == "A X"


def test_shuffle_is_a_permutation(spark):
    out = pseudonym.shuffled(spark.range(500).toDF("k"), ["k"], 3).collect()
    assert sorted(r["position"] for r in out) == list(range(1, 501))
    assert [r["position"] for r in sorted(out, key=lambda r: r["k"])] != list(range(1, 501))


NAMES = {"Ada Fenn": "Jo Barker", "Ben Oak": "Ann Lee", "Cy Wren": ""}
IDS = {"S01": "Jo Barker", "S02": "Ann Lee", "S03": "", "S100": "Max Roe"}
R = restore.Restorer(IDS, NAMES)


@pytest.mark.parametrize(("text", "want", "ids", "names"), [
    ("Ada Fenn [S01] did well.", "Jo Barker did well.", 1, 0),
    ("fenn, ada[S01] and [S02]", "Jo Barker and Ann Lee", 2, 0),
    ("[S09] and [S03] stay", "[S09] and [S03] stay", 0, 0),
    ("[S100] is Ada Fenn's friend", "Max Roe is Jo Barker's friend", 1, 1),
    ("ADA FENN, Oak, Ben", "Jo Barker, Ann Lee", 0, 2),
    ("Ada Fennel is nobody", "Ada Fennel is nobody", 0, 0),
    ("Ａｄａ Fenn", "Jo Barker", 0, 1),
])
def test_id_first(text, want, ids, names):
    out = R(text)
    assert (out[0], out[4], out[5]) == (want, ids, names)


def test_tables_prefixes_and_left_over():
    text = "| Student | Note |\n|---|---|\n| Ada Fenn | saw Ben Oak |\nEnd\nSTUDENT: ben oak did"
    out = R(text, "structured-only")
    assert out[0] == "| Student | Note |\n|---|---|\n| Jo Barker | saw Ben Oak |\nEnd\nSTUDENT: Ann Lee did"
    assert out[3] == ["Ben Oak"] and out[5] == 2
    assert R(text, "global")[3] == []


def test_json_and_fallback():
    doc = {"students": [{"name": "Ada Fenn [S01]", "Ada Fenn": 3}], "n": None}
    out = R(json.dumps(doc), "json")
    assert json.loads(out[1]) == {"students": [{"name": "Jo Barker", "Ada Fenn": 3}], "n": None} and out[2] is True and out[3] == []
    assert R("{broken Ada Fenn", "json")[:3] == ("{broken Jo Barker", None, False)


def test_restore_joins_each_cohort(spark):
    mapping = spark.createDataFrame([(1, "S01", "Ada Fenn", "Jo Barker"), (2, "S01", "Ada Fenn", "Ann Lee"), (3, "S01", "Zed Q", None)], "u int, id_token string, fake_name string, real_name string")
    resp = spark.createDataFrame([(10, 1, "Ada Fenn [S01]"), (11, 2, "Ada Fenn"), (12, 3, "Zed Q [S01]"), (13, 9, "Ada Fenn"), (14, 1, None), (15, 1, "[S01] [S07]")], "r int, u int, text string")
    got = {r["r"]: r["text"] for r in restore.restore(resp, mapping, "u", "r").collect()}
    assert got == {10: "Jo Barker", 11: "Ann Lee", 12: " [S01]", 13: "Ada Fenn", 14: None, 15: "Jo Barker [S07]"}
    ids = {r["r"]: (r["text"], r["id_matches"]) for r in restore.restore_ids(resp, mapping, "u", "r").collect()}
    assert ids[15] == ("Jo Barker [S07]", 1) and ids[10] == ("Ada Fenn Jo Barker", 1) and ids[11] == ("Ada Fenn", 0) and ids[14] == (None, 0)
    assert {(r["r"], r["fake_name"]) for r in restore.unmatched_names(resp, mapping, "u", "r").collect()} == {(10, "Ada Fenn"), (11, "Ada Fenn"), (12, "Zed Q")}
    with pytest.raises(ValueError):
        restore.restore(resp, mapping, "u", "r", strategy="no such")


@pytest.mark.skipif(not (parity.run() and parity.names() and parity.sheet()), reason="no given run")
def test_exact_mode_reproduces_the_given_run(spark):
    want = parity.run()
    df = csv.from_text(spark, parity.sheet())
    out = pipeline.anonymise(df, pipeline.Config(seed=42, mode="exact", bank=parity.names()))
    rows = [[r[c] for c in want["headers"]] for r in out.rows.orderBy("_ord").collect()]
    assert rows == want["rows"]
    assert {r["id_token"]: r["real_name"] for r in out.mapping.collect()} == want["mapping"]["ids"]
    assert out.flags.count() == 9
    risk = out.risk.summary.first()
    assert (risk["total"] - risk["safe"], out.risk.flagged.count()) == (18, 15)
    assert {r["value"] for r in out.risk.rare.collect()} == {"EHCP", "<80%"}


def test_what_is_anonymised_can_be_restored(spark):
    df = csv.sample(spark)
    for mode in ("exact", "scale"):
        out = pipeline.anonymise(df, pipeline.Config(mode=mode, noise=True, redact=True, strip_identifiers=True))
        mapping = out.mapping.selectExpr("1 AS u", "id_token", "fake_name", "real_name")
        text = out.rows.selectExpr("_ord AS r", "1 AS u", "Name AS text")
        back = {r["text"] for r in restore.restore(text, mapping, "u", "r").collect()}
        assert back == {r["Name"] for r in df.collect()}
    assert pipeline.anonymise(df, pipeline.Config(one_way=True)).mapping is None


def test_reversed_names_of_a_mapping(spark):
    rows = [(1, "S01", "Ann Bo", "X"), (1, "S02", "Cy Di", "Y"), (1, "S03", "Cy Di", "Z"), (1, "S04", "Ev", "W"), (1, "S05", "Bo, Ann", "V"), (2, "S01", "Ann  Bo", None)]
    m = spark.createDataFrame(rows, "u long, id_token string, fake_name string, real_name string")
    got = {tuple(r) for r in restore.with_reversed(m, "u").collect()} - {(u, f, r) for u, _, f, r in rows}
    assert got == {(1, "Ann, Bo,", "V")}  # the others are ambiguous, an entry already, or without a real name
    assert (1, "Bo, Ann", "X") in {tuple(r) for r in restore.with_reversed(m.filter("id_token <> 'S05'"), "u").collect()} and restore.surname_first("Ann Bo") == "Bo, Ann"
