import numpy as np
import pytest

from cloakframe.llm import pii

FIRST, LAST = frozenset("rose grace mark ann zoë tomás hope ibrahim".split()), frozenset("garlock al-noori wexby o'dorrin pencroft".split())
FIND = pii.Finder(FIRST, LAST)


def spans(text):
    """The candidates for which more voters speak than against."""
    return [(k, text[a:b]) for k, a, b, votes, _ in FIND(text) if sum(map(int, votes.split(","))) > 0]


@pytest.mark.parametrize(("text", "want"), [
    ("mail ann_1@x.example now", [("email", "ann_1@x.example")]), ("to ann @ x.example", [("email", "ann @ x.example")]), ("to ann at x dot example now", [("email", "ann at x dot example")]),
    ("no reply @ parents' evening", []), ("Meet @ 15:30 in B42", []), ("ring (01632) 960 903", [("phone", "(01632) 960 903")]), ("ring 0 7 7 0 0 9 0 0 5 3 6", [("phone", "0 7 7 0 0 9 0 0 5 3 6")]),
    ("No answer on 01632 960218 ext 23; x", [("phone", "01632 960218 ext 23")]), ("+44 (0)20 7946 0947", [("phone", "+44 (0)20 7946 0947")]), ("Entered as QQ123456C", [("id_number", "QQ123456C")]),
    ("Form returned - NHS 999 123 4567", [("id_number", "NHS 999 123 4567")]), ("Lives at Flat 7, 69 Copper Drive, Town ZX1 6FQ.", [("address", "Flat 7, 69 Copper Drive, Town ZX1 6FQ")]),
    ("Page 34 Road Safety unit", []), ("Moved to The Granary, Salt Terrace", [("address", "The Granary, Salt Terrace")]), ("now 85 millrace crescent, Town", [("address", "85 millrace crescent, Town")]),
    ("Referred to Mr Garlokc.", [("name", "Mr Garlokc")]), ("Sits with Zoë Wexby, which", [("name", "Zoë Wexby")]), ("Rose's work", [("name", "Rose")]), ("well done Ibrahim!", [("name", "Ibrahim")]),
    ("Al-Noori, Ann: report", [("name", "Al-Noori, Ann")]), ("Today Ann B. read aloud", [("name", "Ann B")]), ("as agreed with ms al-noori", [("name", "ms al-noori")]), ("no concerns", []), ("Trip to Tarnwick Fells", []),
])
def test_candidates(text, want):
    assert spans(text) == want


def test_spans_never_overlap_and_long_text_is_read_whole():
    text = ("ok. " * 30_000) + "Call mum on 07700 900770, Mr Wexby, ann@x.example"
    got = FIND(text)
    assert all(len(x[4]) == 5 and max(x[4]) < pii.FEATURES for x in got)
    assert len(got) == 3 and got[0][1] > 100_000
    ordered = sorted(got, key=lambda s: s[1])
    assert all(a[2] <= b[1] for a, b in zip(ordered, ordered[1:], strict=False))


def test_candidates_are_generous():
    seen = [(k, v) for text in ("Meet @ 15:30 in B42", "Locker 123456 kept", "saw Kestrel here", "by Copper Drive now") for k, _, _, v, _ in FIND(text)]
    assert {k for k, _ in seen} == {"email", "phone", "name", "address"} and all(sum(map(int, v.split(","))) < 0 for _, v in seen)


def test_names_and_streets_of_any_length():
    assert spans("Saw Rose Grace Ann Hope Zoë Wexby today") == [("name", "Rose Grace Ann Hope Zoë Wexby")]
    assert spans("lives at 4 Old Upper Mill Copper Lane, Town ZX1 6FQ") == [("address", "4 Old Upper Mill Copper Lane, Town ZX1 6FQ")]


def test_estimation_separates_good_from_bad_votes():
    counts = {"1,1,0": 500, "1,0,0": 200, "0,1,0": 150, "-1,0,-1": 700, "1,0,-1": 5, "0,0,-1": 90}
    p, reliable = pii.estimate(counts)
    assert p["1,1,0"] > 0.95 and p["1,0,0"] > 0.8 and p["-1,0,-1"] < 0.1 and min(reliable) > 0.8
    assert pii.estimate({})[0] == {}


def voted(seed, voters, n=4000):
    """Patterns of independent voters, each given as the share of right votes and the share of votes cast."""
    rng, counts, truth = np.random.default_rng(seed), {}, {}
    for _ in range(n):
        y = rng.random() < 0.4
        v = ",".join(str((1 if (rng.random() < right) == y else -1) if rng.random() < cast else 0) for right, cast in voters)
        counts[v] = counts.get(v, 0) + 1
        truth.setdefault(v, []).append(y)
    return counts, truth


def test_a_bad_voter_loses_its_reliability():
    good = [(0.9, 0.9), (0.85, 0.8), (0.9, 0.7), (0.8, 0.9)]
    for last, low, high in (((0.9, 0.8), 0.8, 1.0), ((0.5, 0.8), 0.4, 0.6), ((0.2, 0.8), 0.0, 0.35)):
        counts, truth = voted(3, [*good, last])
        p, reliable = pii.estimate(counts)
        assert low <= reliable[-1] <= high and all(abs(x - right) < 0.06 for x, (right, _) in zip(reliable, good, strict=False))
        right = sum(sum(y == (p[v] >= 0.5) for y in ys) for v, ys in truth.items())
        assert right / 4000 > 0.9


def test_the_classifier_overrules_votes_by_the_span():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(3000):
        y = rng.random() < 0.5
        rows.append((("1,0" if rng.random() < 0.85 else "0,0") if y else ("-1,0" if rng.random() < 0.85 else "0,0"), [7 if y else 9, int(rng.integers(20, 400))]))
    target = np.array([{"1,0": 0.95, "0,0": 0.5, "-1,0": 0.05}[v] for v, _ in rows])
    c = pii.Classifier([v for v, _ in rows], [f for _, f in rows], target)
    got = c(["0,0", "0,0", "1,0", "-1,0"], np.array([[7, 30], [9, 30], [7, 30], [9, 30]]))
    assert got[0] > 0.5 > got[1] and got[2] > 0.8 and got[3] < 0.2


def test_frequent_words_are_no_slips(spark):
    rows = [(i, f"Trip to Tarnwickk on day {i}. Saw Penlay{'abcdefgh'[i % 8]} too") for i in range(60)]
    finder = pii.candidates(spark.createDataFrame(rows, "id long, t string"), "id", "t", frozenset(), frozenset({"tarnwick"}))
    got = {r["votes"].split(",")[pii.SPELLED] for r in pii.spelling_checked(finder).filter("kind = 'name'").collect()}
    assert got == {"-1"}


def test_table(spark):
    rows = [(1, "Call mum on 07700 900770 or 020 7946 0219. Mr Wexby"), (2, None), (3, ""), (4, "Calculator no. 52713"), (1, "Call mum on 07700 900770 or 020 7946 0219. Mr Wexby")]
    rows += [(10 + i, f"ring 07700 900{i:03d}, Mrs Pencroft, note Locker code 1234{i}") for i in range(40)]
    names = [("Rose Garlock",)] * 5 + [("Ann Wexby",)] * 5 + [("Hope Pencroft",)] * 5 + [(None,), ("",)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "id long, t string, kind string, seq int")
    people = spark.createDataFrame(names, "n string")
    found = pii.personal_spans(df, "id", "t", people, "n")
    got = {(r["id"], r["kind"], r["seq"]) for r in pii.numbered(found, "id").collect()}
    assert {(1, "phone", 1), (1, "phone", 2), (1, "name", 1)} <= got and not any(i in (2, 3, 4) for i, _, _ in got)
    assert len(got) == 3 + 80
    clean = {r["id"]: r["t"] for r in pii.redact(df, "id", "t", found).collect()}
    assert clean[1] == "Call mum on [PHONE] or [PHONE]. [NAME]" and clean[2] is None and clean[4] == "Calculator no. 52713"
    assert pii.personal_spans(df.limit(0), "id", "t", people, "n").count() == 0
