import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakframe.llm import names

OWN = frozenset("rose zoe tomas mark garlock penley fenley wexby harriet".split())


class Even(names.Likeness):
    def weight(self, token):
        return 1.0 if len(token) == 1 else 3.0


def alike(a, b, own=OWN):
    return Even({})(names.fold(a).split(), names.fold(b).split(), own)


@pytest.mark.parametrize(("a", "b"), [
    ("Rose Garlock", "Garlock, Rose"), ("Rose Garlock", "R. Garlock"), ("Rose Garlock", "Rose G"), ("Rose Garlock", "Rosie Garlock"), ("Zoë Wexby", "zoe  wexby"), ("Tomás Garlock", "Tom Garlock"),
    ("Rose Garlock", "Rose Anne Garlock"), ("Harriet Garlock", "Har. Garlock"), ("Rose Garlock", "Rose Garlokc"), ("Милица Жарковић", "Milica Zharkovic"), ("Rose Al-Noori", "Rose Al Noori"), ("Rose Elsden", "Rose Elsden-Elsgate"),
])
def test_variants(a, b):
    assert alike(a, b) >= names.SIMILAR and alike(b, a) >= names.SIMILAR


@pytest.mark.parametrize(("a", "b"), [("Rose Garlock", "Mark Garlock"), ("Rose Penley", "Rose Fenley"), ("Rose Garlock", "Rose Wexby"), ("Rose", "Rose Garlock"), ("R G", "Rose Garlock")])
def test_others(a, b):
    assert alike(a, b) < names.SIMILAR


def plain_osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edits_against_the_full_table():
    words = ["garlock", "garlokc", "graloc", "gar", "", "a", "lock", "garlockk", "agrlock", "wexby"]
    for a, b in itertools.product(words, words):
        assert min(names.osa(a, b, 2), 3) == min(plain_osa(a, b), 3)


SCHEMA = "record_id long, class_id long, term string, pupil_name string, gender string, pp string, eal string, school_id string, comments string, key string, tokens string"
STAFF = "staff_id long, school_id string, title string, staff_name string, staff_role string, said string"


def records(spark, rows):
    return spark.createDataFrame([(i, c, t, n, g, None, "No", "S", m, "k", "t") for i, c, t, n, g, m in rows], SCHEMA)


def test_pupils(spark):
    rows = [
        (1, 1, "A", "Rose Garlock", "F", None), (2, 1, "B", "Garlock, Rose", "f.", None), (3, 1, "C", "Rose Garlock", None, None), (3, 1, "C", "Rose Garlock", None, None), (4, 1, "D", "R Garlock", "F", None),
        (5, 1, "A", "Mark Garlock", "M", None), (6, 1, "B", "Mark Garlock", "M", None), (7, 2, "A", "Rosie Garlock", "F", None), (8, 1, "A", None, "F", None), (9, 1, "B", "", "F", None), (10, None, "B", "Rose Garlock", "F", None),
        (11, 1, "C", "x" * 3000 + " y", "M", None), (12, 3, "A", "Жарковић Милица", "F", None), (13, 3, "B", "Милица Жарковић", "F", None), (14, 3, "C", "Милица Жарк​овић", "F", None),
    ]
    got = {(r["left_id"], r["right_id"]) for r in names.same_pupils(names.Spellings(records(spark, rows))).collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (2, 4), (3, 4), (12, 13), (12, 14), (13, 14)}


def test_no_rows(spark):
    assert names.same_pupils(names.Spellings(records(spark, []))).count() == 0


def test_join_finds_all_that_brute_force_finds(spark):
    first, last = ["Rose", "Tomas", "Harriet", "Mark"], ["Garlock", "Wexby", "Penley"]
    people = [f"{a} {b}" for a in first for b in last]
    rows, i = [], itertools.count(1)
    for p in people:
        a, b = p.split()
        for t, v in zip("ABCD", (p, f"{b}, {a}", f"{a} {b[:-2]}{b[-1]}{b[-2]}", f"{a} {b[0]}."), strict=True):
            rows.append((next(i), 1, t, v, None, None))
    spelled = names.Spellings(records(spark, rows))
    got = {(r["left_id"], r["right_id"]) for r in names.same_pupils(spelled).collect()}
    owner = {r[0]: (r[0] - 1) // 4 for r in rows}
    want = {(x, y) for x, y in itertools.combinations(sorted(owner), 2) if owner[x] == owner[y]}
    assert got == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 12)] + [(20, 21), (22, 21)]
    got = {r["id"]: r["person"] for r in names.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 1 for i in range(1, 13)}, 20: 20, 21: 20, 22: 20}


def own(spark):
    return spark.createDataFrame([(t,) for t in OWN], "t string")


def test_staff(spark):
    said = [
        "Referred to Mr Garlokc.", "cc MS WEXBY", "seen by ms wexby", "Cover lesson (Tomas Garlock) went fine", "Mrs Garlock (parent) rang", "Spoke with Mr Penley", None, "", "Mr Fenley to follow up", "Support from Zoë Wexbyy",
        "Detention with Mr T. Garlock, reason", "Mr Mark Garlock rang", "x " * 5000 + "Mr Garlock",
    ]
    staff = spark.createDataFrame([(100, "S", "Mr", "Tomás Garlock", "t", "x"), (101, "S", "Ms", "Zoë Wexby", "t", "x"), (102, "T", "Mr", "Ann Penley", "t", "x"), (103, "S", "Mr", "Bo Penley-Harden", "t", "x"), (104, None, "Mr", None, "t", "x")], STAFF)
    rows = records(spark, [(i, 1, "A", "Rose Garlock", "F", s) for i, s in enumerate(said)])
    got = {(r["record_id"], r["staff_id"]) for r in names.staff_named(rows, staff, own(spark)).collect()}
    assert got == {(0, 100), (1, 101), (2, 101), (3, 100), (5, 103), (9, 101), (10, 100), (12, 100)}


def test_staff_after_other_capitalised_words(spark):
    said = [
        "Lives at Unit 5, Bellmakers Drive. Zoë Wexby runs the group.", "In Maths Tomas Garlock said", "Mr Smith Mr Garlock met", "Mr Smith Tomas Garlock", "With Mrs T. Garlock", "Saw Wexby. Zoë left",
        "Mr and Ms Wexby", "Report To Head Zoë Wexby, Tomas Garlock",
    ]
    staff = spark.createDataFrame([(100, "S", "Mr", "Tomás Garlock", "t", "x"), (101, "S", "Ms", "Zoë Wexby", "t", "x")], STAFF)
    rows = records(spark, [(i, 1, "A", "Rose Garlock", "F", s) for i, s in enumerate(said)])
    got = {(r["record_id"], r["staff_id"]) for r in names.staff_named(rows, staff, own(spark)).collect()}
    assert got == {(0, 101), (1, 100), (2, 100), (3, 100), (6, 101), (7, 100), (7, 101)}


def test_an_initial_and_a_slip_or_two_slips_meet(spark):
    pairs = [("K Garwick", "Krzys Gsrwick"), ("S Whitby", "Seb Whityb"), ("F Garwick", "Flossie Garwcik"), ("Rosa Whityb", "Rsoa Whitby"), ("Harriet Penley", "Harreit Pnelye")]
    rows = [(2 * i + k, i, "AB"[k], n, None, None) for i, p in enumerate(pairs) for k, n in enumerate(p)]
    got = {(r["left_id"], r["right_id"]) for r in names.same_pupils(names.Spellings(records(spark, rows))).collect()}
    want = {(2 * i, 2 * i + 1) for i, (a, b) in enumerate(pairs) if alike(a, b, ()) >= names.SIMILAR}
    assert got == want and len(want) >= 4


LETTERS = st.text("abcdefgz", min_size=2, max_size=12)


@settings(max_examples=400, deadline=None)
@given(LETTERS, st.integers(0, 3), st.integers(0, 11), st.sampled_from("abcz"))
def test_the_prefix_reaches_every_token_within_one_edit(token, edit, at, letter):
    at %= len(token)
    other = [token[:at] + letter + token[at:], token[:at] + token[at + 1 :], token[:at] + letter + token[at + 1 :], token[:at] + token[at : at + 2][::-1] + token[at + 2 :]][edit]
    weights = {g: 1.0 + (ord(g[0]) * 7 + ord(g[1])) % 5 for g in names.grams(token)}
    met = set(names.features(token, weights)) & set(names.features(other, weights))
    assert met or token == other or min(len(token), len(other)) < 3


def test_two_abbreviations_are_not_enough():
    assert alike("Jo W", "Joanna Whitby") == 0 and alike("Joanna W", "Joanna Whitby") >= names.SIMILAR and alike("Jo Whitby", "Joanna Whitby") >= names.SIMILAR


def test_names_of_many_tokens_and_ties_of_staff(spark):
    rows = [(1, 1, "A", "Ana Maria de la Torre Garlock", None, None), (2, 1, "B", "Ana Garlock", None, None), (3, 1, "C", "Ana Maria Luisa de la Torre Garlokc", None, None)]
    got = {(r["left_id"], r["right_id"]) for r in names.same_pupils(names.Spellings(records(spark, rows))).collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}
    staff = spark.createDataFrame([(100, "S", "Mr", "Tomás Garlock", "t", "x"), (101, "S", "Mr", "Tom Garlock", "t", "x"), (102, "S", "Ms", "Zoë Wexby", "t", "x")], STAFF)
    said = records(spark, [(0, 1, "A", "x", None, "Mr Garlock's set"), (1, 1, "A", "x", None, "Saw Zoë Anne Wexby here"), (2, 1, "A", "x", None, "Ms Zoë Anne Wexby's set, Mr Garlockk's too")])
    got = {(r["record_id"], r["staff_id"]) for r in names.staff_named(said, staff, own(spark)).collect()}
    assert got == {(0, 100), (0, 101), (1, 102), (2, 102), (2, 100), (2, 101)}


def test_a_class_that_holds_most_rows(spark):
    rows = [(i, 1, f"T{i % 50}", f"P{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}u Garlock", None, None) for i in range(600)]
    pairs = names.same_pupils(names.Spellings(records(spark, rows)))
    assert pairs.filter("left_id >= right_id").count() == 0
