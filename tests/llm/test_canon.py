from cloakframe.llm import canon

CANON = [("sen", "No", "No special educational need"), ("sen", "K", "SEN support"), ("sen", "EHCP", "Education, health and care plan"), ("sen", "EXIT", "Support ended"), ("gender", "M", "Male"), ("gender", "F", "Female"), ("gender", "X", "Non-binary")]

#: A caller's own spellings.
ALIASES = {
    "sen": {"No": ("not SEN",), "K": ("K code",), "EHCP": ("EHCP",), "EXIT": ("formerly K",)},
    "gender": {"X": ("they/them",)},
}


def found(spark, entries, codes=CANON):
    rows = spark.createDataFrame([(i, v if f == "gender" else None, v if f == "sen" else None, "t", 0.5) for i, (f, v) in enumerate(entries)], "record_id long, gender string, sen string, token string, score double")
    codes = spark.createDataFrame(codes, "field_name string, code string, label string")
    return {r["record_id"]: r["code"] for r in canon.canonical(rows, codes, same=(), aliases=ALIASES).collect()}


VALUES = [
    ("gender", "male.", "M"), ("gender", "FEMLAE", "F"), ("gender", " M", "M"), ("gender", "they/them", "X"), ("gender", "dyslexic", "UNMATCHED"), ("gender", "-", "UNMATCHED"), ("gender", "Yes", "UNMATCHED"),
    ("gender", "ask", "UNMATCHED"), ("sen", "no", "No"), ("sen", "not SEN", "No"), ("sen", "notSEN", "No"), ("sen", "n oSEN", "No"), ("sen", "not ESN", "No"), ("sen", "E.H.C.P.", "EHCP"), ("sen", "K cdoe", "K"),
    ("sen", "formerly K", "EXIT"), ("sen", "glasses", "UNMATCHED"), ("sen", "set 2", "UNMATCHED"), ("sen", "PP", "UNMATCHED"), ("sen", "x" * 5000, "UNMATCHED"), ("sen", "?", "UNMATCHED"),
]


def test_values(spark):
    got = found(spark, [x[:2] for x in VALUES])
    assert [(f, v, got[i]) for i, (f, v, _) in enumerate(VALUES)] == VALUES


def test_blank_null_and_exact_codes_have_no_row(spark):
    assert found(spark, [("sen", "K"), ("sen", ""), ("sen", "  "), ("sen", None), ("gender", "F"), ("gender", None)]) == {}


def test_empty_and_repeats(spark):
    assert found(spark, []) == {}
    rows = spark.createDataFrame([(1, "femal", "girl", None, "A B"), (1, "femal", "girl", None, "A B")], "record_id long, gender string, sen string, class_id long, pupil_name string")
    codes = spark.createDataFrame(CANON, "field_name string, code string, label string")
    got = sorted((r["field_name"], r["code"]) for r in canon.canonical(rows, codes).collect())
    assert got == [("gender", "F"), ("sen", "UNMATCHED")]


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_token_join_finds_every_single_edit(spark):
    vocabulary = ["support", "plan", "register", "no", "sen", "female"]
    left = {w[:i] + c + w[i + k :] for w in vocabulary for i in range(len(w) + 1) for k in (0, 1) for c in ("", "x")} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in vocabulary for i in range(len(w) - 1)}
    left.discard("")
    a = spark.createDataFrame([("f", t) for t in left], "field string, token string")
    b = spark.createDataFrame([("f", t) for t in vocabulary], "field string, token string")
    got = {(r["token"], r["entry_token"]) for r in canon.similar_tokens(a, b).collect()}
    for t in left:
        for v in vocabulary:
            if osa(t, v) == 0 or (osa(t, v) == 1 and max(len(t), len(v)) >= 3 and min(len(t), len(v)) >= 3):
                assert (t, v) in got
            elif osa(t, v) > 2:
                assert (t, v) not in got


def test_entries_are_learned_from_rows_of_the_same_thing(spark):
    rows, i = [], 0
    for n in range(120):  # pupils: one row with the code, one with what was typed
        code, typed = (("F", "lass"), ("M", "lad"), ("X", "enby"), ("M" if n % 8 == 3 else "F", "ask"))[n % 4]
        rows += [(2 * n, code, None, 1, f"P{n}"), (2 * n + 1, typed if n != 7 else "lsas", None, 1, f"P{n}")]
    rows.append((1000, "lass", None, None, None))
    got = dict(
        canon.canonical(
            spark.createDataFrame(rows, "record_id long, gender string, sen string, class_id long, pupil_name string"), spark.createDataFrame(CANON, "field_name string, code string, label string")
        ).select("record_id", "code").collect()
    )
    want = {1000: "F"}
    for n in range(120):
        want[2 * n + 1] = ("F", "M", "X", "UNMATCHED")[n % 4] if n != 7 else "F"
    assert got == want  # what says nothing of the code is not learned, a slip of a learned entry is repaired


def test_of_equal_scores_the_first_code_of_the_list_wins(spark):
    codes = [("gender", "Z", "same words"), ("gender", "A", "words same"), ("gender", "Q", "same words")]
    assert found(spark, [("gender", "same words"), ("gender", "words same")], codes) == {0: "Z", 1: "Z"}
    assert found(spark, [("gender", "same word")], codes) == {0: "Z"}
