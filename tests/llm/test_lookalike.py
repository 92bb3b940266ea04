import pytest

from cloakframe.llm import lookalike

R = lookalike.Rewriter({})


@pytest.mark.parametrize(("text", "want"), [
    ("Ｇｒａｃｅ", "Grace"), ("Rose", "Rose"), ("Zoë", "Zoë"), ("a b　c", "a b c"), ("Ro​se­", "Rose"), ("Rоse", "Rose"), ("Εmуr", "Emyr"), ("eﬃcient", "efficient"),
    ("lanɡuage", "language"), ("Милица Жарковић", "Милица Жарковић"), ("angle α and π", "angle α and π"), ("x² ½ “q” – é", "x² ½ “q” – é"), ("Милицa", "Милица"), ("a  b\nc", "a  b\nc"), ("", ""), (None, None),
    ("Ro\U000e0041se", "Rose"), ("\U0001d411\U0001d428\U0001d42c\U0001d41e", "Rose"), ("\U0001d411e\u0301ne\U0001d41e\u0301", "Réneé"), ("ᎪNN", "ANN"), ("Ꮓoe", "Zoe"), ("roᴀd", "road"), ("Roſe", "Rose"), ("set ℝ of", "set ℝ of"), ("\u212aate", "Kate"), ("ᏣᎳᎩ", "ᏣᎳᎩ"),
    ("a\u0328\u0301\u200b\u00ad" * 3, "ą́" * 3), ("e\ufe0f\U000e0101x", "ex"), ("conﬁԁent", "confident"), ("Ξένια's", "Ξένια's"), ("ﬁ", "fi"), ("Łukasz", "Łukasz"), ("Å", "Å"), ("q́", "q́"),
])
def test_forms(text, want):
    assert R(text) == want


@pytest.mark.parametrize("text", ["Ｒｏｓｅ Β​ахbу", "é‍", "ﬁ ԁ", "ｅ́", "Yуki"])
def test_rewriting_twice_changes_nothing(text):
    assert R(R(text)) == R(text)


def test_frequency_chooses_between_plain_members():
    assert lookalike.Rewriter({"g": 9, "ɡ": 2})("ɡoinɡ") == "going" and lookalike.Rewriter({"g": 2, "ɡ": 9})("going") == "ɡoinɡ"
    assert lookalike.Rewriter({"у": 9, "ү": 2})("Мyр") == "Мур" and lookalike.Rewriter({"у": 2, "ү": 9})("Мyр") == "Мүр"
    assert lookalike.Rewriter({"Ｒ": 9})("Ｒose") == "Rose"  # a full-width letter is never the standard form


def test_brute_force_over_all_code_points():
    """What stands for plain text by the Unicode tables is rewritten, wherever it stands in a word."""
    import unicodedata

    for n in range(0x80, 0x110000):
        c = chr(n)
        tag, _, code = unicodedata.decomposition(c).partition("> ")
        if unicodedata.category(c)[0] == "L" and tag in ("<wide", "<font") and len(code) == 4 and int(code, 16) < 0x80:
            assert R(f"a{c}b") == f"a{chr(int(code, 16))}b", hex(n)
        elif unicodedata.category(c) == "Zs" or (0xE0020 <= n < 0xE0080):
            assert R(f"a{c}b") == ("a b" if unicodedata.category(c) == "Zs" else "ab"), hex(n)


def test_union_find_is_transitive():
    c = lookalike.Classes()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        c.join(a, b)
    assert sorted(map(sorted, c.groups())) == [["a", "b", "c", "d"], ["x", "y"]]


def test_plain_filter_never_hides_a_case(spark):
    odd = [c for a, _, _ in lookalike.edges() for c in a[-1:] if a]
    df = spark.createDataFrame([(i, f"a{c}b") for i, c in enumerate(odd)], "id long, t string")
    hidden = df.filter(df.t.rlike(lookalike.PLAIN_ONLY)).collect()
    assert [r["t"] for r in hidden if R(r["t"]) != r["t"]] == []


def test_table(spark):
    rows = [(1, "Rоse"), (2, "Rose"), (3, None), (4, ""), (5, "Ｒ" * 20_000), (1, "Rоse")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, t string, before string")
    counts = lookalike.count_characters(df.select("t"))
    assert counts["Ｒ"] == 20_000
    assert {r["id"] for r in lookalike.consistent(df, ["id"], "t", counts).collect()} == {1, 5}
    assert sorted(str(r["t"]) for r in lookalike.all_consistent(df, "t", counts).collect()) == sorted(["Rose"] * 3 + ["None", "", "R" * 20_000])
    assert lookalike.consistent(df.limit(0), ["id"], "t", {}).count() == 0
