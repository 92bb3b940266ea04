"""Queries that cover whole tables, against counts made in plain Python."""

import re
from collections import Counter

from cloakframe.plans import core

DATA = "/root/testdata/sf0.001"


def test_cohorts_hold_every_customer(spark):
    rows = core.table(spark, DATA, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal").collect()
    want = Counter(f"{r[0]}/{r[1]}/{int(float(r[2]) // 1000)}" for r in rows)
    got = core.QUERIES["g8_cohort_tiers_all"](spark, DATA).collect()
    assert {r["cohort"]: r["rows"] for r in got} == want and sum(want.values()) == len(rows)
    assert all(r["small"] == (r["rows"] < 15) for r in got)


def test_every_address_of_a_comment(spark):
    pattern = re.compile(core._PATTERNS["email"], re.ASCII)
    rows = core.table(spark, DATA.replace("0.001", "0.01"), "pupil_records").select("record_id", "comments").filter("comments IS NOT NULL").distinct().collect()
    want = {(r[0], m[0], m.start()) for r in rows for m in pattern.finditer(r[1])}
    got = core.QUERIES["d8_email_contexts"](spark, DATA.replace("0.001", "0.01")).collect()
    assert {(r["record_id"], r["value"], r["position"]) for r in got} == want and len(want) > len({x[0] for x in want})
    text = dict(map(tuple, rows))
    for r in got:
        a, b, t = r["position"], r["position"] + len(r["value"]), text[r["record_id"]]
        assert r["context"] == "..." * (a > 15) + t[max(a - 15, 0) : b + 15] + "..." * (b + 15 < len(t))
