import itertools
import random
from collections import Counter, defaultdict

import pytest

from cloakframe.llm import mixing, packing, tokens


def test_fullest_against_all_combinations():
    rng = random.Random(4)
    for _ in range(60):
        items = [rng.randint(1, 12) for _ in range(rng.randint(0, 9))]
        room = rng.randint(0, 30)
        best = max((sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room), default=0)
        got = packing.fullest(dict(Counter(items)), room)
        assert sum(x * n for x, n in got.items()) == best and all(n <= Counter(items)[x] for x, n in got.items())


def first_fit(sizes, capacity):
    items = sorted((k for n in sizes for k in [capacity] * (n // capacity) + [n % capacity] if k), reverse=True)
    free = []
    for k in items:
        i = next((i for i, f in enumerate(free) if f >= k), None)
        if i is None:
            free.append(capacity - k)
        else:
            free[i] -= k
    return len(free)


@pytest.mark.parametrize("capacity", [1, 7, 50, 512])
def test_packing_keeps_everything(spark, capacity):
    rng = random.Random(capacity)
    sizes = [0, 0, capacity, capacity + 1, 3 * capacity] + [rng.randint(1, max(2, capacity)) for _ in range(300)] + [5] * 200
    df = spark.createDataFrame([(i, n, i) for i, n in enumerate(sizes)], "doc_id long, n_tokens int, container long")
    rows = packing.pack(df, "doc_id", capacity).collect()
    used, parts = Counter(), defaultdict(list)
    for r in rows:
        used[r["container"]] += r["n_tokens"]
        parts[r["doc_id"]].append((r["start"], r["n_tokens"], r["piece"]))
    assert max(used.values()) <= capacity and sorted(used) == list(range(len(used)))
    for i, n in enumerate(sizes):
        own = sorted(parts.get(i, []))
        assert sum(k for _, k, _ in own) == n and (len(own) <= 1 or n > capacity)
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    fewest = -(-sum(sizes) // capacity)
    assert fewest <= len(used) <= first_fit(sizes, capacity)
    u = packing.usage(packing.pack(df, "doc_id", capacity), capacity).first()
    assert u["containers"] == len(used) and u["fewest"] == fewest


def test_ranks_are_complete_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    df = spark.createDataFrame([(i, 3) for i in range(100)], "doc_id long, n_tokens int")
    rows = packing.pack(df, "doc_id", 10).collect()
    assert len(rows) == 100 and max(Counter(r["container"] for r in rows).values()) == 3


def test_pack_nothing(spark):
    df = spark.createDataFrame([(1, 0)], "doc_id long, n_tokens int")
    assert packing.pack(df, "doc_id", 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "doc_id", 0)


def test_tokens(spark):
    texts = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "word " * 50_000, "x")]
    got = {r["id"]: r["n_tokens"] for r in tokens.token_counts(spark.createDataFrame(texts, "id long, t string, n_tokens string"), ["id"], "t").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 50_000


SIZED = "doc_id long, source string, n_tokens int"
TARGETS = "source string, target_share double, max_repeats int, position int"


def mixed(spark, sized, targets):
    a, b = spark.createDataFrame(sized, SIZED), spark.createDataFrame([(*t, 0) for t in targets], TARGETS)
    out = mixing.mix(a, b)
    return out.collect(), {r["source"]: r for r in mixing.shares_reached(a, b, out).collect()}


def test_shares_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SUMMED", 50)
    rng = random.Random(1)
    sized = [(i, s, rng.randint(1, 40)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 400 + ["small"] * 60 + ["other"] * 50 + [None] * 5)]
    rows, shares = mixed(spark, sized, [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 2)])
    assert {s: round(r["reached_share"], 2) for s, r in shares.items()} == {"big": 0.53, "mid": 0.32, "small": 0.16, "absent": 0.0, "other": 0.0, "(none)": 0.0}
    for (doc, source), k in Counter((r["doc_id"], r["source"]) for r in rows).items():
        assert k <= {"big": 1, "mid": 2, "small": 4}[source], doc
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    total = sum(r["n_tokens"] for r in rows)
    early = Counter()
    for r in rows:
        if r["position"] < total / 2:
            early[r["source"]] += r["n_tokens"]
    assert early["big"] / sum(early.values()) > 0.53 > 1 - early["big"] / sum(early.values())


def test_inverse_of_the_schedule(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(u / 20, a / 10) for u in range(21) for a in range(-6, 7)], "u double, a double").select("u", "a", mixing.inverse(F.col("u"), F.col("a")).alias("t")).collect()
    assert all(abs(r["t"] + r["a"] * (r["t"] ** 2 - r["t"]) - r["u"]) < 1e-9 and -1e-9 <= r["t"] <= 1 + 1e-9 for r in rows)


def test_nothing_to_mix(spark):
    assert mixed(spark, [(1, "a", 0)], [("a", 1.0, 1)])[0] == []
    assert mixed(spark, [(1, "a", 5)], [("b", 1.0, 1), (None, 0.5, 1), ("a", None, None)])[0] == []
    assert len(mixed(spark, [(1, "a", 5), (2, "a", 5)], [("a", 1.0, None), ("a", 0.5, 3)])[0]) == 2


def test_one_long_text_does_not_decide_a_share(spark):
    sized = [(i, "long", 7_000 if i == 0 else 10 + i % 3) for i in range(800)] + [(1000 + i, "even", 10) for i in range(4000)]
    rows, shares = mixed(spark, sized, [("long", 0.1, 1), ("even", 0.9, 1)])
    assert abs(shares["long"]["reached_share"] - 0.1) < 0.001 and len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    got = [r for r in rows if r["source"] == "long"]
    assert 0 not in {r["doc_id"] for r in got} and sum(r["n_tokens"] for r in got) <= 0.1 / 0.9 * 40_000 + 1
