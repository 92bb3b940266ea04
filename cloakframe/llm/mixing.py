"""Problem 7: sources mixed to target weights by a time-varying curriculum.

Each source has a weight schedule over training time whose integral is its
target share. The integral times the total size is the source's cumulative
demand of tokens; a document's training position is the time at which that
demand reaches the tokens of its source that come before it. Sorting by
position in ranges gives the training order.

The total is the largest at which no source is used more often than allowed.
What a source still owes after its whole copies is filled with the documents
that fit, first in the order of a hash, then those that fit into what is left,
until it is met to NEAR or nothing fits; one long text cannot decide a share.
Shares of listed sources that have no tokens go to the others in proportion.

Defined results: sources that are not listed have share 0 and are not used;
listed sources without tokens are reported with share 0; null sources are one
unlisted source; rows of no tokens are not selected; a target share of null or
less counts as 0, repeats of null or less as 1; a source listed twice counts
once, with its largest share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.sources.tables import settle

#: Documents of one source whose running sum one task computes.
SUMMED = 100_000
#: How far a schedule may leave its mean: 0 is constant, 1 falls to nothing at one end.
TILT = 0.6
#: A source's demand counts as met when so small a part of it is open.
NEAR = 1e-4


def targets(mix: DataFrame) -> dict[str, tuple[float, int]]:
    """Source -> (share, repeats) of the list, which is short by nature and goes through the driver."""
    out: dict[str, tuple[float, int]] = {}
    for r in mix.filter("source IS NOT NULL").select("source", "target_share", "max_repeats").collect():
        share, repeats = max(r["target_share"] or 0.0, 0.0), max(r["max_repeats"] or 1, 1)
        if r["source"] not in out or out[r["source"]] < (share, repeats):
            out[r["source"]] = (share, repeats)
    return out


def demand(wanted: dict[str, tuple[float, int]], present: dict[str, int]) -> tuple[float, dict[str, float]]:
    """The largest total and each usable source's effective share of it."""
    usable = {s: p for s, (p, _) in wanted.items() if p > 0 and present.get(s, 0) > 0}
    whole = sum(usable.values())
    shares = {s: p / whole for s, p in usable.items()} if whole else {}
    total = min((wanted[s][1] * present[s] / p for s, p in shares.items()), default=0.0)
    return total, shares


def tilts(shares: dict[str, float], wanted: dict[str, tuple[float, int]], tilt: float = TILT) -> dict[str, float]:
    """Slope of each source's schedule: sources that may be repeated more come later.

    The slopes weighted by share sum to 0, so that the schedules sum to 1 at
    any time, and none exceeds the tilt.
    """
    if not shares:
        return {}
    mean = sum(p * wanted[s][1] for s, p in shares.items())
    far = max(abs(wanted[s][1] - mean) for s in shares)
    return {s: tilt * (wanted[s][1] - mean) / far if far else 0.0 for s in shares}


def inverse(u: Column, a: Column) -> Column:
    """Time at which the share ``u`` of a source's demand is met, for the schedule 1 + a * (2t - 1)."""
    root = (F.sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a)
    return F.when(F.abs(a) < 1e-9, u).otherwise(root)


def running(sized: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """The rows with ``before``: the tokens of their source that come before them, in the order of a hash.

    A source is cut into ranges of the hash of about SUMMED documents; sums
    within a range follow the sums of the ranges before it, so no source is
    ordered in one task.
    """
    cuts = F.create_map(*(F.lit(x) for s, n in sizes.items() for x in (s, max(1, math.ceil(n / SUMMED)))))
    place = (F.xxhash64("doc_id").cast("double") / F.lit(2.0**64) + 0.5).alias("place")
    rows = sized.select("*", place).withColumn("range", F.floor(F.col("place") * cuts[F.col("source")]))
    past = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "range").agg(F.sum("n_tokens").alias("n")).select("source", "range", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("offset"))
    own = Window.partitionBy("source", "range").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(offsets, ["source", "range"]).withColumn("before", F.col("inside") + F.col("offset")).drop(
        "place", "range", "inside", "offset"
    )


def mix(sized: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """(position, doc_id, source, copy, n_tokens) in training order.

    ``sized`` has doc_id, source and n_tokens. ``position`` is the number of
    tokens after which the copy is read.
    """
    rows = settle(sized.filter("n_tokens > 0 AND source IS NOT NULL").select("doc_id", "source", "n_tokens"), "sized")
    have = rows.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    wanted = targets(mix_targets)
    found = {r["source"]: (r["n"], r["docs"]) for r in have.filter(F.col("source").isin(*wanted)).collect()} if wanted else {}
    total, shares = demand(wanted, {s: n for s, (n, _) in found.items()})
    schema = "position long, doc_id long, source string, copy int, n_tokens int"
    if not shares:
        return sized.sparkSession.createDataFrame([], schema)
    slope = tilts(shares, wanted)
    want, have = {s: total * p for s, p in shares.items()}, {s: found[s][0] for s in shares}
    whole = {s: min(int(want[s] / have[s] + 1e-9), wanted[s][1]) for s in shares}
    owed = {s: want[s] - whole[s] * have[s] if whole[s] < wanted[s][1] else 0.0 for s in shares}
    used = settle(running(rows.filter(F.col("source").isin(*shares)), {s: found[s][1] for s in shares}), "running")
    full = by_source(whole, "int")
    copies = used.filter(full > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), full - 1))).withColumn("at", F.col("copy") * by_source(have, "double") + F.col("before"))
    part = filled(used, owed, want).withColumn("copy", full).withColumn("at", full * by_source(have, "double") + F.col("before"))
    chosen = copies.unionByName(part, allowMissingColumns=True)
    at = F.least(F.col("at") / by_source(want, "double"), F.lit(1.0))
    place = F.round(inverse(at, by_source(slope, "double")) * total).cast("long").alias("position")
    return chosen.select(place, "doc_id", "source", F.col("copy").cast("int").alias("copy"), "n_tokens").orderBy("position", "source", "doc_id", "copy")


def by_source(values: dict[str, float], kind: str) -> Column:
    """The value of a row's source, from the short list of sources."""
    return F.create_map(*(x for s, v in values.items() for x in (F.lit(s), F.lit(v).cast(kind))))[F.col("source")]


def filled(used: DataFrame, owed: dict[str, float], want: dict[str, float]) -> DataFrame:
    """(doc_id, source, n_tokens, before): documents of each source that together fill what it owes without exceeding it.

    Every round takes, in order, all that fits; the next one looks only at
    documents that fit into what is left, and at least the first of them does.
    """
    columns = ["doc_id", "source", "n_tokens", "before"]
    taken, left, start = None, used.select(*columns), dict.fromkeys(owed, 0)
    while True:
        gap = {s: owed[s] - start[s] for s in owed}
        marked = settle(left.withColumn("fits", F.col("before") + F.col("n_tokens") <= by_source(gap, "double")), "filling")
        fit = marked.filter("fits").withColumn("before", F.col("before") + by_source(start, "long")).select(*columns)
        taken = fit if taken is None else taken.unionByName(fit)
        for r in marked.filter("fits").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect():
            start[r["source"]] += r["n"]
        gap = {s: owed[s] - start[s] for s in owed}
        rest = marked.filter(~F.col("fits") & (F.col("n_tokens") <= by_source({s: g if g > NEAR * want[s] else 0.0 for s, g in gap.items()}, "double"))).select("doc_id", "source", "n_tokens")
        sizes = {r["source"]: r["n"] for r in rest.groupBy("source").agg(F.count("*").alias("n")).collect()}
        if not sizes:
            return taken
        left = running(rest, sizes)


def shares_reached(sized: DataFrame, mix_targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row per source, listed or present: target and reached share, tokens, documents, most copies of one document."""
    have = sized.groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.sum("n_tokens").alias("available_tokens"))
    got = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("docs"), (F.max("copy") + 1).alias("most_copies")
    )
    spark = sized.sparkSession
    listed = spark.createDataFrame([(s, p, r) for s, (p, r) in targets(mix_targets).items()], "source string, target_share double, max_repeats int")
    total = got.agg(F.sum("tokens")).first()[0] or 1
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return listed.join(have, "source", "full").join(got, "source", "left").select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), zero("max_repeats"), zero("available_tokens"), zero("tokens"), zero("docs"), zero("most_copies"),
        F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("reached_share"),
    )
