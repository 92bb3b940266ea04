"""Problem 6: containers of fixed capacity filled with items of varying length.

Minimum bin slack: a container takes the longest item left and then the fullest
combination of the lengths still available, found by subset sums over bitsets.
How the containers look depends on the number of items of each length alone,
so the search runs on that histogram, which has at most as many entries as the
capacity, and a combination is used again until one of its lengths runs out.
Items then find their container by their rank within their length.

Defined results: an item of no tokens takes no container and has no row; an
item longer than the capacity is cut into full pieces and a rest, which is an
item like any other; no other item is cut; equal items are told apart by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.sources.tables import settle

#: Items of one length that one task ranks.
RANKED = 100_000


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """Length -> number of items of the combination with the greatest sum that fits the room, long items first."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in available.items() if n > 0 and x <= room), reverse=True):
        n, k = min(available[length], room // length), 1
        steps.append((length, reach))
        while n > 0:
            t = min(k, n)
            reach |= reach << (length * t)
            n -= t
            k *= 2
        reach &= mask
        if reach >> room & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> left & 1:
            left -= length
            n += 1
        if n:
            used[length] = n
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, items per container, first container, containers).

    Every step uses up at least one length, so there are no more combinations
    than lengths.
    """
    left = {x: n for x, n in histogram.items() if n > 0}
    given = dict.fromkeys(left, 0)
    slots, container = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        combination = fullest(rest, capacity - longest)
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[x] // n for x, n in combination.items())
        for x, n in combination.items():
            slots.append((x, given[x], n, container, times))
            given[x] += n * times
            left[x] -= n * times
            if not left[x]:
                del left[x]
        container += times
    return slots


def pieces(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, piece, start, n_tokens): the items, one per text unless it exceeds the capacity."""
    n = F.col("n_tokens")
    cut = sizes.filter(n > 0).select(key, "n_tokens", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / capacity).cast("int"))).alias("piece"))
    return cut.select(key, "piece", (F.col("piece") * capacity).alias("start"), F.least(n - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("n_tokens"))


def ranked(items: DataFrame, key: str, most: int) -> DataFrame:
    """The items with their rank (from 0) within their length.

    A frequent length is spread over buckets of about RANKED items; ranks
    within a bucket follow the number of items in the buckets before it.
    """
    buckets = max(1, math.ceil(most / RANKED))
    spread = items.withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spread.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n")).select("n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("n_tokens", "bucket").orderBy(key, "piece")
    return spread.withColumn("r", F.row_number().over(own)).join(offsets, ["n_tokens", "bucket"]).withColumn("rank", F.col("r") - 1 + F.col("offset")).drop("r", "bucket", "offset")


def pack(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """(container, key, piece, start, n_tokens): every item in its container.

    ``start`` is the item's first token within its text. The histogram and the
    slots, at most some per length, are all that the driver sees.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    items = settle(pieces(sizes, key, capacity), "items")
    histogram = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    slots = np.array(sorted(plan(histogram, capacity)) or [(0, 0, 1, 0, 0)], dtype=np.int64)
    ranks = ranked(items, key, max(histogram.values(), default=1))
    width = max(histogram.values(), default=1) + 1
    starts = slots[:, 0] * width + slots[:, 1]
    columns = ["container", key, "piece", "start", "n_tokens"]

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rank = b["rank"].to_numpy()
            slot = slots[np.searchsorted(starts, b["n_tokens"].to_numpy().astype(np.int64) * width + rank, side="right") - 1]
            b["container"] = slot[:, 3] + (rank - slot[:, 1]) // slot[:, 2]
            yield b[columns]

    kind = dict(items.dtypes)[key]
    return ranks.mapInPandas(place, f"container long, `{key}` {kind}, piece int, start int, n_tokens int")


def usage(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, the fewest that any packing needs, tokens, and the share of unused room."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens")).select(
        F.lit(capacity).alias("capacity"), "containers", F.ceil(F.col("tokens") / capacity).alias("fewest"), "tokens", (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused")
    )
