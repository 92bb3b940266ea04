"""Problem 5: free-entered values mapped to a canonical list.

The reference entries are the codes and labels of the list and what the corpus
itself shows to be another way of writing a code: a frequent value whose rows
describe the same thing (the same pupil) as other rows that hold that code
exactly, more often than chance allows. Each distinct value is cut into tokens;
each distinct token is joined to the vocabulary of the entries by edit distance
(one edit, two in tokens of seven letters or more), found through shared
deletion variants, so that no pair without a common variant is ever formed. The
corrected tokens are then weighed by soft TF-IDF and the complete entries
ranked; a value's letters without spaces count as one more token, which repairs
split and joined words.

Defined results: a null or blank value has no row; a value that is exactly a
code of its field has no row; a value without letters or digits, or whose best
entry scores under ``THRESHOLD``, is ``UNMATCHED``; of equal scores the entry
whose code is first in the reference list wins; repeated rows give one row and
count once as evidence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.sources.tables import settle

#: field -> code -> further spellings of it.
Aliases = dict[str, dict[str, tuple[str, ...]]]

UNMATCHED = "UNMATCHED"
THRESHOLD = 0.7
#: Letters from which a token may take two edits.
TWO_EDITS = 7

#: Least agreement of a value's companions on one code, the odds against its coming by chance, and the value's frequency beside the
#: code's most frequent one that make it another way of writing the code.
AGREE, ODDS, FREQUENT = 0.9, 1000.0, 0.1


def plain(value: Column) -> Column:
    """Lower case, dots and brackets gone, other separators as single spaces; ``/`` stays within a token."""
    v = F.regexp_replace(F.lower(value), r"&", " and ")
    v = F.regexp_replace(v, r"[.()\[\]'’\"]", "")
    return F.trim(F.regexp_replace(v, r"[^\p{L}\p{N}%/]+", " "))


def tokens(value: Column) -> Column:
    return F.filter(F.array_distinct(F.split(plain(value), " ")), lambda t: t.rlike(r"[\p{L}\p{N}]"))


def joined(value: Column) -> Column:
    return F.regexp_replace(plain(value), " ", "")


def deletions(token: Column) -> Column:
    """The token and what is left of it when one letter (two in a long one) is deleted."""
    def once(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    one = F.when(F.length(token) >= 3, once(token)).otherwise(F.array(token))
    two = F.when(F.length(token) >= TWO_EDITS, F.flatten(F.transform(one, once))).otherwise(F.array(token))
    return F.array_distinct(F.concat(F.array(token), one, two))


def similar_tokens(left: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(field, token, entry_token, sim) of the tokens that are one another after few edits.

    A swap of neighbouring letters counts as one edit. A token more than two
    letters longer than any of the vocabulary cannot match and is not varied.
    """
    longest = vocabulary.agg(F.max(F.length("token"))).first()[0] or 0
    left = left.filter(F.length("token") <= longest + 2)
    a = left.select("field", "token", F.explode(deletions(F.col("token"))).alias("part"))
    b = vocabulary.select("field", F.col("token").alias("entry_token"), F.explode(deletions(F.col("token"))).alias("part"))
    pairs = a.join(b, ["field", "part"]).select("field", "token", "entry_token").distinct()
    swap = (F.length("token") == F.length("entry_token")) & (F.array_sort(F.split("token", "")) == F.array_sort(F.split("entry_token", "")))
    far = F.levenshtein("token", "entry_token")
    edits = F.when(swap & (far == 2), 1).otherwise(far)
    size = F.greatest(F.length("token"), F.length("entry_token"))
    most = F.when(size >= TWO_EDITS, 2).when(size >= 3, 1).otherwise(0)
    return pairs.withColumn("edits", edits).filter(F.col("edits") <= most).select("field", "token", "entry_token", (1 - F.col("edits") / size).alias("sim"))


def codes_of(canon: DataFrame) -> DataFrame:
    """(field, code, label, place) of the reference list, a short table whose order counts and which goes through the driver."""
    rows = [(i, r["field_name"], r["code"], r["label"]) for i, r in enumerate(canon.select("field_name", "code", "label").collect()) if r["field_name"] is not None and r["code"] is not None]
    return canon.sparkSession.createDataFrame(rows, "place int, field string, code string, label string")


def learned_entries(rows: DataFrame, exact: DataFrame, codes: DataFrame) -> DataFrame:
    """(field, entry, code): frequent values that stand for a code, by the exact codes of the same thing.

    ``rows`` has (same, field, value), ``exact`` (same, field, code). Each thing
    is one unit of evidence, however many rows it has; both sides are counted
    before they meet, so a thing with a third of all rows costs a few.
    """
    said = rows.filter("same IS NOT NULL").groupBy("same", "field", plain(F.col("value")).alias("entry")).agg(F.count("*").alias("n")).filter("entry <> ''")
    held = exact.filter("same IS NOT NULL").groupBy("same", "field", "code").agg(F.count("*").alias("n"))
    units = held.groupBy("same", "field").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("codes"))
    share = F.explode(F.transform(F.map_entries("codes"), lambda e: F.struct(e["key"].alias("code"), (e["value"] / F.col("all")).alias("w"))))
    prior = units.select("field", share.alias("x")).groupBy("field", "x.code").agg(F.sum("x.w").alias("w"))
    prior = prior.join(prior.groupBy("field").agg(F.sum("w").alias("all")), "field").select("field", "code", (F.col("w") / F.col("all")).alias("p"))
    seen = said.join(units, ["same", "field"]).select("field", "entry", share.alias("x")).groupBy("field", "entry", "x.code").agg(F.sum("x.w").alias("w"))
    often = said.groupBy("field", "entry").agg(F.sum("n").alias("n"))
    best = seen.groupBy("field", "entry").agg(F.max_by("code", "w").alias("code"), F.max("w").alias("w"), F.sum("w").alias("units")).join(prior, ["field", "code"]).join(often, ["field", "entry"])
    q, p = F.least(F.col("w") / F.col("units"), F.lit(1.0)), F.least(F.col("p"), F.lit(1 - 1e-9))
    # how far the companions' agreement is from what any value would show: units times the divergence of the two shares
    gain = q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    sure = settle(best.filter((q >= AGREE) & (q > p) & (F.col("units") * gain >= math.log(ODDS))).select("field", "entry", "code", "n"), "sure")
    most = sure.groupBy("field", "code").agg(F.max("n").alias("most"))
    return sure.join(most, ["field", "code"]).filter(F.col("n") >= FREQUENT * F.col("most")).select("field", "entry", "code")


def reference_entries(codes: DataFrame, learned: DataFrame | None = None, aliases: Aliases | None = None) -> DataFrame:
    """(field, entry, code, place): codes and labels of the list, entries learned from the corpus, and spellings that the caller gives.

    Of an entry with several codes, the list's own counts before the others, then the first in the list.
    """
    out = codes.select("field", "code", F.explode(F.array("code", "label")).alias("entry"), F.lit(0).alias("source"))
    if aliases:
        more = [(f, c, w) for f, given in aliases.items() for c, ws in given.items() for w in ws]
        out = out.unionByName(codes.sparkSession.createDataFrame(more, "field string, code string, entry string").withColumn("source", F.lit(1)))
    if learned is not None:
        out = out.unionByName(learned.select("field", "code", "entry", F.lit(2).alias("source")))
    placed = out.filter("entry IS NOT NULL").join(codes.select("field", "code", "place"), ["field", "code"])
    first = F.min(F.struct("source", "place", "code")).alias("x")
    return placed.groupBy("field", plain(F.col("entry")).alias("entry")).agg(first).select("field", "entry", "x.code", "x.place").filter("entry <> ''")


def map_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(field, value, code, score) of each distinct (field, value); ``entries`` are (field, entry, code, place), a written table.

    The steps are written as they are made: they are small, each is read
    several times, and the plans stay short.
    """
    parts = entries.select("field", "entry", "code", "place", F.explode(tokens(F.col("entry"))).alias("entry_token"))
    total = settle(entries.groupBy("field").agg(F.count("*").alias("total")), "totals")
    idf = settle(
        parts.groupBy("field", "entry_token").agg(F.countDistinct("entry").alias("df")).join(total, "field").select("field", "entry_token", F.log(1 + F.col("total") / F.col("df")).alias("idf")), "idf"
    )
    parts = parts.join(idf, ["field", "entry_token"])
    norm = parts.groupBy("field", "entry").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    parts = settle(parts.join(norm, ["field", "entry"]), "parts")

    base = settle(values.select("field", "value").distinct(), "values")
    said = base.select("field", "value", F.explode(tokens(F.col("value"))).alias("token"))
    sims = settle(similar_tokens(said.select("field", "token").distinct(), idf.select("field", F.col("entry_token").alias("token"))), "similar")
    # the value's own length: a token of unknown meaning weighs as much as the rarest known one
    best = sims.join(idf, ["field", "entry_token"]).groupBy("field", "token").agg(F.max_by("idf", "sim").alias("w"))
    weighed = settle(said.join(best, ["field", "token"], "left").join(total, "field").select("field", "value", "token", F.coalesce("w", F.log(1 + F.col("total"))).alias("w")), "weighed")
    length = weighed.groupBy("field", "value").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    soft = settle(
        weighed.join(sims, ["field", "token"]).join(parts, ["field", "entry_token"])
        .groupBy("field", "value", "entry", "code", "place", "norm", "entry_token").agg(F.max(F.col("sim") * F.col("w") * F.col("idf")).alias("dot"))
        .groupBy("field", "value", "entry", "code", "place", "norm").agg(F.sum("dot").alias("dot"))
        .join(length, ["field", "value"])
        .select("field", "value", "code", "place", F.least(F.col("dot") / (F.col("norm") * F.col("length")), F.lit(1.0)).alias("score")), "soft",
    )
    wholes = base.select("field", "value", joined(F.col("value")).alias("token")).filter("token <> ''")
    ends = entries.select("field", "code", "place", joined(F.col("entry")).alias("entry_token"))
    whole = (
        similar_tokens(wholes.select("field", "token").distinct(), ends.select("field", F.col("entry_token").alias("token")).distinct())
        .join(wholes, ["field", "token"]).join(ends, ["field", "entry_token"])
        .select("field", "value", "code", "place", F.col("sim").alias("score"))
    )
    ranked = soft.unionByName(whole).filter(F.col("score") >= THRESHOLD).groupBy("field", "value").agg(
        F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("place")).alias("order"), F.col("code"))).alias("x")
    )
    return base.join(ranked, ["field", "value"], "left").select(
        "field", "value", F.coalesce("x.code", F.lit(UNMATCHED)).alias("code"), F.coalesce("x.score", F.lit(0.0)).alias("score")
    )


def entered(records: DataFrame, codes: DataFrame, fields: tuple[str, ...], same: tuple[str, ...] = ()) -> DataFrame:
    """(record_id, same, field, value, code) of the entries that are not blank; ``code`` is null unless the value is exactly a code.

    ``same`` is the hash of the columns that tell which thing a row describes, null where one of them is.
    """
    key = F.when(F.greatest(*(F.col(c).isNull() for c in same), F.lit(False)), None).otherwise(F.xxhash64(*same)) if same else F.lit(None).cast("long")
    long = records.select("record_id", key.alias("same"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("x")).select("record_id", "same", "x.*")
    return long.filter(F.col("value").rlike(r"\S")).join(codes.select("field", F.col("code").alias("value"), "code"), ["field", "value"], "left")


def canonical(records: DataFrame, canon: DataFrame, fields: tuple[str, ...] = ("gender", "sen"), same: tuple[str, ...] = ("class_id", "pupil_name"), aliases: Aliases | None = None) -> DataFrame:
    """(record_id, field_name, code) of every entry that is not already a code.

    Rows that agree in the columns ``same`` describe the same thing; without
    such columns nothing is learned from the corpus. ``aliases`` are further
    spellings of a caller's own. Values are counted before the shuffle; what
    comes back is one row per distinct spelling, joined by whichever side
    sizes allow.
    """
    codes = settle(codes_of(canon), "codes")
    all_ = entered(records, codes, fields, same)
    rows = all_.filter("code IS NULL").select("record_id", "same", "field", "value")
    learned = learned_entries(rows, all_.filter("code IS NOT NULL"), codes) if same else None
    entries = settle(reference_entries(codes, learned, aliases), "entries")
    mapped = map_values(rows.groupBy("field", "value").count(), entries)
    return rows.join(mapped, ["field", "value"]).select("record_id", F.col("field").alias("field_name"), "code").distinct()
