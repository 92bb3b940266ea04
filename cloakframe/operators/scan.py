"""Sensitive spans of free text: found, deduplicated, redacted.

Every pattern runs inside the JVM; a text that a pattern does not touch costs
one test of it. Positions count code points from 0. Overlapping spans are
resolved to disjoint ones, leftmost and longest first, before redaction;
``overlapping=True`` replaces every flag on its own instead, last first.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.text import EDGE, context, matches
from cloakframe.sources.lexicon import KEYWORDS

# Patterns and labels.
DATE = EDGE + r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})" + EDGE
POSTCODE = EDGE + r"([A-Za-z]{1,2}\d[A-Za-z\d]?)\s*(\d[A-Za-z]{2})" + EDGE
PHONE = (
    r"(?:\+44\s?\d[\d\s]{8,12}|(?:" + EDGE + r"0[1-27]\d{2,3}\s?\d{3,4}\s?\d{3,4}" + EDGE + ")|" + EDGE + r"07\d{3}\s?\d{3}\s?\d{3}" + EDGE + "|" + EDGE + r"07\d{9}" + EDGE
    + "|" + EDGE + r"01\d{8,9}" + EDGE + "|" + EDGE + r"02\d{9}" + EDGE + ")"
)
EMAIL = EDGE + r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}" + EDGE
LABELS = {"name": "[REDACTED NAME]", "medical": "[ADDITIONAL NEEDS]", "safeguarding": "[REDACTED]", "family": "[PARENT/GUARDIAN]", "date": "[REDACTED DATE]", "postcode": "[REDACTED POSTCODE]", "phone": "[REDACTED PHONE]", "email": "[REDACTED EMAIL]"}
OTHER_LABEL = "[REDACTED]"
CATEGORIES = ("medical", "safeguarding", "family")
FLAG = "struct<type:string,subtype:string,value:string,position:int,context:string>"


@dataclass
class ScanConfig:
    """What to look for: names known beforehand, keyword lists, and patterns (Java dialect) with their types."""

    names: Sequence[str] = ()
    staff: Sequence[str] = ()
    keywords: Mapping[str, Sequence[str]] = field(default_factory=lambda: KEYWORDS)
    extra: Sequence[tuple[str, str]] = ()


def name_terms(names: Sequence[str]) -> list[str]:
    """Full names and their parts of two letters or more, each once whatever its case, longest first."""
    seen: dict[str, str] = {}
    for n in names:
        if n and n.strip():
            for part in (n.strip(), *(p for p in n.split() if len(p) >= 2)):
                seen.setdefault(part.lower(), part)
    return sorted(seen.values(), key=lambda x: (-len(x), x))


def alternation(terms: Sequence[str]) -> str:
    """One case-insensitive pattern for all terms, longest first."""
    return "(?i)" + EDGE + "(" + "|".join(re.escape(t) for t in sorted(terms, key=lambda x: -len(x))) + ")" + EDGE


def flags_of(text: Column, kind: str, pattern: str, subtype: str | None = None) -> Column:
    def flag(m: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), F.lit(subtype).cast("string").alias("subtype"), m["value"].alias("value"), m["position"].alias("position"),
            context(text, m["position"], F.length(m["value"])).alias("context"),
        )

    return F.transform(matches(text, pattern), flag)


def scan_names(text: Column, names: Sequence[str], staff: Sequence[str] = ()) -> Column:
    terms = name_terms([*names, *staff])
    return flags_of(text, "name", alternation(terms)) if terms else F.array().cast(f"array<{FLAG}>")


def scan_keywords(text: Column, keywords: Mapping[str, Sequence[str]] = KEYWORDS) -> Column:
    found = [flags_of(text, "keyword", alternation(list(keywords[c])), c) for c in CATEGORIES if isinstance(keywords.get(c), (list, tuple)) and keywords[c]]
    return F.concat(*found) if found else F.array().cast(f"array<{FLAG}>")


def scan_dates(text: Column) -> Column:
    return flags_of(text, "date", DATE)


def scan_postcodes(text: Column) -> Column:
    return flags_of(text, "postcode", POSTCODE)


def scan_phones(text: Column) -> Column:
    return flags_of(text, "phone", PHONE)


def scan_emails(text: Column) -> Column:
    return flags_of(text, "email", EMAIL)


def scan_extra(text: Column, extra: Sequence[tuple[str, str]]) -> Column:
    return F.concat(*(flags_of(text, kind or "custom", pattern) for pattern, kind in extra)) if extra else F.array().cast(f"array<{FLAG}>")


def deduplicate(flags: Column) -> Column:
    """By position, longer first; of one position, type and subtype only the first stays."""
    def earlier(a: Column, b: Column) -> Column:
        la, lb = F.length(a["value"]), F.length(b["value"])
        return F.when(a["position"] < b["position"], -1).when(a["position"] > b["position"], 1).when(la > lb, -1).when(la < lb, 1).otherwise(0)

    same = lambda x, y: (x["position"] == y["position"]) & (x["type"] == y["type"]) & x["subtype"].eqNullSafe(y["subtype"])
    return F.aggregate(F.array_sort(flags, earlier), F.array().cast(f"array<{FLAG}>"), lambda acc, f: F.when(F.exists(acc, lambda x: same(x, f)), acc).otherwise(F.concat(acc, F.array(f))))


def _end(chosen: Column) -> Column:
    """Where the last of the chosen flags ends, 0 if there is none."""
    last = F.try_element_at(chosen, F.lit(-1))
    return F.coalesce(last["position"] + F.length(last["value"]), F.lit(0))


def disjoint(flags: Column) -> Column:
    """The leftmost, longest flags that do not overlap, of flags in order."""
    return F.aggregate(flags, F.array().cast(f"array<{FLAG}>"), lambda acc, f: F.when(f["position"] >= _end(acc), F.concat(acc, F.array(f))).otherwise(acc))


def label(flag: Column) -> Column:
    kind = F.coalesce(flag["subtype"], flag["type"])
    out = F.lit(OTHER_LABEL)
    for k, v in LABELS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def cleaned(text: Column, flags: Column, overlapping: bool = False) -> Column:
    """The text with every flag replaced by its label, from the last to the first."""
    chosen = flags if overlapping else disjoint(flags)
    put = lambda t, f: F.concat(F.substring(t, F.lit(1), f["position"]), label(f), F.substring(t, f["position"] + F.length(f["value"]) + 1, F.length(t)))
    return F.aggregate(F.reverse(chosen), text, put)


def scan_text(text: Column, config: ScanConfig | None = None, overlapping: bool = False) -> Column:
    """Struct (flags, cleaned) of a text; null and empty texts have no flags. Stateless, so it runs on streams as well."""
    config = config or ScanConfig()
    found = F.concat(
        scan_names(text, config.names, config.staff), scan_keywords(text, config.keywords), scan_dates(text), scan_postcodes(text), scan_phones(text), scan_emails(text), scan_extra(text, config.extra)
    )
    flags = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast(f"array<{FLAG}>")).otherwise(deduplicate(found))
    return F.struct(flags.alias("flags"), F.when(text.isNull(), "").otherwise(cleaned(text, flags, overlapping)).alias("cleaned"))


def scan_table(df: DataFrame, key: str, columns: Sequence[str], config: ScanConfig | None = None) -> DataFrame:
    """One row per flag of the free-text columns: (key, column, type, subtype, value, position, context)."""
    long = df.select(F.col(key).alias("_key"), F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("text")) for c in columns))).alias("x"))
    texts = long.select("_key", "x.*").filter(F.trim("text") != "")
    found = texts.select("_key", "column", scan_text(F.col("text"), config)["flags"].alias("flags"))
    return found.select(F.col("_key").alias(key), "column", F.explode("flags").alias("f")).select(key, "column", "f.*")


def approved_only(flags: DataFrame, decisions: DataFrame, on: Sequence[str]) -> DataFrame:
    """The flags whose decision (on, accepted) is not a refusal; without a decision a flag stands."""
    return flags.join(decisions.filter("NOT accepted").select(*on), list(on), "left_anti")


def roster_hits(texts: DataFrame, key: str, text: str, roster: DataFrame, term: str) -> DataFrame:
    """(key, position, value) of the terms of a roster of any size, leftmost and longest.

    A word that begins a term, alone and with as many of the words after it as
    the longest such term has, as they are written, is joined to the roster's
    terms; no pattern of all terms is built. The parts of a hyphenated word
    count as words of their own.
    """
    token = r"[\p{L}\p{M}\p{N}_]+"
    at = texts.select(F.col(key).alias("_key"), F.col(text).alias("_t"), matches(F.col(text), token).alias("w"))
    known = roster.select(F.lower(F.trim(F.col(term))).alias("_term")).filter("_term <> ''").distinct()
    # only words that begin a term are continued, as far as their longest term goes
    pieces = F.regexp_extract_all("_term", F.lit(token), F.lit(0))
    begin = known.select(pieces.alias("p")).filter(F.size("p") > 0).groupBy(F.col("p")[0].alias("_begin")).agg(F.max(F.size("p")).alias("_most"))
    heads = at.select("_key", "_t", "w", F.posexplode("w").alias("i", "first")).join(begin, F.lower("first.value") == F.col("_begin"))
    spans = heads.select("_key", "_t", "first", F.explode(F.slice("w", F.col("i") + 1, F.col("_most"))).alias("last"))
    start = F.col("first.position")
    grams = spans.select("_key", start.alias("position"), F.substring("_t", start + 1, F.col("last.position") + F.length("last.value") - start).alias("value"))
    hits = grams.join(known, F.lower("value") == F.col("_term")).select("_key", F.struct("position", "value").alias("h"))
    order = lambda a, b: F.when(a["position"] != b["position"], a["position"] - b["position"]).otherwise(F.length(b["value"]) - F.length(a["value"]))
    per = hits.groupBy("_key").agg(F.array_sort(F.collect_set("h"), order).alias("hs"))
    none = F.array().cast("array<struct<position:int,value:string>>")
    kept = F.aggregate("hs", none, lambda acc, h: F.when(h["position"] >= _end(acc), F.concat(acc, F.array(h))).otherwise(acc))
    return per.select(F.col("_key").alias(key), F.explode(kept).alias("h")).select(key, "h.*")
