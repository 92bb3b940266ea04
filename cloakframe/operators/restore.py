"""Real identities put back into returned texts.

A response meets the mapping of its own cohort, a class sheet. Tables, prefixes
and JSON are rewritten in Arrow batches; ID tokens alone, and the search for
pseudonyms left over, also exist as joins inside the JVM.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.text import matches, nfkc

STRATEGIES = ("id-first", "json", "structured-only", "global")
RESULT = "text string, parsed string, valid boolean, unmatched array<string>, id_matches long, name_matches long"
# Fixed values.
ID_TOKEN = r"\[S\d{2,}\]"
NAME_HEADING = r"(?:student|name|pupil|student\s+name|pupil\s+name)"
SEPARATOR = r"\|[\s\-:|]+\|"


def surname_first(name: str) -> str | None:
    words = name.split()
    return f"{words[1]}, {words[0]}" if len(words) == 2 else None


def with_reversed(mapping: DataFrame, on: str) -> DataFrame:
    """(on, fake_name, real_name): the entries of a mapping and, of pseudonyms of two words, the form with the surname first.

    A form that stands for several people, or is itself an entry, is left out.
    """
    m = mapping.select(on, "fake_name", "real_name")
    words = F.split(F.trim("fake_name"), r"\s+")
    turned = m.filter(F.size(words) == 2).groupBy(on, F.concat(words[1], F.lit(", "), words[0]).alias("fake_name")).agg(F.min("real_name").alias("real_name"), F.countDistinct("real_name").alias("n"))
    new = turned.filter("n = 1").drop("n").join(m.select(on, "fake_name").distinct(), [on, "fake_name"], "left_anti")
    return m.unionByName(new).distinct()


def _any_of(names) -> str:
    return "|".join(re.escape(n) for n in sorted(names, key=lambda n: (-len(n), n)))


class Restorer:
    """One cohort's mapping, ready to rewrite texts. ``real`` names that are empty restore nothing."""

    def __init__(self, ids: dict[str, str], names: dict[str, str]) -> None:
        self.ids = {k: v for k, v in ids.items() if v}
        self.names = dict(names)
        both = dict(names)
        for fake, real in names.items():
            turned = surname_first(fake)
            if turned:
                both.setdefault(turned, real)
        self.lookup = {k.lower(): v for k, v in both.items()}
        flags = re.I | re.A
        self.combined = re.compile(rf"(?<!\w)(?:{_any_of(both)})\s*(\[S\d{{2,}}\])", flags) if both else None
        self.whole = re.compile(rf"(?<!\w)(?:{_any_of(both)})(?!\w)", flags) if both else None
        self.inside = re.compile(_any_of(names), flags) if names else None
        self.prefixed = re.compile(rf"(student:\s*)({_any_of(names)})", flags) if names else None
        self.token = re.compile(ID_TOKEN)

    def ids_in(self, text: str) -> tuple[str, int]:
        """ID tokens, with the pseudonym before them if there is one; an unknown token stays."""
        n = 0

        def put(m: re.Match) -> str:
            nonlocal n
            real = self.ids.get(m[m.lastindex or 0][1:-1])
            n += real is not None
            return m[0] if real is None else real

        if self.combined:
            text = self.combined.sub(put, text)
        return self.token.sub(put, text), n

    def _plain(self, pattern: re.Pattern | None, text: str) -> tuple[str, int]:
        return pattern.subn(lambda m: self.lookup.get(m[0].lower(), m[0]), text) if pattern else (text, 0)

    def tables(self, text: str) -> tuple[str, int]:
        """The name column of Markdown tables that have one."""
        n, column, body, out = 0, None, False, []
        for line in text.split("\n"):
            row = line.strip()
            is_row = len(row) > 1 and row.startswith("|") and row.endswith("|")
            if column is not None and body and not is_row:
                column, body = None, False
            if is_row and column is None:
                headings = [c.strip() for c in row.split("|") if c.strip()]
                column = next((i for i, c in enumerate(headings) if re.fullmatch(NAME_HEADING, c, re.I)), None)
                body = False
            elif column is not None and not body and re.fullmatch(SEPARATOR, row):
                body = True
            elif column is not None and body and is_row:
                cells = row.split("|")[1:-1]
                if column < len(cells):
                    cells[column], k = self._plain(self.inside, cells[column])
                    n += k
                    line = "|" + "|".join(cells) + "|"
            out.append(line)
        return "\n".join(out), n

    def prefixes(self, text: str) -> tuple[str, int]:
        return self.prefixed.subn(lambda m: m[1] + self.lookup.get(m[2].lower(), m[2]), text) if self.prefixed else (text, 0)

    def everywhere(self, text: str) -> tuple[str, int]:
        return self._plain(self.whole, text)

    def left(self, text: str) -> list[str]:
        low = unicodedata.normalize("NFKC", text).lower()
        return [n for n in self.names if unicodedata.normalize("NFKC", n).lower() in low]

    def walk(self, value, stats: list[int]):
        """A JSON value with its strings restored; keys stay."""
        if isinstance(value, str):
            value, a = self.ids_in(value)
            value, b = self._plain(self.inside, value)
            stats[0] += a
            stats[1] += b
            return value
        if isinstance(value, list):
            return [self.walk(v, stats) for v in value]
        if isinstance(value, dict):
            return {k: self.walk(v, stats) for k, v in value.items()}
        return value

    def __call__(self, text: str, strategy: str = "id-first") -> tuple:
        """(text, parsed, valid, unmatched, id_matches, name_matches)."""
        text = unicodedata.normalize("NFKC", text)
        valid = None
        if strategy == "json":
            try:
                stats = [0, 0]
                value = self.walk(json.loads(text), stats)
            except ValueError:
                valid = False
            else:
                return None, json.dumps(value, ensure_ascii=False), True, [], stats[0], stats[1]
        text, ids = self.ids_in(text)
        steps = {"structured-only": (self.tables, self.prefixes), "global": (self.everywhere,)}.get(strategy, (self.tables, self.prefixes, self.everywhere))
        names = 0
        for step in steps:
            text, k = step(text)
            names += k
        return text, None, valid, self.left(text), ids, names


def restore(responses: DataFrame, mapping: DataFrame, on: str, key: str, text: str = "text", strategy: str = "id-first") -> DataFrame:
    """(key, text, parsed, valid, unmatched, id_matches, name_matches) of every response.

    ``mapping``: (on, id_token, fake_name, real_name). The entries of a cohort
    are gathered once per cohort; a response without a mapping keeps its text.
    A null text stays null.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    entries = mapping.groupBy(on).agg(F.sort_array(F.collect_set(F.struct("id_token", "fake_name", F.coalesce("real_name", F.lit("")).alias("real_name")))).alias("_m"))
    rows = responses.select(F.col(key).alias("_key"), F.col(on).alias("_on"), F.col(text).alias("_text")).join(entries.withColumnRenamed(on, "_on"), "_on", "left").drop("_on")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[tuple, Restorer] = {}
        for b in batches:
            out = []
            for k, t, m in zip(b["_key"], b["_text"], b["_m"], strict=True):
                entry = tuple((x["id_token"], x["fake_name"], x["real_name"]) for x in m) if m is not None else ()
                if entry not in made:
                    if len(made) > 256:
                        made.clear()
                    made[entry] = Restorer({i: r for i, _, r in entry if i}, {f: r for _, f, r in entry if f})
                out.append((k, *(made[entry](t, strategy) if t is not None else (None, None, None, [], 0, 0))))
            yield pd.DataFrame(out, columns=["_key", "text", "parsed", "valid", "unmatched", "id_matches", "name_matches"])

    kind = dict(rows.dtypes)["_key"]
    return rows.mapInPandas(run, f"_key {kind}, {RESULT}").withColumnRenamed("_key", key)


def restore_ids(responses: DataFrame, mapping: DataFrame, on: str, key: str, text: str = "text") -> DataFrame:
    """(key, text, id_matches): bare ID tokens restored inside the JVM, by a join of tokens to the mapping.

    A text is cut at its tokens, the tokens join the mapping, and the pieces
    are put together again in order.
    """
    norm = responses.select(F.col(key).alias("_key"), F.col(on).alias("_on"), nfkc(F.col(text)).alias("t"))
    cut = norm.select("_key", "_on", "t", F.split("t", ID_TOKEN, -1).alias("between"), F.regexp_extract_all("t", F.lit(ID_TOKEN), F.lit(0)).alias("tokens"))
    each = cut.filter(F.size("tokens") > 0).select("_key", "_on", "between", F.posexplode("tokens").alias("i", "token"))
    real = mapping.filter("real_name <> ''").select(F.col(on).alias("_on"), F.concat(F.lit("["), "id_token", F.lit("]")).alias("token"), "real_name").dropDuplicates(["_on", "token"])
    joined = each.join(real, ["_on", "token"], "left").groupBy("_key").agg(
        F.first("between").alias("between"), F.sort_array(F.collect_list(F.struct("i", F.coalesce("real_name", "token").alias("put")))).alias("puts"), F.count("real_name").alias("id_matches")
    )
    whole = F.concat(F.col("between")[0], F.array_join(F.transform("puts", lambda p: F.concat(p["put"], F.col("between")[p["i"] + 1])), ""))
    done = joined.select("_key", whole.alias("text"), "id_matches")
    rest = norm.filter(~F.coalesce(F.col("t").rlike(ID_TOKEN), F.lit(False))).select("_key", F.col("t").alias("text"), F.lit(0).cast("long").alias("id_matches"))
    return done.unionByName(rest).withColumnRenamed("_key", key)


def unmatched_names(responses: DataFrame, mapping: DataFrame, on: str, key: str, text: str = "text") -> DataFrame:
    """(key, fake_name): pseudonyms of the response's cohort that its text still holds, whatever their case."""
    norm = responses.select(F.col(key).alias(key), F.col(on).alias("_on"), F.lower(nfkc(F.col(text))).alias("_t"))
    names = mapping.filter("fake_name <> ''").select(F.col(on).alias("_on"), "fake_name").distinct().withColumn("_f", F.lower(nfkc(F.col("fake_name"))))
    return norm.join(names, "_on").filter(F.col("_t").contains(F.col("_f"))).select(key, "fake_name").distinct()


def token_matches(text):
    """Array of (value, position) of the ID tokens of a text."""
    return matches(text, ID_TOKEN)


def response_tables(responses: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, group, recommendation, id, name, reason) and (key, summary) of JSON answers; what is no such JSON has no rows."""
    shape = "struct<groups:array<struct<name:string,students:array<struct<id:string,name:string,reason:string>>,recommendation:string>>,summary:string>"
    parsed = responses.select(F.col(key), F.from_json(F.col(text), shape).alias("j")).filter("j.summary IS NOT NULL OR j.groups IS NOT NULL")
    students = parsed.select(key, F.explode_outer("j.groups").alias("g")).select(key, F.col("g.name").alias("group"), "g.recommendation", F.explode_outer("g.students").alias("s"))
    return students.select(key, "group", "recommendation", "s.id", "s.name", "s.reason"), parsed.select(key, "j.summary")
