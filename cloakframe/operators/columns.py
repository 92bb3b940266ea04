"""Columns dropped, redacted or withheld before anything else sees them."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.text import sanitise

REDACTED = "[REMOVED]"
#: Headings of identifiers that identify a person by themselves.
IDENTIFIER_HEADINGS = (
    r"\bupn\b", r"\buln\b", r"\bdob\b", r"\bdate\s*of\s*birth\b", r"\bpostcode\b", r"\bemail\b", r"\bphone\b", r"\bnhs\b", r"\baddress\b", r"\bcandidate\s*no\b", r"\badmission\s*no\b",
)


def heading_matches(heading: str, patterns: Iterable[str]) -> bool:
    return any(re.search(p, heading, re.I) for p in patterns)


def identifier_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if heading_matches(c, IDENTIFIER_HEADINGS)]


def strip_identifiers(df: DataFrame) -> DataFrame:
    """The table without identifier columns, decided while the plan is built."""
    gone = set(identifier_columns(df))
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in gone))


def apply_actions(df: DataFrame, actions: dict[str, str]) -> DataFrame:
    """``keep``, ``remove`` or ``redact`` each column; columns without an action are kept."""
    unknown = set(actions.values()) - {"keep", "remove", "redact"}
    if unknown:
        raise ValueError(f"unknown column action: {sorted(unknown)}")
    return df.select(*(F.lit(REDACTED).alias(c) if actions.get(c) == "redact" else F.col(f"`{c}`") for c in df.columns if actions.get(c) != "remove"))


def sanitised(df: DataFrame) -> DataFrame:
    """All string columns guarded against formulas."""
    return df.select(*(sanitise(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


def preview(df: DataFrame, order: str, rows: int = 8) -> tuple[DataFrame, DataFrame]:
    """The first rows in order, and one row with the number of those left out."""
    return df.orderBy(order).limit(rows), df.agg(F.greatest(F.count("*") - rows, F.lit(0)).alias("remaining"))
