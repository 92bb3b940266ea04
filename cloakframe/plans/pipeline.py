"""The whole anonymisation of a table (E7): strip, profile, scan, pseudonyms, noise, shuffle, guard, bands, risk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators import columns, profile, pseudonym, risk, scan
from cloakframe.operators.noise import noised_table
from cloakframe.operators.order import numbered
from cloakframe.sources.lexicon import KEYWORDS, name_bank
from cloakframe.sources.tables import settle

ORDER = "_ord"


@dataclass
class Config:
    """``scale`` mode, the usual one, serves tables of any size; ``exact`` draws names, noise and shuffle in one seeded sequence and serves a class."""

    seed: int = 42
    mode: str = "scale"
    noise: bool = False
    gender_mode: str = "aware"
    k: int | str = "auto"
    noise_share: float = 0.05
    noise_maximum: float = 100.0
    noise_boundaries: Sequence[float] | None = None
    strip_identifiers: bool = False
    one_way: bool = False
    redact: bool = False
    staff: Sequence[str] = ()
    keywords: Mapping[str, Sequence[str]] = field(default_factory=lambda: KEYWORDS)
    extra_patterns: Sequence[tuple[str, str]] = ()
    bank: Mapping[str, Sequence[str]] | None = None
    name: str | None = None
    gender: str | None = None
    numeric: tuple[str, ...] | None = None


@dataclass
class Anonymised:
    """Lazy parts of the result; ``rows`` has ``_ord``, the row's new place."""

    rows: DataFrame
    mapping: DataFrame | None
    flags: DataFrame
    detected: DataFrame
    perturbation_failures: DataFrame
    risk: risk.RiskReport


def _exact(df: DataFrame, r: profile.Roles, blocked: DataFrame, config: Config) -> tuple[DataFrame, DataFrame, int]:
    """Rows with pseudonyms and ``_n``, their place; the mapping; the draws used. One cohort: a class sheet."""
    every = {x.lower() for v in (config.bank or name_bank()).values() for x in v}
    taken = [x["token"] for x in blocked.filter(F.col("token").isin(*every)).collect()]
    mapping = settle(pseudonym.exact(df, r.name, ORDER, config.seed, None, r.gender, config.gender_mode, taken, config.bank), "mapping")
    used = mapping.agg(F.max("draws")).first()[0] or 0
    placed = numbered(df, [ORDER], "_n")
    cell = F.concat("fake_name", F.lit(" ["), "id_token", F.lit("]"))
    named = placed.join(mapping.select(F.col("ord").alias("_n"), "fake_name", "id_token"), "_n").withColumn(r.name, cell).drop("fake_name", "id_token")
    return named, mapping.drop("draws", "cohort"), used


def anonymise(df: DataFrame, config: Config | None = None) -> Anonymised:
    """``df`` is a table of strings with ``_ord``, the order of its rows (read() tables get one from numbered())."""
    config = config or Config()
    if config.mode not in ("exact", "scale"):
        raise ValueError(f"unknown mode: {config.mode}")
    headers = [c for c in df.columns if c != ORDER]
    if config.strip_identifiers:
        headers = columns.strip_identifiers(df.select(*headers)).columns
        df = df.select(*headers, ORDER)
    cells = df.select(*headers)
    detected, r = profile.profile(cells), profile.roles(cells, config.name, config.gender, config.numeric)

    # names known from the table are looked for as words, so a roster may have any size
    texts = df.select(ORDER, *r.free_text)
    flags = scan.scan_table(texts, ORDER, list(r.free_text), scan.ScanConfig(staff=config.staff, keywords=config.keywords, extra=config.extra_patterns)) if r.free_text else None
    roster = df.select(pseudonym.normal_name_order(F.col(r.name)).alias("n")).select(F.explode(F.concat(F.array("n"), F.filter(F.split("n", r"\s+"), lambda x: F.length(x) >= 2))).alias("term"))
    for c in r.free_text:
        hits = scan.roster_hits(texts, ORDER, c, roster, "term")
        own = hits.join(texts.select(ORDER, F.col(c).alias("_t")), ORDER).select(
            ORDER, F.lit(c).alias("column"), F.lit("name").alias("type"), F.lit(None).cast("string").alias("subtype"), "value", "position",
            scan.context(F.col("_t"), F.col("position"), F.length("value")).alias("context"),
        )
        flags = flags.unionByName(own)
    if flags is None:
        flags = df.sparkSession.createDataFrame([], f"{ORDER} {dict(df.dtypes)[ORDER]}, column string, type string, subtype string, value string, position int, context string")
    flags = settle(flags.dropDuplicates([ORDER, "column", "position", "type", "subtype"]), "flags")

    if config.redact:
        df = settle(redacted(df, flags, list(r.free_text)), "redacted")
    blocked = pseudonym.blocked_tokens(df, r.name, flags, config.staff)
    if config.mode == "exact":
        named, mapping, used = _exact(df, r, blocked, config)
    else:
        full = pseudonym.scale(df, r.name, [ORDER], config.seed, blocked, config.bank)
        mapping, named, used = full.select("ord", "id_token", "fake_name", "real_name"), pseudonym.replaced(full, r.name).withColumnRenamed("ord", "_n"), 2
    named = settle(named, "named")
    failures = df.sparkSession.createDataFrame([], "column string, failures long")
    if config.noise:
        named, failures, used = noised_table(named, r.numeric, ["_n"], config.seed, used, config.noise_maximum, config.noise_share, config.noise_boundaries)
    if config.mode == "exact":
        order = pseudonym.exact_shuffle(named.count(), config.seed, used)
        places = df.sparkSession.createDataFrame([(old + 1, new) for new, old in enumerate(order)] or [(0, 0)], "_n long, _place long")
        placed = named.join(places, "_n")
    else:
        placed = pseudonym.shuffled(named, ["_n"], config.seed, used).withColumn("_place", F.col("position") - 1)
    out = settle(columns.sanitised(placed.select(*headers, F.col("_place").alias(ORDER))), "anonymised")
    banded, grades, attendances = risk.with_bands(out, r.numeric, config.noise_boundaries or risk.GRADE_BOUNDARIES)
    attributes = risk.quasi_identifiers(r.categorical, r.gender, grades, attendances)
    report = risk.analyse(banded, attributes, [*r.categorical, *grades, *attendances], ORDER, config.k)
    return Anonymised(out, None if config.one_way else mapping, flags, detected, failures, report)


def redacted(df: DataFrame, flags: DataFrame, texts: list[str]) -> DataFrame:
    """The table with the flags of each free text replaced by their labels, overlaps resolved leftmost and longest."""
    for c in texts:
        per = flags.filter(F.col("column") == c).groupBy(F.col(ORDER).alias("_k")).agg(F.collect_list(F.struct("type", "subtype", "value", "position", "context")).alias("_f"))
        kept = scan.cleaned(F.col(c), scan.deduplicate(F.col("_f")))
        df = df.join(per, df[ORDER] == F.col("_k"), "left").withColumn(c, F.when(F.col("_f").isNull(), F.col(c)).otherwise(kept)).drop("_k", "_f")
    return df
