"""One query per operator of the inventory, and its SQL where SQL can express it.

A query's name begins with the inventory's letter and number. Every query runs
over its whole tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions import numeric, text
from cloakframe.functions.prng import draw
from cloakframe.operators import columns, profile, prompt, pseudonym, restore, risk, scan
from cloakframe.operators.noise import noised_column
from cloakframe.operators.order import numbered
from cloakframe.plans import pipeline
from cloakframe.sources import csv
from cloakframe.sources.lexicon import GENERALISATIONS, KEYWORDS, name_bank
from cloakframe.sources.tables import shared_folder, table

SEED = 42
QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def pupils(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pupil_records")


def long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


def sql_draw(seed: int, rows: str, n: str) -> str:
    """CTEs ``_x`` .. ``drawn`` that add column u, draw number n, to the rows."""
    m = 4294967296
    return f"""_x AS (SELECT *, (({seed} + {n}::HUGEINT * 1831565813) % {m})::BIGINT AS x FROM {rows}),
_t AS (SELECT *, ((xor(x, x >> 15)::HUGEINT * (x | 1)) % {m})::BIGINT AS t FROM _x),
_v AS (SELECT *, xor(t, ((t + xor(t, t >> 7)::HUGEINT * (t | 61)) % {m})::BIGINT) AS v FROM _t),
drawn AS (SELECT * EXCLUDE (x, t, v), xor(v, v >> 14) / {m}.0::DOUBLE AS u FROM _v)"""


_WHITE = " || ".join(f"chr({ord(c)})" for c in text.SPACES)


# --- A, B: sources, guards, derived columns

_SHEET = 'Name,Score,Notes\n"Ray, Jo",71,"said ""ok"""\n\nLi Wen, 64 ,=1+1\n'


@query("SELECT * FROM (VALUES ('Ray, Jo', '71', 'said \"ok\"', 0::BIGINT), ('Li Wen', ' 64 ', '=1+1', 1::BIGINT)) t(name, score, notes, ord)")
def a1_parse_csv(spark, d):
    return csv.from_text(spark, _SHEET).select(F.col("Name").alias("name"), F.col("Score").alias("score"), F.col("Notes").alias("notes"), F.col("_ord").alias("ord"))


@query("SELECT n_regionkey::BIGINT AS region, 'key,name' || chr(13) || chr(10) || string_agg(n_nationkey || ',' || CASE WHEN n_name LIKE '% %' AND n_name LIKE '%,%' THEN '\"' || n_name || '\"' ELSE n_name END, chr(13) || chr(10) ORDER BY n_nationkey) AS csv FROM nation GROUP BY 1")
def a6_csv_text(spark, d):
    rows = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return prompt.csv_text(rows, ["key", "name"], "key", "n_regionkey").select(F.col("n_regionkey").cast("long").alias("region"), "csv")


@query("SELECT s_suppkey AS supplier, CASE WHEN regexp_matches(v, '^[=+\\-@\\t\\r\\n]') THEN '''' || v ELSE v END AS cell FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '' ELSE '@' END || s_name AS v FROM supplier)")
def a7_sanitise(spark, d):
    n = F.col("s_suppkey") % 4
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.concat(F.when(n == 0, "=").when(n == 1, "-").when(n == 2, "").otherwise("@"), "s_name").alias("cell"))
    return columns.sanitised(rows)


@query("SELECT record_id, '[REMOVED]' AS pupil_name, sen, school_id FROM (SELECT DISTINCT record_id, sen, school_id FROM pupil_records)")
def b3_column_actions(spark, d):
    rows = pupils(spark, d).select("record_id", "pupil_name", "sen", "school_id", "comments")
    return columns.apply_actions(rows, {"pupil_name": "redact", "comments": "remove"}).distinct()


@query("SELECT DISTINCT c_custkey, c_mktsegment FROM customer")
def b2_strip_identifiers(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.col("c_name").alias("Date of Birth"), F.col("c_acctbal").alias("NHS number"))
    return columns.strip_identifiers(rows).distinct()


_SCORES = "(SELECT record_id, score_pct, attendance_pct, TRY_CAST(nullif(regexp_extract(score_pct, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE) AS s, TRY_CAST(nullif(regexp_extract(attendance_pct, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE) AS a FROM pupil_records)"


@query(f"SELECT s AS number, count(*) AS rows FROM {_SCORES} GROUP BY 1")
def b10_parse_float(spark, d):
    return pupils(spark, d).groupBy(numeric.parse_float(F.col("score_pct")).alias("number")).agg(F.count("*").alias("rows"))


@query(f"SELECT CASE WHEN s IS NULL THEN '' WHEN s < 40 THEN '0-39' WHEN s < 50 THEN '40-49' WHEN s < 60 THEN '50-59' WHEN s < 70 THEN '60-69' WHEN s < 80 THEN '70-79' WHEN s < 90 THEN '80-89' ELSE '90+' END AS band, count(*) AS rows FROM {_SCORES} GROUP BY 1")
def b6_grade_band(spark, d):
    return pupils(spark, d).groupBy(numeric.grade_band(numeric.parse_float(F.col("score_pct"))).alias("band")).agg(F.count("*").alias("rows"))


@query(f"SELECT CASE WHEN a IS NULL THEN '' WHEN a < 80 THEN '<80%' WHEN a < 90 THEN '80-89%' WHEN a < 95 THEN '90-94%' ELSE '95%+' END AS band, count(*) AS rows FROM {_SCORES} GROUP BY 1")
def b7_attendance_band(spark, d):
    return pupils(spark, d).groupBy(numeric.attendance_band(numeric.parse_float(F.col("attendance_pct"))).alias("band")).agg(F.count("*").alias("rows"))


@query(f"""WITH s AS (SELECT {_WHITE} AS w), p AS (SELECT DISTINCT record_id, pupil_name AS n, trim(split_part(pupil_name, ',', 1), w) AS a, trim(substr(pupil_name, strpos(pupil_name, ',') + 1), w) AS b FROM pupil_records, s)
SELECT record_id, CASE WHEN strpos(n, ',') > 0 AND a <> '' AND b <> '' THEN b || ' ' || a ELSE n END AS name FROM p""")
def b8_name_order(spark, d):
    return pupils(spark, d).select("record_id", text.normal_name_order(F.col("pupil_name")).alias("name")).distinct()


# --- C: profile

_COLUMNS = ("school_id", "term", "pupil_name", "gender", "sen", "pp", "eal", "score_pct", "attendance_pct", "comments")
_TRIM = "trim(coalesce({c}, ''), " + _WHITE + ")"
_CELLS = "_c AS (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS i, '{c}' AS name, {_TRIM.format(c=c)} AS t FROM pupil_records" for i, c in enumerate(_COLUMNS)) + ")"
_W = r"[.''\-]*[A-Za-z](?:[A-Za-z''\-]*[A-Za-z])?[.''\-]*"
_PLAIN = "trim(replace(t, ',', ''), " + _WHITE + ")"
_STATS = f"""WITH {_CELLS}, _f AS (SELECT *, lower(t) IN ('absent', 'n/a', 'x', '-') AS exception,
  length(t) BETWEEN 3 AND 50 AND regexp_full_match({_PLAIN}, '{_W}(?:\\s+{_W}){{1,3}}') AND regexp_matches(regexp_replace({_PLAIN}, '[^A-Za-z\\s]', '', 'g'), '[A-Za-z]{{3}}') AS is_name,
  regexp_matches(t, '{"|".join("(?:" + p + ")" for p in profile.DATE_SHAPES)}') AS is_date,
  lower(t) NOT IN ('absent', 'n/a', 'x', '-') AND (regexp_matches(t, '{numeric.WHOLE}') OR regexp_full_match(t, '\\d+(?:\\.\\d+)?%')) AS is_number FROM _c WHERE t <> ''),
_s AS (SELECT i, any_value(name) AS name, count(*)::DOUBLE AS n, avg(is_name::INT) AS name_share, avg(is_date::INT) AS date_share,
  CASE WHEN sum(is_number::INT) > 0 THEN sum(is_number::INT + exception::INT)::DOUBLE / count(*) ELSE 0 END AS number_share, count(DISTINCT lower(t)) AS distinct_cells, avg(length(t)) AS mean_length FROM _f GROUP BY i)"""


@query(_STATS + "SELECT i AS index, name, n::BIGINT AS filled, round(name_share, 9) AS name_share, round(date_share, 9) AS date_share, round(number_share, 9) AS number_share, distinct_cells, round(mean_length, 6) AS mean_length FROM _s")
def c7_column_scores(spark, d):
    s = profile.column_scores(pupils(spark, d), list(_COLUMNS))
    return s.select(*long("index"), "name", *long("filled"), *(F.round(c, 9).alias(c) for c in ("name_share", "date_share", "number_share")), *long("distinct_cells"), F.round("mean_length", 6).alias("mean_length"))


_MIS = " OR ".join(f"name = '{c}'" for c in _COLUMNS if profile.is_mis_categorical(c)) or "false"


def _boost(kind: str, column: str) -> str:
    names = ", ".join(f"'{c}'" for c in _COLUMNS if profile.boosted(c, kind))
    return f"CASE WHEN name IN ({names}) THEN least(1, {column} + 0.1) ELSE {column} END" if names else column


@query(_STATS + f""", _g AS (SELECT *, {_boost("name", "name_share")} AS s1, {_boost("date", "date_share")} AS s2, {_boost("numerical", "number_share")} AS s3,
  CASE WHEN {_MIS} THEN least(1, c0 + 0.25) ELSE c0 END AS s4, {_boost("free-text", "f0")} AS s5 FROM (SELECT *,
  CASE WHEN distinct_cells / n < 0.3 AND mean_length < 20 THEN 1 - distinct_cells / n WHEN distinct_cells / n < 0.5 AND mean_length < 20 THEN 0.5 ELSE 0 END AS c0,
  CASE WHEN mean_length > 30 AND distinct_cells / n > 0.7 THEN least(1, distinct_cells / n * CASE WHEN mean_length > 50 THEN 1 ELSE 0.9 END) WHEN mean_length > 20 AND distinct_cells / n > 0.5 THEN 0.5 ELSE 0 END AS f0 FROM _s)),
_k AS (SELECT *, CASE WHEN s1 >= 0.9 THEN 'name' WHEN s2 >= 0.8 THEN 'date' WHEN s3 >= 0.75 THEN 'numerical' WHEN s4 >= 0.75 THEN 'categorical' WHEN s5 >= 0.85 THEN 'free-text'
  WHEN greatest(s1, s2, s3, s4, s5) = 0 THEN 'categorical' WHEN s1 = greatest(s1, s2, s3, s4, s5) THEN 'name' WHEN s2 = greatest(s2, s3, s4, s5) THEN 'date' WHEN s3 = greatest(s3, s4, s5) THEN 'numerical' WHEN s4 >= s5 THEN 'categorical' ELSE 'free-text' END AS type FROM _g),
_z AS (SELECT *, CASE type WHEN 'name' THEN s1 WHEN 'date' THEN s2 WHEN 'numerical' THEN s3 WHEN 'categorical' THEN s4 ELSE s5 END AS v, CASE type WHEN 'name' THEN 0.9 WHEN 'date' THEN 0.8 WHEN 'free-text' THEN 0.85 ELSE 0.75 END AS need FROM _k)
SELECT i AS index, name, type, floor(v * 100 + 0.5)::DOUBLE / 100 AS confidence, v < need AS review FROM _z""")
def c9_column_profile(spark, d):
    p = profile.profile(pupils(spark, d), list(_COLUMNS))
    return p.select(*long("index"), "name", "type", "confidence", F.col("reviewRequired").alias("review"))


# --- D: scanning

_PATTERNS = {
    "date": r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\b",
    "postcode": r"\b([A-Za-z]{1,2}\d[A-Za-z\d]?)\s*(\d[A-Za-z]{2})\b",
    "phone": r"(?:\+44\s?\d[\d\s]{8,12}|(?:\b0[1-27]\d{2,3}\s?\d{3,4}\s?\d{3,4}\b)|\b07\d{3}\s?\d{3}\s?\d{3}\b|\b07\d{9}\b|\b01\d{8,9}\b|\b02\d{9}\b)",
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
}


def _values_sql(kind: str) -> str:
    return f"SELECT record_id, value, count(*) AS n FROM (SELECT record_id, unnest(regexp_extract_all(comments, '{_PATTERNS[kind]}')) AS value FROM pupil_records) GROUP BY 1, 2"


def _values(spark, d, flags) -> DataFrame:
    return pupils(spark, d).select("record_id", F.explode(flags(F.col("comments"))).alias("f")).groupBy("record_id", F.col("f.value").alias("value")).agg(F.count("*").alias("n"))


@query(_values_sql("date"))
def d3_scan_dates(spark, d):
    return _values(spark, d, scan.scan_dates)


@query(_values_sql("postcode"))
def d4_scan_postcodes(spark, d):
    return _values(spark, d, scan.scan_postcodes)


@query(_values_sql("phone"))
def d5_scan_phones(spark, d):
    return _values(spark, d, scan.scan_phones)


@query(_values_sql("email"))
def d6_scan_emails(spark, d):
    return _values(spark, d, scan.scan_emails)


_WORDS = KEYWORDS


def _alternatives(words) -> str:
    return "(?i)\\b(?:" + "|".join(w.replace("-", "\\-") for w in sorted(words, key=lambda x: -len(x))) + ")\\b"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(" UNION ALL ".join(f"SELECT record_id, '{c}' AS category, value, count(*) AS n FROM (SELECT record_id, unnest(regexp_extract_all(comments, '{_quoted(_alternatives(_WORDS[c]))}')) AS value FROM pupil_records) GROUP BY 1, 3" for c in _WORDS))
def d2_scan_keywords(spark, d):
    rows = pupils(spark, d).select("record_id", F.explode(scan.scan_keywords(F.col("comments"), _WORDS)).alias("f"))
    return rows.groupBy("record_id", F.col("f.subtype").alias("category"), F.col("f.value").alias("value")).agg(F.count("*").alias("n"))


@query()
def d1_scan_names(spark, d):
    """Every mention of a pupil's or teacher's name, found by a join of words to the roster of all names."""
    names = pupils(spark, d).select(F.col("pupil_name").alias("n")).unionByName(table(spark, d, "staff").select(F.col("staff_name").alias("n"))).distinct()
    terms = names.select(F.explode(F.concat(F.array("n"), F.filter(F.split("n", r"\s+"), lambda x: F.length(x) >= 2))).alias("term"))
    texts = pupils(spark, d).select("record_id", "comments").distinct()
    return scan.roster_hits(texts, "record_id", "comments", terms, "term")


@query(f"""WITH f AS (SELECT DISTINCT record_id, comments, regexp_extract(comments, '{_PATTERNS["email"]}') AS v FROM pupil_records WHERE regexp_matches(comments, '{_PATTERNS["email"]}')),
p AS (SELECT *, strpos(comments, v) - 1 AS p, length(comments) AS n FROM f)
SELECT record_id, v AS value, p::BIGINT AS position, CASE WHEN p > 15 THEN '...' ELSE '' END || substr(comments, greatest(p - 15, 0) + 1, least(p + length(v) + 15, n) - greatest(p - 15, 0)) || CASE WHEN p + length(v) + 15 < n THEN '...' ELSE '' END AS context FROM p""")
def d8_email_context(spark, d):
    f = F.element_at(scan.scan_emails(F.col("comments")), 1)
    return pupils(spark, d).filter(F.col("comments").rlike(scan.EMAIL)).select("record_id", f.alias("f")).select("record_id", "f.value", F.col("f.position").cast("long").alias("position"), "f.context").distinct()


@query()
def d8_email_contexts(spark, d):
    """Every address of a comment with its context, where d8_email_context has the first."""
    rows = pupils(spark, d).select("record_id", F.explode(scan.scan_emails(F.col("comments"))).alias("f"))
    return rows.select("record_id", "f.value", F.col("f.position").cast("long").alias("position"), "f.context").distinct()


@query(f"SELECT DISTINCT record_id, regexp_replace(comments, '{_PATTERNS['email']}', '[REDACTED EMAIL]', 'g') AS cleaned FROM pupil_records WHERE comments IS NOT NULL")
def d10_redact_emails(spark, d):
    c = F.col("comments")
    return pupils(spark, d).filter(c.isNotNull()).select("record_id", scan.cleaned(c, scan.scan_emails(c)).alias("cleaned")).distinct()


@query("SELECT type, subtype, sum(n)::BIGINT AS flags FROM (" + " UNION ALL ".join(
    [f"SELECT '{k}' AS type, '' AS subtype, len(regexp_extract_all(comments, '{p}')) AS n FROM pupil_records" for k, p in _PATTERNS.items()]
    + [f"SELECT 'keyword', '{c}', len(regexp_extract_all(comments, '{_quoted(_alternatives(_WORDS[c]))}')) FROM pupil_records" for c in _WORDS]
) + ") GROUP BY 1, 2 HAVING sum(n) > 0")
def d12_flags_by_type(spark, d):
    rows = pupils(spark, d).select("comments").withColumn("row", F.monotonically_increasing_id())
    flags = scan.scan_table(rows, "row", ["comments"], scan.ScanConfig(keywords=_WORDS))
    return flags.groupBy("type", F.coalesce("subtype", F.lit("")).alias("subtype")).agg(F.count("*").alias("flags"))


# --- E: pseudonyms

@query("SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(lower(trim(c_name)), '\\s+')) AS token FROM customer) WHERE token <> ''")
def e1_blocked_tokens(spark, d):
    return pseudonym.blocked_tokens(table(spark, d, "customer"), "c_name")


@query("SELECT CASE WHEN g IN ('m', 'male') THEN 'male' WHEN g IN ('f', 'female') THEN 'female' WHEN g IN ('x', 'non-binary', 'nonbinary', 'other') THEN 'neutral' ELSE 'all' END AS list, count(*) AS rows FROM (SELECT lower(trim(gender)) AS g FROM pupil_records) GROUP BY 1")
def e2_first_name_list(spark, d):
    return pupils(spark, d).groupBy(pseudonym.first_name_list(F.col("gender")).alias("list")).agg(F.count("*").alias("rows"))


@query("SELECT c_custkey AS customer, 'S' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS id_token FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)")
def e4_id_tokens(spark, d):
    rows = numbered(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], "n")
    return rows.select(F.col("c_custkey").alias("customer"), pseudonym.id_token(F.col("n")).alias("id_token"))


@query()
def e5_exact_pseudonyms(spark, d):
    """Pseudonyms of every class sheet, a class in a term, in exact mode."""
    rows = pupils(spark, d).dropDuplicates(["record_id"]).select("record_id", "pupil_name", "gender", F.concat_ws("/", "class_id", "term").alias("sheet"))
    return pseudonym.exact(rows, "pupil_name", "record_id", SEED, "sheet", "gender").drop("draws")


def _bank_sql() -> tuple[str, str, int, int, int]:
    bank = name_bank()
    first, last = [*dict.fromkeys([*bank["male"], *bank["female"], *bank["neutral"]])], [*dict.fromkeys(bank["surnames"])]
    a, b = pseudonym.affine(len(first) * len(last), SEED)
    rows = lambda xs: ", ".join(f"({i}, '{x}')" for i, x in enumerate(xs))
    return rows(first), rows(last), a, b, len(last)


_FIRST, _LAST, _A, _OFFSET, _N = _bank_sql()
_PAIRS = (_FIRST.count("(")) * _N


@query(f"""WITH f(i, f) AS (VALUES {_FIRST}), l(i, l) AS (VALUES {_LAST}), o AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier),
p AS (SELECT *, (n % {_PAIRS} * {_A} + {_OFFSET}) % {_PAIRS} AS slot FROM o)
SELECT s_suppkey AS supplier, n AS ord, 'S' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS id_token, f || ' ' || l AS fake_name, s_name AS real_name FROM p JOIN f ON f.i = (slot - slot % {_N}) / {_N} JOIN l ON l.i = slot % {_N}""")
def e5_scale_pseudonyms(spark, d):
    return pseudonym.scale(table(spark, d, "supplier"), "s_name", ["s_suppkey"], SEED).select(F.col("s_suppkey").alias("supplier"), *long("ord"), "id_token", "fake_name", "real_name")


@query(f"WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS n FROM part), {sql_draw(SEED, 'o', 'n')} SELECT p_partkey AS part, row_number() OVER (ORDER BY u, n) AS position FROM drawn")
def e6_shuffle(spark, d):
    return pseudonym.shuffled(table(spark, d, "part").select("p_partkey"), ["p_partkey"], SEED).select(F.col("p_partkey").alias("part"), *long("position"))


@query()
def e7_anonymise(spark, d):
    """The whole pipeline over all records in scale mode, with noise and redaction."""
    rows = pupils(spark, d).dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("_ord"), F.col("pupil_name").alias("Name"), F.col("gender").alias("Gender"), F.col("pp").alias("PP"), F.col("eal").alias("EAL"),
        F.col("score_pct").alias("Score (%)"), F.col("attendance_pct").alias("Attendance (%)"), F.col("comments").alias("Comments"),
    )
    return pipeline.anonymise(rows, pipeline.Config(noise=True, redact=True)).rows


_GUARDED = "CASE WHEN regexp_matches({c}, '^[=+\\-@\\t\\r\\n]') THEN chr(39) || {c} ELSE coalesce({c}, '') END"


@query(f"""WITH l AS (SELECT record_id, min(pupil_name) AS n, min(gender) AS gender, min(pp) AS pp, min(score_pct) AS score FROM pupil_records GROUP BY 1),
q AS (SELECT {_GUARDED.format(c='gender')} AS g, {_GUARDED.format(c='pp')} AS p, TRY_CAST(nullif(regexp_extract({_GUARDED.format(c='score')}, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE) AS s FROM l),
k AS (SELECT count(*) AS n FROM q GROUP BY g, p, CASE WHEN s IS NULL THEN '' WHEN s < 40 THEN '0-39' WHEN s < 50 THEN '40-49' WHEN s < 60 THEN '50-59' WHEN s < 70 THEN '60-69' WHEN s < 80 THEN '70-79' WHEN s < 90 THEN '80-89' ELSE '90+' END)
SELECT 3::BIGINT AS threshold, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (n >= 3), 0)::BIGINT AS safe FROM k""")
def e7_risk_of_anonymised(spark, d):
    """Risk left after the pipeline; of repeated deliveries each field counts with its least value."""
    least = [F.min(c).alias(a) for c, a in (("pupil_name", "Name"), ("gender", "Gender"), ("pp", "PP"), ("score_pct", "Score (%)"))]
    rows = pupils(spark, d).groupBy(F.col("record_id").alias("_ord")).agg(*least)
    return pipeline.anonymise(rows, pipeline.Config(keywords={})).risk.summary.select(*long("threshold", "total", "safe"))


# --- F: draws and noise

@query(f"WITH o AS (SELECT p_partkey AS part FROM part), {sql_draw(SEED, 'o', 'part')} SELECT part, u FROM drawn")
def f1_draws(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("part"), draw(SEED, F.col("p_partkey")).alias("u"))


@query("SELECT s_suppkey AS supplier, sign(x) * floor(abs(x) + 0.5) AS rounded FROM (SELECT s_suppkey, s_acctbal / 8 AS x FROM supplier)")
def f3_round_half_away(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), numeric.round_half_away(F.col("s_acctbal") / 8).alias("rounded"))


@query("SELECT l_quantity AS quantity, min(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 10 ELSE 25 END)::DOUBLE AS lower, min(CASE WHEN l_quantity < 10 THEN 10 WHEN l_quantity < 25 THEN 25 ELSE 51 END)::DOUBLE AS upper FROM lineitem GROUP BY 1")
def f5_noise_band(spark, d):
    band = numeric.noise_band(F.col("l_quantity"), (10, 25), 50)
    return table(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), band["lower"].alias("lower"), band["upper"].alias("upper")).distinct()


_LINES = "o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)"
_MOVED = f"""WITH {_LINES}, {sql_draw(SEED, 'o', 'n')},
z AS (SELECT *, q + greatest(least(CASE WHEN u = 0.5 THEN 0 WHEN u = 0 THEN -2.5 ELSE -1.25 * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)) END, 2.5), -2.5) AS y FROM drawn),
r AS (SELECT *, sign(y) * floor(abs(y) + 0.5) AS m FROM z)"""


@query(_MOVED + "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, greatest(least(m, 50), 0)::DOUBLE AS noised FROM r")
def f7_noise(spark, d):
    rows = table(spark, d, "lineitem")
    out = noised_column(rows, "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], SEED, maximum=50.0)
    return out.select("l_orderkey", *long("l_linenumber"), "l_partkey", F.col("l_quantity").alias("noised"))


@query(_MOVED + """, b AS (SELECT *, CASE WHEN q < 10 THEN 0 WHEN q < 11 THEN 10 WHEN q < 25 THEN 11 ELSE 25 END AS lo, CASE WHEN q < 10 THEN 10 WHEN q < 11 THEN 11 WHEN q < 25 THEN 25 ELSE 51 END - 1 AS hi FROM r)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, CASE WHEN hi - lo < 1 THEN q ELSE least(greatest(m, lo), hi) END::DOUBLE AS noised, hi - lo < 1 AS failed FROM b""")
def f6_bounded_noise(spark, d):
    rows = table(spark, d, "lineitem")
    out = noised_column(rows, "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], SEED, maximum=50.0, boundaries=(10, 11, 25))
    return out.select("l_orderkey", *long("l_linenumber"), "l_partkey", F.col("l_quantity").alias("noised"), "failed")


# --- G: risk

def _customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.floor(F.col("c_acctbal") / 1000).alias("thousands"))


_CUSTOMERS = "(SELECT c_custkey, c_nationkey::VARCHAR AS nation, c_mktsegment AS segment, floor(c_acctbal / 1000)::BIGINT::VARCHAR AS thousands FROM customer)"


@query(f"SELECT nation, segment, thousands, count(*) AS count FROM {_CUSTOMERS} GROUP BY 1, 2, 3 HAVING count(*) < 3")
def g2_k_anonymity_groups(spark, d):
    return risk.small_groups(_customers(spark, d), ["nation", "segment", "thousands"], 3)


@query(f"SELECT 'nation=' || nation || ', segment=' || segment || ', thousands=' || thousands AS described, count(*) AS count, string_agg(c_custkey, ',' ORDER BY c_custkey) AS row_ids FROM {_CUSTOMERS} GROUP BY nation, segment, thousands HAVING count(*) < 3")
def g2_group_rows(spark, d):
    rows = risk.small_group_rows(_customers(spark, d), ["nation", "segment", "thousands"], 3, "c_custkey")
    return rows.select("described", "count", F.concat_ws(",", F.transform("row_ids", lambda x: x.cast("string"))).alias("row_ids"))


@query(f"SELECT 3::BIGINT AS threshold, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (n >= 3), 0)::BIGINT AS safe FROM (SELECT count(*) AS n FROM {_CUSTOMERS} GROUP BY nation, segment, thousands)")
def g1_k_summary(spark, d):
    rows = _customers(spark, d)
    return risk.k_summary(rows, ["nation", "segment", "thousands"], risk.chosen_k(rows)).select(*long("threshold", "total", "safe"))


_RARE = "SELECT {i}::BIGINT AS \"column\", '{c}' AS columnName, coalesce({e}, '') AS value, count(*) AS count FROM {t} GROUP BY 3 HAVING count(*) < 3"


@query(" UNION ALL ".join(_RARE.format(i=i, c=c, e=c, t="pupil_records") for i, c in enumerate(("gender", "sen"))))
def g3_rare_categories(spark, d):
    return risk.rare_values(pupils(spark, d), ["gender", "sen"], 5).select(*long("column"), "columnName", "value", "count")


_KNOWN = "g(place, category, v, suggestion) AS (VALUES " + ", ".join(f"({i}, '{c.lower()}', '{v.lower()}', '{s}')" for i, (c, v, s) in enumerate((c, v, s) for c, m in GENERALISATIONS.items() for v, s in m.items())) + ")"


@query(f"WITH {_KNOWN}, r AS (" + " UNION ALL ".join(_RARE.format(i=i, c=n, e=e, t="(SELECT lower(sen) AS sen, upper(pp) AS pp, trim(gender) AS gender FROM pupil_records)") for i, (n, e) in enumerate((("SEN", "sen"), ("PP", "pp"), ("Status", "gender")))) + """)
SELECT "column", columnName, value, count, CASE WHEN EXISTS (SELECT 1 FROM g WHERE category = lower(columnName)) THEN (SELECT arg_min(suggestion, place) FROM g WHERE category = lower(columnName) AND v = lower(value))
ELSE (SELECT arg_min(suggestion, place) FROM g WHERE v = lower(value)) END AS suggestion FROM r""")
def g4_rare_with_generalisation(spark, d):
    rows = pupils(spark, d).select(F.lower("sen").alias("SEN"), F.upper("pp").alias("PP"), F.trim("gender").alias("Status"))
    return risk.with_suggestions(risk.rare_values(rows, ["SEN", "PP", "Status"], 5)).select(*long("column"), "columnName", "value", "count", "suggestion")


@query(f"""WITH q AS (SELECT nation, segment, thousands, count(*) AS n FROM {_CUSTOMERS} GROUP BY 1, 2, 3), t AS (SELECT sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (n >= 3), 0)::BIGINT AS safe FROM q),
r AS ({_RARE.format(i=0, c='nation', e='nation', t=_CUSTOMERS)} UNION ALL {_RARE.format(i=1, c='thousands', e='thousands', t=_CUSTOMERS)})
SELECT 0::BIGINT AS part, safe || ' of ' || total || ' students are in groups of 3+. ' || (total - safe) || ' student' || CASE WHEN total - safe = 1 THEN ' has' ELSE 's have' END || ' attribute combinations shared by fewer than 3 others.' AS text FROM t
UNION ALL SELECT 1, 'Group (nation=' || nation || ', segment=' || segment || ', thousands=' || thousands || '): ' || n || ' student' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' — consider generalising or suppressing distinguishing attributes.' FROM q WHERE n < 3
UNION ALL SELECT 2, 'Rare category in "' || columnName || '": "' || value || '" appears only ' || count || ' time' || CASE WHEN count = 1 THEN '' ELSE 's' END || '.' FROM r""")
def g5_recommendations(spark, d):
    report = risk.analyse(_customers(spark, d), ["nation", "segment", "thousands"], ["nation", "thousands"], "c_custkey", 3)
    return report.recommendations.select(*long("part"), "text")


@query("SELECT nation, rows, CASE WHEN rows < 12 THEN 'high' WHEN rows < 20 THEN 'medium' ELSE 'low' END AS tier, rows < 15 AS small FROM (SELECT c_nationkey::BIGINT AS nation, count(*) AS rows FROM customer GROUP BY 1)")
def g8_cohort_tiers(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), "c_mktsegment")
    return risk.cohorts(rows, "nation")


@query("SELECT cohort, rows, CASE WHEN rows < 12 THEN 'high' WHEN rows < 20 THEN 'medium' ELSE 'low' END AS tier, rows < 15 AS small FROM (SELECT c_nationkey || '/' || c_mktsegment || '/' || floor(c_acctbal / 1000)::BIGINT AS cohort, count(*) AS rows FROM customer GROUP BY 1)")
def g8_cohort_tiers_all(spark, d):
    """Tiers of all customers by nation, segment and balance band."""
    key = F.concat_ws("/", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).cast("long"))
    return risk.cohorts(table(spark, d, "customer").select(key.alias("cohort"), "c_mktsegment"), "cohort")


@query(f"SELECT subset, count(*) AS groups, count(*) FILTER (n < 3) AS small_groups, coalesce(sum(n) FILTER (n < 3), 0)::BIGINT AS exposed_rows FROM (SELECT concat_ws(',', CASE WHEN grouping(nation) = 0 THEN 'nation' END, CASE WHEN grouping(segment) = 0 THEN 'segment' END, CASE WHEN grouping(thousands) = 0 THEN 'thousands' END) AS subset, count(*) AS n FROM {_CUSTOMERS} GROUP BY CUBE (nation, segment, thousands)) GROUP BY 1")
def g_attribute_cube(spark, d):
    return risk.attribute_cube(_customers(spark, d), ["nation", "segment", "thousands"], 3)


# --- H: restoration

def _restored(spark, d, strategy: str) -> DataFrame:
    out = restore.restore(table(spark, d, "responses"), table(spark, d, "name_mappings"), "upload_id", "response_id", "text", strategy)
    return out.select("response_id", "text", "parsed", "valid", F.concat_ws("|", "unmatched").alias("unmatched"), "id_matches", "name_matches")


@query()
def h10_restore_id_first(spark, d):
    return _restored(spark, d, "id-first")


@query()
def h11_restore_json(spark, d):
    return _restored(spark, d, "json")


@query()
def h12_restore_structured(spark, d):
    return _restored(spark, d, "structured-only")


@query()
def h13_restore_global(spark, d):
    return _restored(spark, d, "global")


@query("SELECT upload_id, fake_name, real_name FROM name_mappings UNION SELECT upload_id, split_part(fake_name, ' ', 2) || ', ' || split_part(fake_name, ' ', 1), any_value(real_name) FROM name_mappings m WHERE len(string_split_regex(trim(fake_name), '\\s+')) = 2 GROUP BY 1, 2 HAVING count(DISTINCT real_name) = 1")
def h2_reversed_names(spark, d):
    """Mapping entries and their surname-first forms; an ambiguous form is left out."""
    return restore.with_reversed(table(spark, d, "name_mappings"), "upload_id")


# --- I: prompts

@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + t[k].replace("'", "''") + "'" for k in prompt.SUMMARY) + ")" for t in prompt.TEMPLATES) + ") t(" + ", ".join(f'"{k}"' for k in prompt.SUMMARY) + ")")
def i1_templates(spark, d):
    return prompt.list_templates(spark)


_ANSWERS = {"subject": "Year 9 English", "tone": "encouraging", "wordCount": "100"}
_BEFORE, _AFTER, _STRATEGY = (x.replace("'", "''") for x in prompt.frame("write-report-comments", _ANSWERS))


@query(f"SELECT r_name AS region, '{_BEFORE}' || chr(10) || 'name,key' || chr(13) || chr(10) || string_agg(n_name || ',' || n_nationkey, chr(13) || chr(10) ORDER BY n_nationkey) || chr(10) || '{_AFTER}' AS prompt, '{_STRATEGY}' AS strategy FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def i5_prompts(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    return prompt.assemble(rows, "write-report-comments", _ANSWERS, ["name", "key"], "key", "region")


@query("SELECT r_name AS region, 'all' AS \"group\", 'S' || n_nationkey AS id, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def i6_response_tables(spark, d):
    student = F.struct(F.concat(F.lit("S"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("r").alias("reason"))
    per = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list(student).alias("students"))
    answer = F.to_json(F.struct(F.array(F.struct(F.lit("all").alias("name"), "students", F.lit("x").alias("recommendation"))).alias("groups"), F.lit("s").alias("summary")))
    return restore.response_tables(per.select(F.col("r_name").alias("region"), answer.alias("text")), "region")[0].select("region", "group", "id", "name")


# --- streams (extensions)

@query("SELECT response_id, (coalesce(len(regexp_extract_all(text, '" + _PATTERNS["email"] + "')), 0) + coalesce(len(regexp_extract_all(text, '" + _PATTERNS["phone"] + "')), 0) + coalesce(len(regexp_extract_all(text, '" + _PATTERNS["date"] + "')), 0) + coalesce(len(regexp_extract_all(text, '" + _PATTERNS["postcode"] + "')), 0))::BIGINT AS flags FROM responses")
def s_scanned_stream(spark, d):
    """Responses read as a stream, scanned, and written until the stream has no more."""
    from cloakframe.streaming import scanned

    schema = table(spark, d, "responses").schema
    out = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = scanned(spark.readStream.schema(schema).parquet(f"{d}/responses.parquet*"), "text", scan.ScanConfig(keywords={})).select("response_id", F.size("flags").cast("long").alias("flags"))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)

