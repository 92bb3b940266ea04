"""Further queries of the inventory with their SQL: sources, roles, flags with positions, noise on mixed cells, passes of restoration, templates."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import text
from cloakframe.operators import columns, profile, prompt, restore, risk, scan
from cloakframe.operators.noise import noised_column, noised_table
from cloakframe.plans import core
from cloakframe.plans.core import SEED, long, pupils, sql_draw
from cloakframe.sources import csv, lexicon
from cloakframe.sources.tables import shared_folder, table

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- A, B: sources, roles, previews

@query("SELECT r_regionkey::VARCHAR AS key, r_name AS name, '' AS note, row_number() OVER (ORDER BY r_regionkey) - 1 AS ord FROM region")
def a2_in_memory_table(spark, d):
    """Rows held in memory (five regions), one cell short, as a table of strings."""
    rows = sorted((r["r_regionkey"], r["r_name"]) for r in table(spark, d, "region").collect())
    return csv.from_rows(spark, ["key", "name", "note"], rows).withColumnRenamed("_ord", "ord")


@query("SELECT s_suppkey::VARCHAR AS key, s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier")
def a3_strict_ingest(spark, d):
    """A table written as CSV and read again, failing on anything that does not parse."""
    path = folder(spark, "strict")
    csv.write(table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")), path)
    return csv.read(spark, path, strict=True)


@query("SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS value FROM nation")
def a4_whole_file(spark, d):
    """One text file (of 25 nations) read as a whole."""
    path = folder(spark, "whole")
    table(spark, d, "nation").orderBy("n_nationkey").select("n_name").coalesce(1).write.text(path)
    return csv.read_whole(spark, f"{path}/*.txt").select("value")


@query("""SELECT * FROM (VALUES (0, 'Asha Woldar', 'F', 'No', '42', '74', 'Lost focus after lunch on 01/03/2025'), (1, 'Brin Woldbr', 'M', 'No', '47', '77', ''), (2, 'Corin Woldcr', 'F', 'K', '52', '80', ''),
(3, 'Dalia Wolddr', 'M', 'K', '57', '83', 'Lost focus after lunch on 04/03/2025'), (4, 'Edwy Wolder', 'F', 'EHCP', '62', '86', ''), (5, 'Fenna Woldfr', 'M', 'No', '67', '89', ''), (6, 'Goran Woldgr', 'F', 'No', '72', '92', 'Lost focus after lunch on 07/03/2025'),
(7, 'Hesper Woldhr', 'M', 'K', '77', '95', '')) t(ord, name, gender, sen, score, attendance, comments)""")
def a5_sample_sheet(spark, d):
    s = csv.sample(spark)
    return s.select(F.col("_ord").cast("int").alias("ord"), *(F.col(f"`{a}`").alias(b) for a, b in (("Name", "name"), ("Gender", "gender"), ("SEN", "sen"), ("Score (%)", "score"), ("Attendance (%)", "attendance"), ("Comments", "comments"))))


@query("SELECT * FROM (VALUES ('female', 100::BIGINT, 0), ('male', 100::BIGINT, 0), ('neutral', 50::BIGINT, 0), ('surnames', 500::BIGINT, 0)) t(list, names, _z) WHERE false UNION ALL SELECT * FROM (VALUES ('EAL', 9::BIGINT, 0), ('LAC', 10::BIGINT, 0), ('PP', 9::BIGINT, 0), ('SEN', 12::BIGINT, 0), ('medical', 10::BIGINT, 0)) t(list, names, _z)")
def a8_generalisations(spark, d):
    """Entries of each category of the built-in list of generalisations."""
    return lexicon.generalisations_table(spark).groupBy(F.col("category").alias("list")).agg(F.count("*").alias("names")).withColumn("_z", F.lit(0))


_KEPT = ("gender", "sen", "score_pct", "comments")


@query(f"SELECT (row_number() OVER (ORDER BY index) - 1)::BIGINT AS index, name, type, confidence, review FROM ({core.SQL['c9_column_profile']}) WHERE name IN ({', '.join(repr(c) for c in _KEPT)})")
def b1_columns_removed(spark, d):
    """What is detected anew after columns were removed."""
    left, found = profile.without(pupils(spark, d).select(*core._COLUMNS), [c for c in core._COLUMNS if c not in _KEPT])
    assert left.columns == list(_KEPT) or set(left.columns) == set(_KEPT)
    return found.select(*long("index"), "name", "type", "confidence", F.col("reviewRequired").alias("review"))


@query("SELECT record_id, length(comments)::BIGINT AS n FROM (SELECT DISTINCT record_id, comments FROM pupil_records) WHERE trim(comments, ' ') <> ''")
def b4_filled_texts(spark, d):
    """The cells that a scan looks at: blank and null ones are left out."""
    everything = scan.ScanConfig(keywords={}, extra=((r"(?s)\A.*\z", "all"),))
    rows = scan.scan_table(pupils(spark, d).select("record_id", "comments").distinct(), "record_id", ["comments"], everything)
    return rows.filter("type = 'all'").select("record_id", F.length("value").cast("long").alias("n"))


@query(f"""WITH p AS ({core.SQL['c9_column_profile']})
SELECT 'name' AS role, coalesce((SELECT arg_min(name, index) FROM p WHERE type = 'name'), 'school_id') AS name UNION ALL SELECT 'gender', 'gender' UNION ALL SELECT 'numeric', name FROM p WHERE type = 'numerical'
UNION ALL SELECT 'free_text', name FROM p WHERE type = 'free-text' OR regexp_matches(name, '(?i)comment|note|remark') UNION ALL SELECT 'categorical', name FROM p WHERE type = 'categorical'""")
def b5_roles(spark, d):
    r = profile.roles(pupils(spark, d).select(*core._COLUMNS))
    rows = [("name", r.name), ("gender", r.gender), *(("numeric", c) for c in r.numeric), *(("free_text", c) for c in r.free_text), *(("categorical", c) for c in r.categorical)]
    return spark.createDataFrame(rows, "role string, name string")


@query("(SELECT c_custkey::VARCHAR AS customer FROM customer ORDER BY c_custkey LIMIT 8) UNION ALL SELECT greatest(count(*) - 8, 0) || ' more' FROM customer")
def b9_preview(spark, d):
    """The first eight rows (the feature) and how many are left out."""
    first, rest = columns.preview(table(spark, d, "customer").select("c_custkey"), "c_custkey")
    return first.select(F.col("c_custkey").cast("string").alias("customer")).unionByName(rest.select(F.concat("remaining", F.lit(" more")).alias("customer")))


@query(r"""SELECT h AS heading, regexp_matches(h, '(?i)\b(?:upn|uln|dob|date\s*of\s*birth|postcode|email|phone|nhs|address|candidate\s*no|admission\s*no)\b') AS sensitive, count(*) AS uploads FROM (SELECT unnest(headers) AS h FROM uploads) GROUP BY 1""")
def c1_sensitive_headings(spark, d):
    """Every heading handed in, whether it is an identifier's, and how often it occurs."""
    heads = table(spark, d, "uploads").select(F.explode("headers").alias("heading")).groupBy("heading").agg(F.count("*").alias("uploads"))
    return heads.select("heading", profile.sensitive(F.col("heading")).alias("sensitive"), "uploads")


# --- D: flags with positions

_LISTS = {c: core._alternatives(w) for c, w in lexicon.KEYWORDS.items()}


def _esc(pattern: str) -> str:
    return pattern.replace("'", "''")


def _at(kind: str, subtype: str | None, pattern: str) -> str:
    """Matches of one pattern with their positions: what stands between them is as long as the pieces of a split."""
    p = _esc(pattern)
    return f"""SELECT record_id, comments, '{kind}' AS type, {"NULL" if subtype is None else repr(subtype)}::VARCHAR AS subtype, v[i] AS value,
  (list_sum(list_transform(b[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[:i - 1], lambda x: length(x))), 0))::INT AS position
  FROM (SELECT record_id, comments, v, b, unnest(range(1, len(v) + 1)) AS i FROM (SELECT record_id, comments, regexp_extract_all(comments, '{p}') AS v, string_split_regex(comments, '{p}') AS b FROM c) WHERE len(v) > 0)"""


_FLAGS = "WITH c AS (SELECT DISTINCT record_id, comments FROM pupil_records WHERE trim(comments, ' ') <> ''), f AS (" + " UNION ALL ".join(
    [_at("keyword", c, p) for c, p in _LISTS.items()] + [_at(k, None, p) for k, p in core._PATTERNS.items()]
) + ")"
_PLAIN_FLAGS = "WITH c AS (SELECT DISTINCT record_id, comments FROM pupil_records WHERE trim(comments, ' ') <> ''), f AS (" + " UNION ALL ".join(_at(k, None, p) for k, p in core._PATTERNS.items()) + ")"


def _all_flags(spark, d) -> DataFrame:
    return scan.scan_table(pupils(spark, d).select("record_id", "comments").distinct(), "record_id", ["comments"], scan.ScanConfig())


@query(_FLAGS + """ SELECT record_id, type, coalesce(subtype, '') AS subtype, value, position,
  CASE WHEN position > 15 THEN '...' ELSE '' END || substr(comments, greatest(position - 15, 0) + 1, least(position + length(value) + 15, length(comments)) - greatest(position - 15, 0)) || CASE WHEN position + length(value) + 15 < length(comments) THEN '...' ELSE '' END AS context FROM f""")
def d11_all_flags(spark, d):
    """Every flag of every comment, with the built-in word lists, its position and context."""
    return _all_flags(spark, d).select("record_id", "type", F.coalesce("subtype", F.lit("")).alias("subtype"), "value", "position", "context")


_TOKEN = r"[\p{L}\p{M}\p{N}_]+"
SQL["d1_scan_names"] = f"""WITH c AS (SELECT DISTINCT record_id, comments FROM pupil_records WHERE comments IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY position) AS i FROM ({_at('name', None, _TOKEN)})),
n AS (SELECT pupil_name AS n FROM pupil_records UNION SELECT staff_name FROM staff), p AS (SELECT n AS term FROM n UNION SELECT unnest(list_filter(string_split_regex(n, '\\s+'), lambda x: length(x) >= 2)) FROM n),
k AS (SELECT DISTINCT lower(trim(term, ' ')) AS term FROM p WHERE trim(term, ' ') <> ''),
g AS (SELECT a.record_id, a.position AS s, (b.position + length(b.value))::INT AS e, substr(a.comments, a.position + 1, b.position + length(b.value) - a.position) AS v FROM t a JOIN t b ON a.record_id = b.record_id AND b.i BETWEEN a.i AND a.i + 9),
h AS (SELECT record_id, list({{'e': e, 'h': [{{'s': s, 'v': v}}]}} ORDER BY s, length(v) DESC) AS x FROM g JOIN k ON lower(v) = term GROUP BY 1),
z AS (SELECT record_id, list_reduce(x, lambda a, b: CASE WHEN b.h[1].s >= a.e THEN {{'e': b.e, 'h': list_concat(a.h, b.h)}} ELSE a END).h AS hs FROM h)
SELECT record_id, q.s AS position, q.v AS value FROM (SELECT record_id, unnest(hs) AS q FROM z)"""
_EXTRA = ((r"(?i)\b(?:set|room|chapter|page) \d+\b", "place"), (r"\d+%", ""))


@query("SELECT type, value, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{k or 'custom'}' AS type, unnest(regexp_extract_all(comments, '{p}')) AS value FROM pupil_records" for p, k in _EXTRA) + ") GROUP BY 1, 2")
def d7_extra_patterns(spark, d):
    """A caller's own patterns; one without a type is custom."""
    return pupils(spark, d).select(F.explode(scan.scan_extra(F.col("comments"), _EXTRA)).alias("f")).groupBy("f.type", "f.value").agg(F.count("*").alias("n"))


@query(_PLAIN_FLAGS + ", g AS (SELECT * FROM f UNION ALL SELECT record_id, comments, type, subtype, substr(value, 1, 1), position FROM f) SELECT record_id, type, position, max(length(value))::INT AS n FROM g GROUP BY ALL")
def d9_deduplicated(spark, d):
    """Flags given twice, the second time cut to one letter: of one position and type the longer stays."""
    c = F.col("comments")
    found = F.concat(scan.scan_dates(c), scan.scan_postcodes(c), scan.scan_phones(c), scan.scan_emails(c))
    twice = F.concat(F.transform(found, lambda f: f.withField("value", F.substring(f["value"], 1, 1))), found)
    rows = pupils(spark, d).select("record_id", "comments").distinct().select("record_id", F.explode(scan.deduplicate(twice)).alias("f"))
    return rows.select("record_id", "f.type", "f.position", F.length("f.value").alias("n"))


_LABEL = "CASE WHEN subtype = 'medical' THEN '[ADDITIONAL NEEDS]' WHEN subtype = 'safeguarding' THEN '[REDACTED]' WHEN subtype = 'family' THEN '[PARENT/GUARDIAN]' ELSE '[REDACTED ' || upper(type) || ']' END"


@query(_FLAGS + f""", g AS (SELECT record_id, list({{'s': position, 'e': (position + length(value))::INT, 'l': {_LABEL}}} ORDER BY position, length(value) DESC,
  CASE WHEN type = 'keyword' THEN CASE subtype WHEN 'medical' THEN 1 WHEN 'safeguarding' THEN 2 ELSE 3 END WHEN type = 'date' THEN 4 WHEN type = 'postcode' THEN 5 WHEN type = 'phone' THEN 6 ELSE 7 END) AS x FROM f GROUP BY 1),
r AS (SELECT record_id, comments, list_reduce(x, lambda a, b: CASE WHEN b.s >= a.e THEN {{'s': 0::INT, 'e': b.e, 'l': a.l || substr(comments, a.e + 1, b.s - a.e) || b.l}} ELSE a END, {{'s': 0::INT, 'e': 0::INT, 'l': ''}}) AS z FROM g JOIN c USING (record_id))
SELECT record_id, z.l || substr(comments, z.e + 1) AS cleaned FROM r UNION ALL SELECT record_id, comments FROM c WHERE record_id NOT IN (SELECT record_id FROM g)""")
def d10_redact_all(spark, d):
    """Every comment with all flags replaced by their labels, overlaps resolved leftmost and longest."""
    rows = pupils(spark, d).select("record_id", "comments").distinct().filter("trim(comments) <> ''")
    return rows.select("record_id", scan.scan_text(F.col("comments"))["cleaned"].alias("cleaned"))


@query(_PLAIN_FLAGS + " SELECT record_id, type, value, position FROM f WHERE (record_id, position) NOT IN (SELECT (record_id, position) FROM f WHERE type = 'postcode')")
def d13_accepted_flags(spark, d):
    """Flags left after a reviewer refused every place where a postcode was flagged."""
    flags = scan.scan_table(pupils(spark, d).select("record_id", "comments").distinct(), "record_id", ["comments"], scan.ScanConfig(keywords={}))
    decisions = flags.select("record_id", "position", (F.col("type") != "postcode").alias("accepted"))
    return scan.approved_only(flags, decisions, ["record_id", "position"]).select("record_id", "type", "value", "position")


SQL["d8_email_contexts"] = SQL["d11_all_flags"].replace("SELECT record_id, type, coalesce(subtype, '') AS subtype, value, position,", "SELECT record_id, value, position::BIGINT AS position,") + " WHERE type = 'email'"


# --- F, G: noise with defaults and on mixed cells, quasi-identifiers

@query(f"""WITH o AS (SELECT s_suppkey, s_acctbal / 100 AS q, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier), {sql_draw(SEED, 'o', 'n')},
y AS (SELECT *, q + greatest(least(CASE WHEN u = 0.5 THEN 0 WHEN u = 0 THEN -5 ELSE -2.5 * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)) END, 5), -5) AS y FROM drawn)
SELECT s_suppkey AS supplier, greatest(least(sign(y) * floor(abs(y) + 0.5), 100), 0)::DOUBLE AS noised FROM y""")
def f8_default_noise(spark, d):
    """Noise with the defaults: up to 100, a share of 0.05; 0 counts as not given."""
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("v"))
    return noised_column(rows, "v", ["s_suppkey"], SEED, maximum=0, share=0).select(F.col("s_suppkey").alias("supplier"), F.col("v").alias("noised"))


@query(f"""WITH s AS (SELECT DISTINCT record_id, score_pct AS cell, TRY_CAST(nullif(regexp_extract(score_pct, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE) AS q FROM pupil_records),
o AS (SELECT *, row_number() OVER (ORDER BY record_id, cell) AS n FROM s WHERE q IS NOT NULL), {sql_draw(SEED, 'o', 'n')},
y AS (SELECT *, q + greatest(least(CASE WHEN u = 0.5 THEN 0 WHEN u = 0 THEN -5 ELSE -2.5 * sign(u - 0.5) * ln(1 - 2 * abs(u - 0.5)) END, 5), -5) AS y FROM drawn)
SELECT record_id, greatest(least(sign(y) * floor(abs(y) + 0.5), 100), 0)::BIGINT::VARCHAR AS cell FROM y UNION ALL SELECT record_id, cell FROM s WHERE q IS NULL""")
def f9_noised_cells(spark, d):
    """A column of numbers, marks and blanks: numbers get noise and use up a draw each, all else stays."""
    rows = pupils(spark, d).select("record_id", F.col("score_pct").alias("cell"), F.col("score_pct").alias("o")).distinct()
    return noised_table(rows, ["cell"], ["record_id", "o"], SEED)[0].select("record_id", "cell")


_NUM = "TRY_CAST(nullif(regexp_extract({c}, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') AS DOUBLE)"


@query(f"""WITH s AS (SELECT coalesce(sen, '') AS sen, coalesce(gender, '') AS gender, {_NUM.format(c='score_pct')} AS s, {_NUM.format(c='attendance_pct')} AS a FROM pupil_records)
SELECT sen, gender, CASE WHEN s IS NULL THEN '' WHEN s < 40 THEN '0-39' WHEN s < 50 THEN '40-49' WHEN s < 60 THEN '50-59' WHEN s < 70 THEN '60-69' WHEN s < 80 THEN '70-79' WHEN s < 90 THEN '80-89' ELSE '90+' END AS score_band,
CASE WHEN a IS NULL THEN '' WHEN a < 80 THEN '<80%' WHEN a < 90 THEN '80-89%' WHEN a < 95 THEN '90-94%' ELSE '95%+' END AS attendance_band, count(*) AS rows FROM s GROUP BY ALL""")
def g7_quasi_identifiers(spark, d):
    """Rows of every combination of the quasi-identifiers that the pipeline would assemble."""
    rows = pupils(spark, d).select("sen", "gender", F.col("score_pct").alias("Score"), F.col("attendance_pct").alias("Attendance"))
    banded, grades, attendances = risk.with_bands(rows, ["Score", "Attendance"])
    found = risk.groups(banded, risk.quasi_identifiers(["sen", "gender"], "gender", grades, attendances))
    return found.select("sen", "gender", F.col("Score Band").alias("score_band"), F.col("Attendance Band").alias("attendance_band"), F.col("count").alias("rows"))


# --- H: passes of restoration

def _folds() -> str:
    """What each code point with a compatibility form stands for, as rows of SQL, made from the Unicode tables."""
    rows = []
    for n in (*range(0x80, 0x3400), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)):
        c = chr(n)
        if not 0xD800 <= n < 0xE000 and (k := unicodedata.normalize("NFKD", c)) != unicodedata.normalize("NFD", c):
            rows.append(f"({n}, '{_esc(k)}')")
    return ", ".join(rows)


def _nfkc(name: str, source: str, key: str) -> str:
    """CTE ``name`` (key, t): the texts of ``source`` (key, t) in compatibility composition."""
    return f"""{name} AS (SELECT {key}, nfc_normalize(string_agg(coalesce(k.d, p.c), '' ORDER BY p.i)) AS t FROM (SELECT {key}, unnest(string_split(t, '')) AS c, unnest(range(len(string_split(t, '')))) AS i FROM {source}) p
  LEFT JOIN kd k ON k.n = unicode(p.c) GROUP BY {key})"""


_KD = f"WITH kd(n, d) AS (VALUES {_folds()}), src AS (SELECT response_id, text AS t FROM responses WHERE text IS NOT NULL), {_nfkc('norm', 'src', 'response_id')}"
_ID = r"\[S\d{2,}\]"


@query(_KD + " SELECT response_id, t AS text FROM norm UNION ALL SELECT response_id, text FROM responses WHERE text IS NULL")
def h1_nfkc(spark, d):
    return table(spark, d, "responses").select("response_id", text.nfkc(F.col("text")).alias("text"))


@query(_KD + f""", p AS (SELECT response_id, upload_id, string_split_regex(t, '{_ID}') AS b, regexp_extract_all(t, '{_ID}') AS v FROM norm JOIN responses USING (response_id)),
e AS (SELECT response_id, upload_id, unnest(b) AS b, unnest(range(1, len(b) + 1)) AS i, v FROM p),
m AS (SELECT upload_id, id_token, any_value(real_name) AS r FROM name_mappings WHERE real_name <> '' GROUP BY 1, 2)
SELECT response_id, string_agg(coalesce(m.r, CASE WHEN i > 1 THEN v[i - 1] END, '') || b, '' ORDER BY i) AS text, count(m.r) AS id_matches FROM e LEFT JOIN m ON i > 1 AND m.upload_id = e.upload_id AND m.id_token = v[i - 1][2:-2] GROUP BY 1
UNION ALL SELECT response_id, text, 0 FROM responses WHERE text IS NULL""")
def h3_restore_ids(spark, d):
    """Bare ID tokens restored by a join of tokens to the mapping."""
    return restore.restore_ids(table(spark, d, "responses"), table(spark, d, "name_mappings"), "upload_id", "response_id")


@query(_KD + f", names AS (SELECT DISTINCT upload_id || chr(1) || fake_name AS k, fake_name AS t FROM name_mappings WHERE fake_name <> ''), {_nfkc('fakes', 'names', 'k')}" + """
SELECT DISTINCT response_id, split_part(k, chr(1), 2) AS fake_name FROM norm JOIN responses USING (response_id) JOIN fakes ON split_part(k, chr(1), 1) = upload_id::VARCHAR AND contains(lower(norm.t), lower(fakes.t))""")
def h8_unmatched_names(spark, d):
    """Pseudonyms that a response still holds."""
    return restore.unmatched_names(table(spark, d, "responses"), table(spark, d, "name_mappings"), "upload_id", "response_id")


_REAL = "r AS (SELECT upload_id, fake_name, arg_max(real_name, id_token) AS real_name FROM name_mappings GROUP BY ALL)"


def _answers(spark, d, before: str, line: str, after: str, strategy: str, distinct: bool = True) -> DataFrame:
    """One answer per upload made of its pseudonyms, restored."""
    m = table(spark, d, "name_mappings")
    names = m.select("upload_id", "fake_name", F.lit("").alias("id_token")).distinct() if distinct else m.select("upload_id", "fake_name", "id_token")
    lines = names.groupBy("upload_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("fake_name", "id_token"))), lambda x: F.format_string(line, x["fake_name"], x["id_token"])), "\n").alias("body"))
    said = lines.select("upload_id", F.concat(F.lit(before), "body", F.lit(after)).alias("text"))
    return restore.restore(said, m, "upload_id", "upload_id", "text", strategy)


@query(f"WITH {_REAL} SELECT upload_id, '| Pupil | Note |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || real_name || ' | good ' || ' |', chr(10) ORDER BY fake_name) AS text, count(*) AS name_matches FROM r GROUP BY 1")
def h4_restore_tables(spark, d):
    """Pseudonyms in the name column of Markdown tables."""
    return _answers(spark, d, "| Pupil | Note |\n|---|---|\n", "| %s | good %s |", "", "structured-only").select("upload_id", "text", "name_matches")


@query(f"WITH {_REAL} SELECT upload_id, string_agg('Student: ' || real_name || ' - well done', chr(10) ORDER BY fake_name) AS text, count(*) AS name_matches FROM r GROUP BY 1")
def h5_restore_prefixes(spark, d):
    """Pseudonyms after a prefix."""
    return _answers(spark, d, "", "Student: %s - well done%s", "", "structured-only").select("upload_id", "text", "name_matches")


@query(f"WITH {_REAL} SELECT upload_id, 'Seen: ' || string_agg('(' || real_name || ')', chr(10) ORDER BY fake_name) || '.' AS text, count(*) AS name_matches FROM r GROUP BY 1")
def h6_restore_names(spark, d):
    """Pseudonyms anywhere, in one simultaneous pass."""
    return _answers(spark, d, "Seen: ", "(%s)%s", ".", "global").select("upload_id", "text", "name_matches")


#: A real name that is also a pseudonym of the upload is taken for one by the pass after the tokens.
_TWICE = f"WITH {_REAL}, m AS (SELECT n.*, coalesce(r.real_name, n.real_name) AS after FROM name_mappings n LEFT JOIN r ON r.upload_id = n.upload_id AND lower(r.fake_name) = lower(n.real_name))"


@query(_TWICE + " SELECT upload_id, '- ' || string_agg(after, chr(10) || '- ' ORDER BY fake_name, id_token) AS text, count(*) AS id_matches FROM m GROUP BY 1")
def h10_restore_tokens_with_names(spark, d):
    """Pseudonyms followed by their token: the token decides, so a pseudonym that recurs is no trouble. Names and tokens are one."""
    out = _answers(spark, d, "", "- %s [%s]", "", "id-first", distinct=False)
    return out.select("upload_id", "text", "id_matches")


@query(_TWICE + " SELECT upload_id, r.real_name AS name, m.after AS id FROM m JOIN r USING (upload_id, fake_name)")
def h7_restore_json(spark, d):
    """Pseudonyms and tokens in the strings of JSON answers."""
    m = table(spark, d, "name_mappings")
    student = F.struct(F.concat(F.lit("["), "id_token", F.lit("]")).alias("id"), F.col("fake_name").alias("name"), F.lit("r").alias("reason"))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("all").alias("name"), F.collect_list(student).alias("students"), F.lit("x").alias("recommendation"))).alias("groups"), F.lit("s").alias("summary")))
    done = restore.restore(m.groupBy("upload_id").agg(body.alias("text")), m, "upload_id", "upload_id", "text", "json")
    return restore.response_tables(done.select("upload_id", F.col("parsed").alias("text")), "upload_id")[0].select("upload_id", "name", "id")


@query("SELECT * FROM (VALUES ('id-first', true), ('json', true), ('structured-only', true), ('global', true), ('other', false)) t(strategy, known)")
def h9_strategies(spark, d):
    """Which strategies are known; any other is refused."""
    out = []
    for s in ("id-first", "json", "structured-only", "global", "other"):
        try:
            restore.restore(table(spark, d, "responses"), table(spark, d, "name_mappings"), "upload_id", "response_id", "text", s)
            out.append((s, True))
        except ValueError:
            out.append((s, False))
    return spark.createDataFrame(out, "strategy string, known boolean")


# --- I: questions of templates

@query("""SELECT * FROM (VALUES ('analyse-class-performance', 'subject', 'Subject', 'text', true, '', 'e.g. Year 10 Maths'), ('analyse-class-performance', 'focus', 'Analysis focus', 'dropdown', true, 'trends|intervention|outliers|groups', ''),
('analyse-class-performance', 'context', 'Additional context', 'text', false, '', 'e.g. Recent mock exam results, focus on PP students'), ('write-report-comments', 'subject', 'Subject', 'text', true, '', 'e.g. Year 9 English'),
('write-report-comments', 'tone', 'Tone', 'dropdown', true, 'formal|encouraging|targets', ''), ('write-report-comments', 'wordCount', 'Approximate word count per comment', 'dropdown', true, '50|100|150', ''),
('generate-differentiated-questions', 'subjectAndTopic', 'Subject and topic', 'text', true, '', 'e.g. GCSE Biology — Photosynthesis'), ('generate-differentiated-questions', 'difficultyLevels', 'Number of difficulty levels', 'dropdown', true, '2|3', ''),
('generate-differentiated-questions', 'questionsPerLevel', 'Questions per level', 'dropdown', true, '3|5', '')) t(template, id, label, type, required, options, placeholder)""")
def i2_template_questions(spark, d):
    """Each template looked up by its id, with its questions."""
    rows = [(t, q["id"], q["label"], q["type"], q["required"], "|".join(q.get("options", ())), q.get("placeholder", "")) for t in (x["id"] for x in prompt.TEMPLATES) for q in prompt.get_template(t)["questions"]]
    return spark.createDataFrame(rows, "template string, id string, label string, type string, required boolean, options string, placeholder string")


@query("SELECT * FROM (VALUES ('analyse-class-performance', 'an answer is missing: Subject (subject)'), ('write-report-comments', 'an answer is missing: Subject (subject)'), ('generate-differentiated-questions', 'an answer is missing: Subject and topic (subjectAndTopic)')) t(template, said)")
def i3_missing_answers(spark, d):
    """What is said when a required answer is empty."""
    out = []
    for t in prompt.TEMPLATES:
        try:
            prompt.check_answers(t, {q["id"]: "" for q in t["questions"]})
        except ValueError as e:
            out.append((t["id"], str(e)))
    return spark.createDataFrame(out, "template string, said string")


# --- streams

@query("""WITH e AS (SELECT user_id, event_id, event_type = 'view' AS prompt, lag(event_type = 'view') OVER w AS after, lag(event_id) OVER w AS before FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, before AS prompt, event_id AS answer FROM e WHERE NOT prompt AND after""")
def a10_relay(spark, d):
    """Views as prompts and clicks as their answers, at most one view waiting per user, read as a stream."""
    from cloakframe.streaming import one_pending

    out = folder(spark, "relay")
    kind = F.when(F.col("event_type") == "view", "prompt").when(F.col("event_type") == "click", "answer")
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").select("user_id", "ts", "event_id", kind.alias("kind"), F.col("event_id").alias("body")).filter("kind IS NOT NULL")
    one_pending(events, "user_id", ["ts", "event_id"], "kind", "body").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, prompt long, answer long").parquet(out)
