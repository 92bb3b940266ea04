"""Queries of problem 1 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators import parse
from cloakframe.sources.tables import table


def _tables(spark: SparkSession, d: str):
    return (table(spark, d, t) for t in ("raw_rows", "parsed_rows", "uploads"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return parse.rejected(*_tables(spark, d))


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The rows that load, with the cells that every class sheet has."""
    cell = lambda k: F.coalesce(F.col("record")[k], F.lit(""))
    return parse.loaded(*_tables(spark, d)).select(
        "origin", "row_id", cell("Name").alias("name"), cell("SEN").alias("sen"), cell("Comments").alias("comments"), F.size("record").cast("long").alias("n_cells")
    ).distinct()


def p1_invalid_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value that cannot be cast, with the reason and how often it occurs."""
    return parse.value_faults(*_tables(spark, d))


_ROWS = """
WITH h AS (SELECT upload_id, any_value(headers) AS h, coalesce(nullif(any_value(delimiter_char), ''), ',') AS d FROM uploads GROUP BY 1),
r AS (SELECT 'raw_rows' AS origin, row_id, h, regexp_full_match(d || raw_line, '(?:' || d || '(?:"(?:[^"]|"")*"|[^"' || d || ']*))*') AS ok,
        list_transform(regexp_extract_all(d || raw_line, d || '(?:"(?:[^"]|"")*"|[^"' || d || ']*)'),
          lambda x: CASE WHEN x[2:2] = '"' THEN replace(x[3:-2], '""', '"') ELSE x[2:] END) AS c
      FROM raw_rows JOIN h USING (upload_id) WHERE regexp_matches(raw_line, '[^ ]')
      UNION ALL SELECT 'parsed_rows', row_id, h, true, cells FROM parsed_rows JOIN h USING (upload_id)),
s AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN len(c) <> len(h) THEN 'column_count' END AS broken FROM r),
v AS (SELECT origin, row_id, h, trim(coalesce(c, ''), ' ') AS c FROM (SELECT origin, row_id, unnest(h) AS h, unnest(c) AS c FROM s WHERE broken IS NULL)),
b AS (SELECT origin, row_id FROM v WHERE c <> '' AND CASE
        WHEN h LIKE '%Score%' OR h LIKE '%Attendance%' THEN c NOT IN ('Absent', 'N/A', 'X', '-', 'Withdrawn')
          AND NOT coalesce(TRY_CAST(nullif(regexp_extract(c, '^(\\d+(?:\\.\\d+)?)\\s*%?$', 1), '') AS DOUBLE) BETWEEN 0 AND 100, false)
        WHEN h IN ('DOB', 'Date of Birth') THEN coalesce(CASE WHEN regexp_full_match(c, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(c AS DATE)
          WHEN regexp_full_match(c, '\\d{2}/\\d{2}/\\d{4}') THEN TRY_CAST(c[7:] || '-' || c[4:5] || '-' || c[:2] AS DATE) END IS NULL, true)
        ELSE false END)
"""

SQL = {
    "p1_found": _ROWS + "SELECT DISTINCT origin, row_id, broken AS reason FROM s WHERE broken IS NOT NULL UNION SELECT DISTINCT origin, row_id, 'value' FROM b",
    "p1_loaded": _ROWS
    + """SELECT DISTINCT origin, row_id, coalesce(c[list_position(h, 'Name')], '') AS name, coalesce(c[list_position(h, 'SEN')], '') AS sen,
      coalesce(c[list_position(h, 'Comments')], '') AS comments, len(h)::BIGINT AS n_cells
    FROM s WHERE broken IS NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.origin = s.origin AND b.row_id = s.row_id)""",
}
SQL["p1_invalid_values"] = _ROWS.replace("unnest(h) AS h, unnest(c) AS c", "unnest(h) AS h, unnest(c) AS c, unnest(c) AS o").replace("SELECT origin, row_id, h, trim(", "SELECT origin, row_id, h, o, trim(") + """,
k AS (SELECT CASE WHEN h LIKE '%Score%' OR h LIKE '%Attendance%' THEN 'number' ELSE 'date' END AS kind, o AS value, c, TRY_CAST(nullif(regexp_extract(c, '^(\\d+(?:\\.\\d+)?)\\s*%?$', 1), '') AS DOUBLE) AS x
  FROM v WHERE c <> '' AND (h LIKE '%Score%' OR h LIKE '%Attendance%' OR h IN ('DOB', 'Date of Birth'))),
w AS (SELECT kind, value, CASE WHEN kind = 'number' THEN CASE WHEN c IN ('Absent', 'N/A', 'X', '-', 'Withdrawn') THEN NULL WHEN x IS NULL THEN 'not a number' WHEN x > 100 THEN 'out of range' END
  WHEN NOT regexp_full_match(c, '\\d{4}-\\d{2}-\\d{2}|\\d{2}/\\d{2}/\\d{4}') THEN 'not a date'
  WHEN TRY_CAST(CASE WHEN c LIKE '%/%' THEN c[7:] || '-' || c[4:5] || '-' || c[:2] ELSE c END AS DATE) IS NULL THEN 'no such date' END AS why FROM k)
SELECT kind, value, why, count(*) AS n FROM w WHERE why IS NOT NULL GROUP BY ALL"""
QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p1_invalid_values": p1_invalid_values}
