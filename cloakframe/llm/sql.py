"""SQL of the queries that SQL can express."""

from __future__ import annotations

#: Full-width and joined forms, invisible characters, spaces other than U+0020, and letters of phonetic writing.
_ODD = (
    r"[\x{A0}\x{AD}\x{34F}\x{132}\x{133}\x{149}\x{251}\x{261}\x{1680}\x{180E}\x{2000}-\x{200F}\x{202A}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{3164}"
    r"\x{FB00}-\x{FB06}\x{FE00}-\x{FE0F}\x{FEFF}\x{FF01}-\x{FF5E}\x{1D400}-\x{1D7CB}\x{E0000}-\x{E01EF}]"
)
_LATIN, _OTHER = r"[\p{Latin}]", r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Coptic}\p{Cherokee}]"
#: A word with letters of two scripts.
_MIXED = rf"{_LATIN}[\p{{L}}\p{{M}}]*{_OTHER}|{_OTHER}[\p{{L}}\p{{M}}]*{_LATIN}"
#: A word all of whose letters look like Latin ones, in a text that is Latin besides.
_ALIKE = r"(?:^|[^\p{L}\p{M}])[асԁеһіјкӏорԛѕԝхуАВСЕНІЈКМОРЅТХУԜαινορτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ]{2,}(?:[^\p{L}\p{M}]|$)"
_MOSTLY_LATIN = r"len(regexp_extract_all(t, '[\p{Latin}]')) > len(regexp_extract_all(t, '[\p{Cyrillic}\p{Greek}]'))"

#: The best entry by soft TF-IDF of repaired tokens or by edits of the whole value; entries are those of the list and those that the
#: records of a pupil show.
_CANON = r"""WITH k AS (SELECT field_name AS f, code, label FROM canon_values WHERE code IS NOT NULL),
x AS (SELECT record_id, class_id, pupil_name, 'gender' AS f, gender AS v FROM pupil_records UNION ALL SELECT record_id, class_id, pupil_name, 'sen', sen FROM pupil_records),
y AS (SELECT x.*, k.code FROM x LEFT JOIN k ON k.f = x.f AND k.code = x.v WHERE regexp_matches(v, '\S')),
o AS (SELECT *, trim(regexp_replace(regexp_replace(replace(lower(v), '&', ' and '), '[.()\[\]''’"]', '', 'g'), '[^\p{L}\p{N}%/]+', ' ', 'g'), ' ') AS p FROM y WHERE code IS NULL),
s AS (SELECT class_id, pupil_name, f, p, count(*) AS n FROM o WHERE p <> '' AND class_id IS NOT NULL AND pupil_name IS NOT NULL GROUP BY class_id, pupil_name, f, p),
h AS (SELECT class_id, pupil_name, f, code, count(*) / sum(count(*)) OVER (PARTITION BY class_id, pupil_name, f) AS w FROM y WHERE code IS NOT NULL AND class_id IS NOT NULL AND pupil_name IS NOT NULL GROUP BY class_id, pupil_name, f, code),
b AS (SELECT f, code, sum(w) / sum(sum(w)) OVER (PARTITION BY f) AS prior FROM h GROUP BY f, code),
e AS (SELECT s.f, s.p, h.code, sum(h.w) AS w FROM s JOIN h USING (class_id, pupil_name, f) GROUP BY s.f, s.p, h.code),
u AS (SELECT f, p, arg_max(code, w) AS code, least(max(w) / sum(w), 1) AS q, sum(w) AS units FROM e GROUP BY f, p),
g AS (SELECT u.*, least(prior, 1 - 1e-9) AS z, (SELECT sum(n) FROM s WHERE s.f = u.f AND s.p = u.p) AS n FROM u JOIN b USING (f, code)),
a AS (SELECT * FROM g WHERE q >= 0.9 AND q > z AND units * (q * ln(q / z) + CASE WHEN q < 1 THEN (1 - q) * ln((1 - q) / (1 - z)) ELSE 0 END) >= ln(1000)),
l AS (SELECT f, p, code FROM a QUALIFY n >= 0.1 * max(n) OVER (PARTITION BY f, code)),
c AS (SELECT f, code, p FROM l UNION SELECT f, code, trim(regexp_replace(regexp_replace(lower(t), '[.()\[\]''’"]', '', 'g'), '[^\p{L}\p{N}%/]+', ' ', 'g'), ' ') FROM (SELECT f, code, unnest([code, label]) AS t FROM k)),
cc AS (SELECT f, p, min(code) AS code FROM c WHERE p <> '' GROUP BY f, p),
pl AS (SELECT f, code, min(i) AS place FROM (SELECT f, code, row_number() OVER () AS i FROM k) GROUP BY f, code),
ct AS (SELECT f, p, code, unnest(list_distinct(string_split(p, ' '))) AS et FROM cc),
idf AS (SELECT f, et, ln(1 + (SELECT count(*) FROM cc WHERE cc.f = ct.f) / count(DISTINCT p)) AS idf FROM ct GROUP BY f, et),
nm AS (SELECT f, p, sqrt(sum(idf * idf)) AS norm FROM ct JOIN idf USING (f, et) GROUP BY f, p),
d AS (SELECT DISTINCT f, v, p, replace(p, ' ', '') AS j FROM o),
vt AS (SELECT f, v, unnest(list_distinct(list_filter(string_split(p, ' '), lambda t: regexp_matches(t, '[\p{L}\p{N}]')))) AS t FROM d),
st AS (SELECT f, t, et, 1 - n::DOUBLE / z AS sim FROM (SELECT f, t, et, damerau_levenshtein(t, et) AS n, greatest(length(t), length(et)) AS z FROM (SELECT DISTINCT f, t FROM vt) JOIN idf USING (f) WHERE abs(length(t) - length(et)) <= 2)
  WHERE n <= CASE WHEN z >= 7 THEN 2 WHEN z >= 3 THEN 1 ELSE 0 END),
wt AS (SELECT f, v, t, coalesce((SELECT arg_max(idf, sim) FROM st JOIN idf USING (f, et) WHERE st.f = vt.f AND st.t = vt.t), ln(1 + (SELECT count(*) FROM cc WHERE cc.f = vt.f))) AS w FROM vt),
le AS (SELECT f, v, sqrt(sum(w * w)) AS len FROM wt GROUP BY f, v),
so AS (SELECT f, v, p, code, sum(dot) AS dot FROM (SELECT wt.f, wt.v, ct.p, ct.code, et, max(sim * w * idf) AS dot FROM wt JOIN st USING (f, t) JOIN ct USING (f, et) JOIN idf USING (f, et) GROUP BY wt.f, wt.v, ct.p, ct.code, et) GROUP BY f, v, p, code),
m AS (SELECT f, v, code, least(dot / (norm * len), 1) AS score FROM so JOIN nm USING (f, p) JOIN le USING (f, v)
  UNION ALL SELECT f, v, code, 1 - n::DOUBLE / z FROM (SELECT d.f, d.v, cc.code, damerau_levenshtein(d.j, replace(cc.p, ' ', '')) AS n, greatest(length(d.j), length(replace(cc.p, ' ', ''))) AS z FROM d JOIN cc USING (f) WHERE d.j <> '')
  WHERE n <= CASE WHEN z >= 7 THEN 2 WHEN z >= 3 THEN 1 ELSE 0 END),
r AS (SELECT f, v, arg_max(code, (round(score, 9), -place)) AS code FROM m JOIN pl USING (f, code) WHERE score >= 0.7 GROUP BY f, v)
SELECT DISTINCT record_id, f AS field_name, coalesce(r.code, 'UNMATCHED') AS code FROM o LEFT JOIN r USING (f, v)"""

SQL: dict[str, str] = {
    "p4_found": f"""WITH x AS (SELECT 'pupil_records' AS origin, record_id AS row_id, pupil_name AS t FROM pupil_records UNION ALL SELECT 'responses', response_id, text FROM responses)
SELECT DISTINCT origin, row_id FROM x WHERE regexp_matches(t, '{_ODD}') OR nfc_normalize(t) <> t OR regexp_matches(t, '{_MIXED}') OR (regexp_matches(t, '{_ALIKE}') AND {_MOSTLY_LATIN})""",
    "p5_found": _CANON,
    "p5_report": f"SELECT field_name, code, count(*) AS entries FROM ({_CANON}) GROUP BY 1, 2",
}
