"""DuckDB SQL for the registered queries of the subpackage."""

from __future__ import annotations

from lexiloom import lexicons

# White space that trimming removes.
SPACE = "\\t\\n\\x0b\\f\\r\\x1c-\\x20\\x{85}\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"

_KEY = "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')"
_FIELD = f"^[{SPACE}]*[a-z][a-z ]{{0,29}}[:=][{SPACE}]*[^/{SPACE}]"
_PIECES = f"""
keyed AS (SELECT email_id, split, text, {_KEY} AS k FROM emails WHERE {_KEY} <> ''),
pieces AS (SELECT DISTINCT email_id, CASE WHEN length(k) < 5 THEN k ELSE substr(k, i::int, 5) END AS g
  FROM keyed, LATERAL (SELECT unnest(range(1, greatest(length(k) - 3, 2))) AS i)),
sizes AS (SELECT email_id, count(*) AS n FROM pieces GROUP BY 1)"""
_ROOTS = f"""
lines AS (SELECT email_id, {_KEY} AS k, string_split(lower(text), chr(10)) AS l FROM emails WHERE text IS NOT NULL),
forms AS (SELECT email_id,
    regexp_replace(array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '{_FIELD}')), ''), '[^a-z0-9]', '', 'g') AS body,
    array_to_string(list_sort(list_transform(list_filter(l, lambda x: regexp_matches(x, '{_FIELD}')), lambda x: regexp_replace(x, '[^a-z0-9]', '', 'g'))), ',') AS fields
  FROM lines WHERE k <> '')"""

_FROM, _TO = lexicons.LOOKALIKE_FROM, lexicons.LOOKALIKE_TO
_WORDS = f"regexp_extract_all(lower(translate(regexp_replace(text, '[{lexicons.INVISIBLE}]', '', 'g'), '{_FROM}', '{_TO}')), '[a-z0-9]+')"

_SEP = "[\\s\\x{a0}.#:]{1,8}"
_REFERENCE = f"(?:^|[^\\pL\\pN_])(?i:case|ticket|ref|reference|dossier|vorgang|expediente){_SEP}(?:(?i:no){_SEP})?([A-Za-z]{{2}}(?:-|[\\s\\x{{a0}}]{{0,3}})[0-9]{{6}})(?:[^\\pL\\pN]|$)"


_TIED = f"""folded AS (SELECT *, translate(regexp_replace(text, '[{lexicons.INVISIBLE}]', '', 'g'), '{_FROM}', '{_TO}') AS t FROM emails),
named AS (SELECT email_id, label, list_filter(list_concat(['s:' || source, 'a:' || nullif(regexp_extract(lower(sender), '[^\\s<>"''(),;]+@[^\\s<>"''(),;]+'), '')],
    list_transform(coalesce(regexp_extract_all(t, '{_REFERENCE}', 1), []), lambda x: 'r:' || regexp_replace(upper(x), '[^A-Z0-9]', '', 'g'))), lambda x: x IS NOT NULL) AS names FROM folded),
ties AS (SELECT DISTINCT list_min(names) AS u, unnest(names) AS v FROM named), both_ways AS (SELECT u, v FROM ties UNION SELECT v, u FROM ties),
reach(u, v) AS (SELECT u, u FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u)"""

# parts of each size, largest first, dealt to what the splits lack of their majority label so far
_SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}
_LACK = {s: f"greatest(0::double, {share}::double * CASE kind WHEN 'zeros' THEN all_zeros WHEN 'ones' THEN all_ones ELSE all_others END - CASE kind WHEN 'zeros' THEN {s}_zeros WHEN 'ones' THEN {s}_ones ELSE {s}_others END)" for s, share in _SHARES.items()}
_CHANCES = ", ".join(f"{{'c': -CASE WHEN w > 0 THEN {s}_lack / w ELSE {share}::double END, 'i': {i}, 's': '{s}'}}" for i, (s, share) in enumerate(_SHARES.items()))
_CHOSEN = f"""(SELECT CASE WHEN position < -o[1].c THEN o[1].s WHEN position < -o[1].c - o[2].c THEN o[2].s ELSE o[3].s END
  FROM (SELECT list_sort([{_CHANCES}]) AS o FROM (SELECT *, train_lack + validation_lack + test_lack AS w FROM (SELECT {", ".join(f"{x} AS {s}_lack" for s, x in _LACK.items())}))))"""
_HAVE = [f"{s}_{k}" for s in _SHARES for k in ("zeros", "ones", "others")]
_DEALT = f"""{_TIED}, comp AS (SELECT u AS name, min(v) AS component FROM reach GROUP BY u),
placed AS (SELECT email_id, label, coalesce(component, list_min(names), 'i:' || email_id) AS component FROM named LEFT JOIN comp ON name = list_min(names)),
counted AS (SELECT component, count(*) FILTER (label = 0) AS zeros, count(*) FILTER (label = 1) AS ones, count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) AS others, count(*) AS n FROM placed GROUP BY component),
sized AS (SELECT *, floor(log2(n) + 1e-9)::int AS power, CASE WHEN zeros >= ones AND zeros >= others THEN 'zeros' WHEN ones >= others THEN 'ones' ELSE 'others' END AS kind,
  sum(zeros) OVER () AS all_zeros, sum(ones) OVER () AS all_ones, sum(others) OVER () AS all_others FROM counted),
stood AS (SELECT *, (coalesce(sum(n) OVER (PARTITION BY power, kind ORDER BY md5('42:' || component), component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double + n / 2) / (sum(n) OVER (PARTITION BY power, kind))::double AS position,
  dense_rank() OVER (ORDER BY power DESC) AS step FROM sized),
deal AS (SELECT 0::bigint AS step, {", ".join(f"0::bigint AS {h}" for h in _HAVE)}
  UNION ALL SELECT step + 1, {", ".join(f"({s}_{k} + coalesce(sum({k}) FILTER (split = '{s}'), 0))::bigint" for s in _SHARES for k in ("zeros", "ones", "others"))}
  FROM (SELECT d.*, s.zeros, s.ones, s.others, {_CHOSEN} AS split FROM deal d JOIN stood s ON s.step = d.step + 1) GROUP BY step, {", ".join(_HAVE)}),
dealt AS (SELECT p.email_id, {_CHOSEN} AS split FROM placed p JOIN stood s USING (component) JOIN deal d ON d.step = s.step - 1)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH {_PIECES},
sided AS (SELECT email_id, CASE lower(trim(split)) WHEN 'validation' THEN 'val' ELSE lower(trim(split)) END AS side FROM keyed WHERE split IS NOT NULL),
shared AS (SELECT a.email_id AS x, b.email_id AS y, count(*) AS c FROM pieces a JOIN pieces b USING (g)
  WHERE a.email_id IN (SELECT email_id FROM sided WHERE side = 'train') AND b.email_id IN (SELECT email_id FROM sided WHERE side IN ('val', 'test')) GROUP BY 1, 2)
SELECT least(x, y) AS email_id_a, greatest(x, y) AS email_id_b FROM shared JOIN sizes p ON p.email_id = x JOIN sizes q ON q.email_id = y
WHERE c / (p.n + q.n - c)::double >= 0.8""",
        "p1_overlap": f"""WITH {_PIECES},
sided AS (SELECT email_id, CASE lower(trim(split)) WHEN 'validation' THEN 'val' ELSE lower(trim(split)) END AS side FROM keyed WHERE split IS NOT NULL),
shared AS (SELECT a.email_id AS x, b.email_id AS y, count(*) AS c FROM pieces a JOIN pieces b USING (g)
  WHERE a.email_id IN (SELECT email_id FROM sided WHERE side = 'train') AND b.email_id IN (SELECT email_id FROM sided WHERE side IN ('val', 'test')) GROUP BY 1, 2),
per AS (SELECT y, count(*) AS k FROM shared JOIN sizes p ON p.email_id = x JOIN sizes q ON q.email_id = y WHERE c / (p.n + q.n - c)::double >= 0.8 GROUP BY y)
SELECT side AS split, e.source, count(*) AS n_rows, sum(k)::bigint AS n_pairs FROM per JOIN sided ON sided.email_id = y JOIN emails e ON e.email_id = y GROUP BY 1, 2""",
        "p2_found": f"""WITH RECURSIVE {_TIED}
SELECT DISTINCT substr(u, 3) AS source_a, substr(v, 3) AS source_b FROM reach WHERE u LIKE 's:%' AND v LIKE 's:%' AND u < v""",
        "p2_split": f"WITH RECURSIVE {_DEALT} SELECT email_id, split FROM dealt",
        "p2_balance": f"WITH RECURSIVE {_DEALT} SELECT dealt.split, e.label, count(*) AS n FROM dealt JOIN emails e USING (email_id) GROUP BY ALL",
        "p4_found": f"""WITH {_ROOTS}, grouped AS (SELECT *, min(email_id) OVER (PARTITION BY body, fields) AS a FROM forms)
SELECT a AS email_id_a, email_id AS email_id_b FROM grouped WHERE a <> email_id""",
        "p4_records": f"""WITH {_ROOTS} SELECT min(email_id) AS email_id, count(*) AS n_copies FROM forms GROUP BY body, fields""",
        "p6_found": f"""WITH {_PIECES}, {_ROOTS},
shared AS (SELECT a.email_id AS x, b.email_id AS y, count(*) AS c FROM pieces a JOIN pieces b ON a.g = b.g AND a.email_id < b.email_id GROUP BY 1, 2)
SELECT x AS email_id_a, y AS email_id_b FROM shared JOIN sizes p ON p.email_id = x JOIN sizes q ON q.email_id = y
JOIN forms f ON f.email_id = x JOIN forms h ON h.email_id = y
WHERE c / (p.n + q.n - c)::double >= 0.5 AND (f.body <> h.body OR f.fields <> h.fields)""",
        "p6_groups": f"""WITH RECURSIVE {_PIECES}, {_ROOTS},
shared AS (SELECT a.email_id AS x, b.email_id AS y, count(*) AS c FROM pieces a JOIN pieces b ON a.g = b.g AND a.email_id <> b.email_id GROUP BY 1, 2),
near AS (SELECT x, y, kx.k AS own, ky.k AS other FROM shared JOIN sizes p ON p.email_id = x JOIN sizes q ON q.email_id = y JOIN keyed kx ON kx.email_id = x JOIN keyed ky ON ky.email_id = y
  WHERE c / (p.n + q.n - c)::double >= 0.5),
copied AS (SELECT email_id AS x, min(email_id) OVER (PARTITION BY body, fields) AS y FROM forms),
ties AS (SELECT x, y FROM near UNION SELECT x, y FROM copied UNION SELECT y, x FROM copied),
reach(x, y) AS (SELECT x, y FROM ties UNION SELECT r.x, t.y FROM reach r JOIN ties t ON t.x = r.y),
grouped AS (SELECT x, min(y) AS y FROM reach GROUP BY x), linked AS (SELECT x, count(DISTINCT other) AS n FROM near WHERE own <> other GROUP BY x)
SELECT e.email_id, least(coalesce(g.y, e.email_id), e.email_id) AS "group", coalesce(l.n, 0)::bigint AS n_links FROM emails e LEFT JOIN grouped g ON g.x = e.email_id LEFT JOIN linked l ON l.x = e.email_id""",
        "p7_found": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS p)),
iw AS (SELECT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM i, LATERAL (SELECT unnest(range(1, len(w) - 10)) AS p))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
    }
