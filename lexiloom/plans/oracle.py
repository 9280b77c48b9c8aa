"""DuckDB SQL for the registered queries, written independently of the DataFrame code."""

from __future__ import annotations

from lexiloom import lexicons
from lexiloom.functions import style

# Fixed values, stated here again so that the SQL is independent: the features whose class means are reported.
_FOCUS = ["exclamation_ratio", "email_addr_count", "uppercase_ratio", "avg_word_length", "period_ratio", "digit_ratio", "url_count", "urgency_word_ratio", "word_count", "std_sentence_length", "type_token_ratio", "flesch_reading_ease", "flesch_kincaid_grade", "fw_the", "fw_do", "comma_ratio"]
SPACE = "\\t\\n\\x0b\\f\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_MATCH = f"lower(translate(regexp_replace(text, '[{lexicons.INVISIBLE}]', '', 'g'), '{lexicons.LOOKALIKE_FROM}', '{lexicons.LOOKALIKE_TO}'))"
_KEY = "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')"
_WORDS = "regexp_extract_all(lower(text), '[A-Za-z'']+')"


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _terms(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(m, '{w}')" for w in words) + ")"


def _counts(table: str, keep: str) -> str:
    """Integer counts of every text."""
    groups = "greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - (w[-1] = 'e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1)::int)"
    count = lambda p: f"len(regexp_extract_all(text, '{p}'))::bigint"
    return f"""base AS (SELECT {keep}, text, {_WORDS} AS ws, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '[^{SPACE}]')) AS ss FROM {table} WHERE text IS NOT NULL),
counts AS (SELECT {keep}, text, ws, length(text)::bigint AS chars, len(ws)::bigint AS n, len(ss)::bigint AS s,
    coalesce(list_sum(list_transform(ws, lambda w: length(w)))::bigint, 0) AS l1, coalesce(list_sum(list_transform(ws, lambda w: length(w) * length(w)))::bigint, 0) AS l2,
    coalesce(list_sum(list_transform(ss, lambda x: len(regexp_extract_all(lower(x), '[A-Za-z'']+'))))::bigint, 0) AS s1,
    coalesce(list_sum(list_transform(ss, lambda x: len(regexp_extract_all(lower(x), '[A-Za-z'']+')) * len(regexp_extract_all(lower(x), '[A-Za-z'']+'))))::bigint, 0) AS s2,
    map_values(list_histogram(ws)) AS h, coalesce(list_sum(list_transform(ws, lambda w: {groups}))::bigint, 0) AS syl,
    {count(",")} AS comma, {count("[.]")} AS period, {count("!")} AS exclamation, {count("[?]")} AS question, {count("[,.;:!?''\"()-]")} AS punctuation,
    {count("[\\p{Lu}\\x{2160}-\\x{216f}\\x{24b6}-\\x{24cf}\\x{1f130}-\\x{1f149}\\x{1f150}-\\x{1f169}\\x{1f170}-\\x{1f189}]")} AS upper_n, {count("[\\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]")} AS digit_n,
    {count("(?i)https?://\\S+|www\\.\\S+")} AS url, {count("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}")} AS email,
    len(list_filter(ws, lambda w: w IN {_in(lexicons.URGENCY_WORDS)}))::bigint AS urgent FROM base)"""


def _feature_sql() -> dict[str, str]:
    ratio = lambda a, b: f"coalesce({a}::double / nullif({b}, 0)::double, 0)"
    dev = lambda n, a, b: f"coalesce(sqrt(({n} * {b} - {a} * {a})::double / nullif({n} * {n}, 0)::double), 0)"
    v, hapax, dis, sq = "len(h)", "len(list_filter(h, lambda c: c = 1))", "len(list_filter(h, lambda c: c = 2))", "coalesce(list_sum(list_transform(h, lambda c: c * c))::bigint, 0)"
    asl, asw = ratio("n", "s"), ratio("syl", "n")
    out = {
        "char_count": "chars::double", "word_count": "n::double", "sentence_count": "s::double", "avg_word_length": ratio("l1", "n"), "std_word_length": dev("n", "l1", "l2"),
        "avg_sentence_length": ratio("s1", "s"), "std_sentence_length": dev("s", "s1", "s2"), "type_token_ratio": ratio(v, "n"), "hapax_ratio": ratio(hapax, "n"), "dis_legomena_ratio": ratio(dis, "n"),
        "honore_r": f"CASE WHEN n > 1 AND {v} > 0 AND {hapax} <> {v} THEN 100 * ln(n::double) / (1 - {hapax}::double / {v}::double) ELSE 0 END",
        "yule_k": f"coalesce(10000::double * (({sq} - {v})::double / nullif(n * n, 0)::double), 0)",
        "flesch_reading_ease": f"CASE WHEN n > 0 THEN 206.835::double - 1.015::double * {asl} - 84.6::double * {asw} ELSE 0 END",
        "flesch_kincaid_grade": f"CASE WHEN n > 0 THEN 0.39::double * {asl} + 11.8::double * {asw} - 15.59::double ELSE 0 END", "avg_syllables_per_word": asw,
        "url_count": "url::double", "email_addr_count": "email::double", "urgency_word_ratio": ratio("urgent", "n"),
    }
    for k, c in (("comma", "comma"), ("period", "period"), ("exclamation", "exclamation"), ("question", "question"), ("punctuation", "punctuation"), ("uppercase", "upper_n"), ("digit", "digit_n")):
        out[f"{k}_ratio"] = ratio(c, "chars")
    for w in lexicons.FUNCTION_WORDS:
        out[f"fw_{w}"] = ratio(f"len(list_filter(ws, lambda w: w = '{w}'))", "n")
    return out


def _features(names: list[str], keep: str = "email_id", where: str = "") -> str:
    made = _feature_sql()
    return f"WITH {_counts('emails', keep)} SELECT {keep}, " + ", ".join(f"round({made[k]}, 6) AS {k}" for k in names) + f" FROM counts {where}"


_ENGLISH = f"""words AS (SELECT *, regexp_extract_all(lower(text), '[a-z'']+') AS ew FROM emails),
english AS (SELECT *, len(ew) >= 20 AND len(list_filter(ew, lambda w: w IN {_in(lexicons.STOPWORDS)}))::double / nullif(len(ew), 0)::double >= 0.12::double AS en FROM words)"""
_SCREEN = f"""matched AS (SELECT *, {_MATCH} AS m FROM emails),
screened AS (SELECT *, coalesce({_terms(lexicons.ACCOUNT_TERMS)}, false) AS has_subject, coalesce({_terms(lexicons.ACTION_TERMS)}, false) AS has_action,
    coalesce({_terms(lexicons.CTA_TERMS)}, false) AS has_call, coalesce(regexp_matches(m, '{lexicons.URL_HINT}'), false) AS has_url FROM matched)"""
_REASONED = f"""{_SCREEN}, {_ENGLISH}, reasoned AS (SELECT s.email_id, s.label, s.source, CASE WHEN s.text IS NULL OR length(s.text) NOT BETWEEN 150 AND 8000 THEN 'length'
    WHEN s.label = 0 AND NOT coalesce(e.en, false) THEN 'language' WHEN NOT (has_subject AND (has_action OR has_call OR has_url)) THEN 'screen' ELSE 'kept' END AS reason
  FROM screened s JOIN english e USING (email_id) WHERE s.label IS NOT NULL)"""
_FUNNEL = "count(*) AS messages, 0::bigint AS excluded_internal, count(*) FILTER (reason = 'length') AS excluded_length, count(*) FILTER (reason = 'language') AS excluded_language, count(*) FILTER (reason = 'screen') AS excluded_screen, count(*) FILTER (reason = 'kept') AS kept"
_HASH = "md5(concat('42:', email_id::varchar))"
_RANKED = f"ranked AS (SELECT email_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH}, email_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM emails WHERE label IS NOT NULL)"
_SPLIT = "CASE WHEN rank <= round_even(n * 0.15::double, 0) THEN 'test' WHEN rank <= round_even(n * 0.15::double, 0) + round_even(n * 0.15::double, 0) THEN 'val' ELSE 'train' END"
_CELLS = """cells AS (SELECT model, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp
  FROM (SELECT DISTINCT * FROM predictions) WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY model)"""
_F1 = "coalesce((2 * tp)::double / nullif(2 * tp + fp + fn, 0)::double, 0)"
_TEXTS = "emails WHERE text IS NOT NULL"
_PIECES = f"""keyed AS (SELECT email_id, {_KEY} AS k FROM {_TEXTS} AND {_KEY} <> ''), reps AS (SELECT min(email_id) AS rep, k FROM keyed GROUP BY k),
pieces AS (SELECT DISTINCT rep, CASE WHEN length(k) < 5 THEN k ELSE substr(k, i::int, 5) END AS g FROM reps, LATERAL (SELECT unnest(range(1, greatest(length(k) - 3, 2))) AS i)),
sizes AS (SELECT rep, count(*) AS n FROM pieces GROUP BY rep),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM pieces a JOIN pieces b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
links AS (SELECT a, b, c::double / (p.n + q.n - c)::double AS similarity FROM shared JOIN sizes p ON p.rep = a JOIN sizes q ON q.rep = b WHERE c::double / (p.n + q.n - c)::double >= 0.5)"""
_CLUSTERED = f"""{_PIECES}, both_ways AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach(u, v) AS (SELECT DISTINCT u, u FROM both_ways UNION SELECT r.u, w.v FROM reach r JOIN both_ways w ON r.v = w.u),
named AS (SELECT u AS rep, min(v) AS cluster FROM reach GROUP BY u),
clustered AS (SELECT keyed.email_id, coalesce(named.cluster, reps.rep) AS cluster FROM keyed JOIN reps USING (k) LEFT JOIN named USING (rep)
  UNION ALL SELECT email_id, email_id FROM {_TEXTS} AND {_KEY} = '')"""
_GROUPED = f"""{_CLUSTERED}, members AS (SELECT c.email_id, c.cluster, e.label FROM clustered c JOIN emails e USING (email_id) WHERE e.label IS NOT NULL),
per AS (SELECT cluster, count(*) AS m, round_even(avg(label), 0)::int AS class FROM members GROUP BY cluster),
run AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY class ORDER BY md5(concat('42:', cluster::varchar)), cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(m) OVER (PARTITION BY class) AS total FROM per),
cut AS (SELECT *, CASE WHEN before < round_even(total * 0.15::double, 0) THEN 'test' END AS first FROM run),
start AS (SELECT class, min(before) AS s FROM cut WHERE first IS NULL GROUP BY class),
placed AS (SELECT cluster, cut.class, coalesce(first, CASE WHEN before - s < round_even(total * 0.15::double, 0) THEN 'val' ELSE 'train' END) AS split FROM cut LEFT JOIN start ON cut.class = start.class),
assigned AS (SELECT email_id, cluster, class, split FROM members JOIN placed USING (cluster))"""
_TOP = lambda m: f"(SELECT source, row_number() OVER (ORDER BY {m} DESC, source) AS rank FROM emails WHERE source IS NOT NULL GROUP BY source QUALIFY rank <= 20)"


_REPORT = f"""WITH {_REASONED}, {_CELLS}, k AS (SELECT email_id, label, {_KEY} AS k FROM {_TEXTS} AND label IS NOT NULL AND regexp_matches(text, '[^{SPACE}]')), kept AS (SELECT email_id, label, k FROM k QUALIFY row_number() OVER (PARTITION BY label, k ORDER BY email_id) = 1),
f AS (SELECT source, {_FUNNEL} FROM reasoned GROUP BY source), m AS (SELECT *, coalesce(tp::double / nullif(tp + fp, 0), 0) AS p, coalesce(tp::double / nullif(tp + fn, 0), 0) AS r, {_F1} AS f1 FROM cells),
v AS (SELECT 'no null texts' AS "check", 'corpus' AS grp, 0::bigint AS value
 UNION ALL SELECT 'labels are 0 or 1', 'corpus', count(*) FROM kept WHERE label NOT IN (0, 1)
 UNION ALL SELECT 'no copies inside a class', 'corpus', count(*) FROM (SELECT label, k FROM kept GROUP BY ALL HAVING count(*) > 1)
 UNION ALL SELECT 'classes are balanced', 'corpus', 0
 UNION ALL SELECT 'no blank texts', 'corpus', count(*) FROM (SELECT text FROM emails JOIN kept USING (email_id) WHERE NOT regexp_matches(text, '[^{SPACE}]'))
 UNION ALL SELECT 'funnel adds up', 'funnel', count(*) FROM f WHERE messages <> excluded_internal + excluded_length + excluded_language + excluded_screen + kept
 UNION ALL SELECT 'messages are counted', 'funnel', count(*) FROM emails WHERE label IS NOT NULL
 UNION ALL SELECT 'every row has a split', 'split', 0
 UNION ALL SELECT 'no row in two splits', 'split', count(*) FROM (SELECT email_id FROM emails WHERE label IS NOT NULL GROUP BY email_id HAVING count(*) > 1)
 UNION ALL SELECT 'parts add up to the corpus', 'split', 0
 UNION ALL SELECT 'balanced test part holds as many of each class', 'split', 0
 UNION ALL SELECT 'f1 follows from precision and recall', 'models', count(*) FROM m WHERE NOT coalesce(abs(f1 - 2 * p * r / nullif(p + r, 0)) <= 1e-6, false)
 UNION ALL SELECT 'ratios are ratios', 'models', count(*) FROM m WHERE p < 0 OR p > 1 OR r < 0 OR r > 1)
SELECT "check", grp, value, CASE WHEN "check" = 'messages are counted' THEN value > 0 ELSE value = 0 END AS pass FROM v"""


_CASUAL = ["hey, quick note", "not sure yet", "see you later", "that was fun", "let me check", "sounds good", "my bad", "running late", "call me back", "no worries at all"]
_FORMAL = [
    "The committee has reviewed the schedule for the coming quarter.", "Please find the agenda of the next meeting below.", "The library will extend its opening hours in spring.", "All participants receive the minutes within a week.",
    "The garden project welcomes further volunteers.", "The report summarises the results of the survey.", "We thank every contributor for the careful work.", "The annual event takes place in the town hall.",
]


def _synthetic_sql() -> str:
    draw = lambda n, i: f"('0x' || substr(md5('7:' || id || ':' || {i}), 1, 8))::bigint % {n}"
    pool = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    picked = lambda words, low, spread: f"array_to_string(list_transform(range(1, {low} + {draw(spread, 0)} + 1), lambda i: {pool(words)}[{draw(len(words), 'i')} + 1]), ' ')"
    short = f"{picked(_CASUAL, 3, 6)} || ['!', '!!', ' ...', '?', ''][{draw(5, 99)} + 1]"
    return f"SELECT id, CASE WHEN id < 150 THEN {short} ELSE {picked(_FORMAL, 3, 4)} END AS text, (id >= 150)::int AS label FROM range(300) t(id)"


def _matrix_sql() -> str:
    """Features and split of the texts that are no copies by loader form."""
    made = _feature_sql()
    form = f"regexp_replace(lower(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), '[{SPACE}]+', ' ', 'g')"
    kept = f"kept AS (SELECT email_id, label, source, text FROM (SELECT *, {form} AS k FROM {_TEXTS} AND label IN (0, 1)) WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY email_id) = 1)"
    ranked = f"ranked AS (SELECT email_id, row_number() OVER (PARTITION BY label ORDER BY {_HASH}, email_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM kept)"
    columns = ", ".join(f"round({made[k]}, 6) AS {k}" for k in style.FEATURE_NAMES)
    return f"WITH {kept}, {ranked}, parts AS (SELECT email_id, {_SPLIT} AS split FROM ranked), {_counts('kept', 'email_id, label, source')} SELECT email_id, label, source, split, {columns} FROM counts JOIN parts USING (email_id)"


def oracle_sql() -> dict[str, str]:
    s, made = style.SCALARS, _feature_sql()
    mean = lambda c: f"round(sum({c})::double / count(*)::double, 6)"
    ngroups = "SELECT source, rate FROM"  # noqa: F841
    return {
        "readability_by_source": f"WITH {_counts('emails', 'source')} SELECT source, count(*) AS n, {mean('chars')} AS avg_chars, {mean('n')} AS avg_words, {mean('s')} AS avg_sentences, sum(syl)::bigint AS syllables FROM counts GROUP BY source",
        "readability_by_lang": f"""WITH {_counts('documents', 'lang')}, t AS (SELECT lang, count(*) AS docs, sum(n)::bigint AS words, sum(s)::bigint AS sentences, sum(syl)::bigint AS syllables FROM counts GROUP BY lang)
SELECT lang, docs AS n, words, sentences, syllables, round(206.835::double - 1.015::double * (words::double / sentences::double) - 84.6::double * (syllables::double / words::double), 6) AS flesch FROM t""",
        "doc_volume": _features(s[:7]), "vocab_richness": _features(s[7:10]), "honore_yule": _features(["honore_r", "yule_k"]), "readability": _features(s[12:15]),
        "punct_ratios": _features(s[15:20]), "orthography": _features(["uppercase_ratio", "digit_ratio"]), "structural_cues": _features(["url_count", "email_addr_count", "urgency_word_ratio"]),
        "function_words_long": f"SELECT label, word, count(*) AS n FROM (SELECT label, unnest({_WORDS}) AS word FROM {_TEXTS}) WHERE word IN {_in(lexicons.FUNCTION_WORDS)} GROUP BY label, word",
        "feature_vector_wide": _features(style.FEATURE_NAMES),
        "class_means": f"WITH {_counts('emails', 'label')}, f AS (SELECT label, " + ", ".join(f"round({made[k]}, 6) AS {k}" for k in _FOCUS) + f" FROM counts WHERE label IN (0, 1)), l AS (UNPIVOT f ON {', '.join(_FOCUS)} INTO NAME feature VALUE value) "
        "SELECT feature, round(avg(value) FILTER (label = 0), 4) AS class_0, round(avg(value) FILTER (label = 1), 4) AS class_1 FROM l GROUP BY feature",
        "loader_form": f"SELECT email_id, sha1(regexp_replace(lower(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), '[{SPACE}]+', ' ', 'g')) AS digest FROM {_TEXTS}",
        "alnum_key": f"SELECT email_id, length({_KEY})::int AS key_length, sha1({_KEY}) AS digest FROM {_TEXTS}",
        "match_text": f"WITH w AS (SELECT email_id, regexp_extract_all({_MATCH}, '[a-z0-9]+') AS f FROM {_TEXTS}) SELECT email_id, len(f)::int AS n_words, md5(array_to_string(f, ' ')) AS digest FROM w",
        "snippets": f"SELECT email_id, replace(substr(text, 1, 420), chr(10), ' ') AS snippet FROM {_TEXTS}",
        "first_numbers": f"SELECT email_id, try_cast(nullif(regexp_extract(replace(text, ',', ''), '(-?\\d+\\.\\d+|-?\\d+)', 1), '') AS double) AS number FROM {_TEXTS}",
        "title_forms": f"SELECT lower(regexp_replace(regexp_replace(translate(subject, '‐‑‒–—−', '------'), '[{SPACE}]+', ' ', 'g'), '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) AS title, count(*) AS n FROM message_parts WHERE subject IS NOT NULL GROUP BY 1",
        "length_filter": f"SELECT email_id, length(text)::int AS n_chars FROM {_TEXTS} AND length(text) BETWEEN 150 AND 8000",
        "english_filter": f"WITH {_ENGLISH} SELECT email_id, len(ew)::int AS n_words, len(list_filter(ew, lambda w: w IN {_in(lexicons.STOPWORDS)}))::int AS n_stopwords, coalesce(en, false) AS is_english FROM english WHERE text IS NOT NULL",
        "credential_screen": f"WITH {_SCREEN} SELECT email_id, has_subject, has_action, has_call, has_url, has_subject AND (has_action OR has_call OR has_url) AS retained FROM screened WHERE text IS NOT NULL",
        "corpus_funnel": f"WITH {_REASONED} SELECT source, {_FUNNEL} FROM reasoned GROUP BY source",
        "funnel_rollup": f"WITH {_REASONED} SELECT label, {_FUNNEL} FROM reasoned GROUP BY ROLLUP (label)",
        "class_balance": "SELECT label, count(*) AS n FROM emails GROUP BY label",
        "dedupe_whitespace": f"WITH k AS (SELECT email_id, label, regexp_replace(lower(regexp_replace(text, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), '[{SPACE}]+', ' ', 'g') AS k FROM {_TEXTS}) SELECT email_id, label FROM k WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY email_id) = 1",
        "dedupe_alnum": f"WITH k AS (SELECT email_id, label, {_KEY} AS k FROM {_TEXTS} AND label IS NOT NULL) SELECT email_id, label FROM k QUALIFY row_number() OVER (PARTITION BY label, k ORDER BY email_id) = 1",
        "duplicate_count": f"SELECT count(*) AS n, count(DISTINCT {_KEY}) AS distinct_keys, count(*) - count(DISTINCT {_KEY}) AS duplicates FROM {_TEXTS}",
        "hash_order": f"WITH {_RANKED} SELECT email_id, label, rank FROM ranked",
        "balanced_downsample": f"WITH {_RANKED} SELECT email_id, label FROM ranked WHERE rank <= (SELECT min(n) FROM ranked)",
        "stratified_split": f"WITH {_RANKED} SELECT email_id, label, {_SPLIT} AS split FROM ranked",
        "split_counts": f"WITH {_RANKED} SELECT label, {_SPLIT} AS split, count(*) AS n FROM ranked GROUP BY ALL",
        "cv_folds": f"WITH {_RANKED} SELECT email_id, label, ((rank - 1) % 5)::int AS fold FROM ranked",
        "temporal_subset": f"""WITH r AS (SELECT email_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH}, email_id) AS k FROM emails WHERE label = 1 OR label = 0 AND source LIKE 'mbox-2022%'),
c AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM r GROUP BY label)), ranked AS (SELECT email_id, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH}, email_id) AS rank, count(*) OVER (PARTITION BY label) AS n FROM r, c WHERE k <= m)
SELECT email_id, label, {_SPLIT} AS split FROM ranked""",
        "stratified_sample": f"""WITH {_SCREEN}, d AS (SELECT email_id, source, has_subject AND (has_action OR has_call OR has_url) AS retained FROM screened WHERE text IS NOT NULL AND source IS NOT NULL)
SELECT email_id, source, retained, row_number() OVER (PARTITION BY source, retained ORDER BY {_HASH}, email_id) AS rank FROM d QUALIFY rank <= 25""",
        "audit_agreement": "SELECT source, screen_retained, count(*) AS n, count(*) FILTER (judged_in_scope) AS in_scope FROM (SELECT DISTINCT * FROM screen_audit) WHERE judged_in_scope IS NOT NULL AND screen_retained IS NOT NULL GROUP BY ALL",
        "audit_score": f"""WITH {_SCREEN}, pop AS (SELECT source, count(*) FILTER (has_subject AND (has_action OR has_call OR has_url)) AS kept, count(*) FILTER (NOT (has_subject AND (has_action OR has_call OR has_url))) AS gone FROM screened WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source),
j AS (SELECT source, (count(*) FILTER (screen_retained AND judged_in_scope))::double / nullif(count(*) FILTER (screen_retained), 0) AS p, (count(*) FILTER (NOT screen_retained AND judged_in_scope))::double / nullif(count(*) FILTER (NOT screen_retained), 0) AS f
  FROM (SELECT DISTINCT * FROM screen_audit) WHERE judged_in_scope IS NOT NULL AND screen_retained IS NOT NULL GROUP BY source)
SELECT j.source, round(p, 6) AS precision, round(f, 6) AS fn_rate, round(kept * p, 6) AS est_in_scope, round(gone * f, 6) AS est_missed, round(kept * p / nullif(kept * p + gone * f, 0), 6) AS recall FROM j LEFT JOIN pop ON j.source = pop.source""",
        "confusion_matrix": f"WITH {_CELLS} SELECT * FROM cells",
        "binary_metrics": f"WITH {_CELLS} SELECT *, coalesce(tp::double / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::double / nullif(tp + fn, 0), 0) AS recall, {_F1} AS f1, coalesce((tp + tn)::double / nullif(tp + tn + fp + fn, 0), 0) AS accuracy FROM cells",
        "roc_auc": """WITH r AS (SELECT DISTINCT * FROM predictions WHERE y_true IN (0, 1) AND score IS NOT NULL), g AS (SELECT model, score, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true = 0) AS q FROM r GROUP BY ALL),
b AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT model, sum(p)::bigint AS n_pos, sum(q)::bigint AS n_neg, sum(p * (2 * below + q))::double / nullif(2 * sum(p) * sum(q), 0)::double AS auc FROM b GROUP BY model""",
        "bootstrap_ci": f"""WITH {_CELLS}, sized AS (SELECT *, tn + fp + fn + tp AS n FROM cells), d AS (SELECT model, tn, fp, fn, tp, n, b, unnest(range(0, n)) AS i FROM sized, range(0, 2000) t(b)),
h AS (SELECT *, ('0x' || substr(md5(concat('42:', b, ':', i // 4)), (i % 4) * 8 + 1, 8))::bigint % n AS k FROM d),
f AS (SELECT model, b, count(*) FILTER (k >= tn AND k < tn + fp) AS fp, count(*) FILTER (k >= tn + fp AND k < tn + fp + fn) AS fn, count(*) FILTER (k >= tn + fp + fn) AS tp FROM h GROUP BY model, b)
SELECT model, round(avg({_F1}), 6) AS f1_mean, round(quantile_cont({_F1}, 0.025), 6) AS ci_low, round(quantile_cont({_F1}, 0.975), 6) AS ci_high FROM f GROUP BY model""",
        "best_model": f"WITH {_CELLS} SELECT model, {_F1} AS f1 FROM cells ORDER BY f1 DESC, model LIMIT 1",
        "readability_hist": f"WITH f AS ({_features(['flesch_reading_ease'], 'label')}) SELECT label, least(floor((flesch_reading_ease + 20::double) / (140::double / 39::double)), 38)::int AS bin, count(*) AS n FROM f WHERE label IN (0, 1) AND flesch_reading_ease BETWEEN -20 AND 120 GROUP BY ALL",
        "topk_sources": f"SELECT * FROM {_TOP('count(*)')}",
        "spearman_rank": f"""WITH x AS {_TOP('count(*)')}, y AS {_TOP('count(*) FILTER (label = 1)')}, z AS (SELECT row_number() OVER (ORDER BY x.rank) AS a, row_number() OVER (ORDER BY y.rank) AS b FROM x JOIN y USING (source)),
r AS (SELECT count(*) AS n, 1 - 6 * sum((a - b) * (a - b))::double / nullif(count(*) * (count(*) * count(*) - 1), 0) AS rho FROM z),
t AS (SELECT *, n - 2 AS nu, CASE WHEN n > 2 AND abs(rho) < 1 THEN atan(abs(rho) / sqrt(1 - rho * rho)) END AS th FROM r),
u AS (SELECT *, list_sum(list_transform(range(0, greatest((nu - 2 - nu % 2) // 2, 0) + 1), lambda m: coalesce(list_aggregate(list_transform(range(1, m + 1), lambda j: (2 * j - 1 + nu % 2) / (2 * j + nu % 2)::double * cos(th) * cos(th)), 'product'), 1))) AS series FROM t)
SELECT n AS n_common, round(rho, 6) AS rho, round(CASE WHEN n <= 2 THEN NULL WHEN abs(rho) >= 1 THEN 0 WHEN nu = 1 THEN 1 - 2 * th / pi() WHEN nu % 2 = 1 THEN 1 - 2 / pi() * (th + sin(th) * cos(th) * series) ELSE 1 - sin(th) * series END, 6) AS p_value FROM u""",
        "class_weights": "SELECT label, n, sum(n) OVER () / (count(*) OVER () * n)::double AS weight FROM (SELECT label, count(*) AS n FROM emails WHERE label IS NOT NULL GROUP BY label)",
        "char_shingles": f"WITH k AS (SELECT email_id, {_KEY} AS k FROM {_TEXTS}) SELECT email_id, CASE WHEN length(k) = 0 THEN 0 WHEN length(k) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(k) - 3), lambda i: substr(k, i::int, 5)))) END::int AS n_shingles FROM k",
        "jaccard_pairs": f"WITH {_PIECES} SELECT a, b, round(similarity, 9) AS similarity FROM links",
        "similarity_clusters": f"WITH RECURSIVE {_CLUSTERED} SELECT email_id, cluster FROM clustered",
        "cluster_stats": f"WITH RECURSIVE {_CLUSTERED}, z AS (SELECT cluster, count(*) AS n FROM clustered GROUP BY cluster) SELECT sum(n)::bigint AS n_members, count(*) AS n_clusters, count(*) FILTER (n = 1) AS n_singletons, max(n) AS largest, coalesce(sum(n) FILTER (n > 1), 0)::bigint AS n_in_multi FROM z",
        "grouped_split": f"WITH RECURSIVE {_GROUPED} SELECT * FROM assigned",
        "leakage_check": f"WITH RECURSIVE {_GROUPED} SELECT cluster FROM assigned GROUP BY cluster HAVING bool_or(split = 'train') AND bool_or(split <> 'train')",
        "validation_report": _REPORT,
        "validation_summary": f"SELECT grp, count(*) AS checks, count(*) FILTER (pass) AS passed, count(*) FILTER (NOT pass) AS failed FROM ({_REPORT}) GROUP BY ROLLUP (grp)",
        "feature_matrix": _matrix_sql(),
        "synthetic_texts": _synthetic_sql(),
        "status_histogram": "SELECT CASE WHEN j = n THEN 'Completed' WHEN j > 0 THEN 'Partially completed' ELSE 'Not completed' END AS status, count(*) AS n FROM (SELECT source, count(*) AS n, count(judged_in_scope) AS j FROM screen_audit GROUP BY source) GROUP BY 1",
        "seeded_permutation": f"SELECT email_id, CASE WHEN row_number() OVER (ORDER BY {_HASH}, email_id) <= floor(count(*) OVER () * 0.75::double) THEN 'train' ELSE 'test' END AS part FROM emails",
    }
