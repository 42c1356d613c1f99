"""DuckDB SQL of the registered queries, on the same tables and inline fixtures."""

from __future__ import annotations

from inkgauge.functions import fixed
from inkgauge.plans import fixtures

#: White space at the ends; the tables hold no other kinds than these.
STRIP = r"'^\s+|\s+$'"
M, G = "[가-힣A-Za-z0-9]", r"[^ \n\t\r가-힣A-Za-z0-9.,:/()\-_%+~#@&=]"
DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
RE2 = lambda p: p.replace("(?U)", "").replace("(?iu)", "(?i)").replace("(?iuU)", "(?i)").replace("'", "''")


def strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP}, '', 'g')"


def n(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def normalized(x: str) -> str:
    steps = [("\r\n?", "\n"), ("[ \t]+", " "), (" *\n *", "\n"), *fixed.SPACING_REPAIRS, ("\n{3,}", "\n\n")]
    for pattern, to in steps:
        pattern = RE2(pattern).replace("\r", r"\r").replace("\n", r"\n").replace("\t", r"\t")
        to = "'" + to.replace("$1", r"\1").replace("$2", r"\2") + "'" if "\n" not in to else " || ".join(["chr(10)"] * to.count("\n"))
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return strip(x)


def full_lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"


def compact(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', '', 'g')"


def profile(x: str) -> str:
    return f"length({x}) AS total, {n(x, M)} AS meaningful, {n(x, '[가-힣]')} AS hangul, {n(x, '[A-Za-z0-9]')} AS ascii_word, {n(x, G)} AS garbage, " + n(x, r"(?:\S\s){4,}\S") + " AS spaced_runs"


def line_counts(x: str) -> str:
    f = full_lines(x)
    return (
        f"len({f}) AS n_lines, len({f}) - len(list_distinct(list_transform({f}, lambda l: {compact('l')}))) AS n_duplicate, "
        f"len(list_filter({f}, lambda l: length({compact('l')}) <= 3)) AS n_short, len(list_filter({f}, lambda l: length(l) >= 8 AND {n('l', M)} / length(l) < 0.35)) AS n_noise"
    )


SCORE = (
    "least(greatest(meaningful / greatest(total, 1) * 1.05 - (garbage / greatest(total, 1) * 1.7 + n_short / greatest(n_lines, 1) * 0.18 + n_duplicate / greatest(n_lines, 1) * 0.25 "
    "+ spaced_runs / greatest(total, 1) * 0.45 + n_noise / greatest(n_lines, 1) * 0.35), 0.0), 1.0)"
)


def scored(x: str) -> str:
    return f"CASE WHEN length({strip(x)}) < 120 THEN least({SCORE}, 0.45) ELSE {SCORE} END"


def found(x: str, *patterns: str) -> str:
    every = [f"regexp_extract_all({x}, '{RE2(p)}')" for p in patterns]
    whole = every[0] if len(every) == 1 else f"list_concat({', '.join(every)})"
    tidy = f"list_transform({whole}, lambda v: regexp_replace({strip('v')}, '\\s+', ' ', 'g'))"
    return f"list_sort(list_distinct(list_filter({tidy}, lambda v: v <> '')))"


def bar(x: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({x}, '{sep}'), '')"


TOKENS = "regexp_extract_all({x}, '[가-힣A-Za-z0-9:/._-]+')"
PAIRS = (
    "turns AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), "
    "pairs AS (SELECT a.conv_id, a.turn, a.text AS truth, b.text AS hyp FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
)


def overlap_query(tokens_truth: str, tokens_hyp: str) -> str:
    """Multiset precision, recall and f1 by counting tokens of both sides."""
    return f"""WITH {PAIRS}, ids AS (SELECT *, row_number() OVER () AS id FROM pairs), lists AS (SELECT id, conv_id, turn, {tokens_truth} AS a, {tokens_hyp} AS b FROM ids),
a AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(a) AS t FROM lists) GROUP BY id, t), b AS (SELECT id, t, count(*) AS n FROM (SELECT id, unnest(b) AS t FROM lists) GROUP BY id, t),
hit AS (SELECT a.id, sum(least(a.n, b.n)) AS n FROM a JOIN b ON a.id = b.id AND a.t = b.t GROUP BY a.id),
r AS (SELECT conv_id, turn, coalesce(h.n, 0)::DOUBLE / greatest(len(b), 1) AS p, coalesce(h.n, 0)::DOUBLE / greatest(len(a), 1) AS r FROM lists LEFT JOIN hit h USING (id))
SELECT conv_id, turn, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM r"""


#: Deduplicated lines of a column t of a relation: first occurrences, runs of blanks as one.
def dedup_ctes(source: str) -> str:
    return f"""l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM {source}),
s AS (SELECT doc_id, pos, {strip('raw')} AS x FROM l), k AS (SELECT doc_id, pos, x, CASE WHEN length({compact('x')}) >= 2 THEN {compact('x')} ELSE x END AS k FROM s),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY pos) AS nth FROM k), kept AS (SELECT doc_id, pos, x FROM f WHERE x = '' OR nth = 1),
g AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM kept), tight AS (SELECT doc_id, pos, x FROM g WHERE x <> '' OR before <> ''),
ends AS (SELECT *, pos = max(pos) OVER (PARTITION BY doc_id) AS last FROM tight), lines AS (SELECT doc_id, pos, x FROM ends WHERE NOT (x = '' AND last)),
clean AS (SELECT d.doc_id, count(x) AS n_kept, coalesce(string_agg(x, chr(10) ORDER BY pos), '') AS clean FROM {source} d LEFT JOIN lines USING (doc_id) GROUP BY d.doc_id)"""


NOTICE_WORDS = " + ".join(f"contains(t, '{w}')::INT" for w in fixed.NOTICE_WORDS)
MENU_WORDS = " + ".join(n("t", w) for w in fixed.MENU_WORDS)
#: Counts of the gate's patterns where a text has no Hangul and no look-around matters: what the data tables hold.
URLS = found("t", fixed.URL, fixed.SHORT_URL)
PHONES = rf"list_distinct(list_transform(regexp_extract_all(regexp_replace(t, '\d{{4}}\s*[-\s]', '\0 ', 'g'), '0\d{{1,2}}\s*[-\s]\s*\d{{3,4}}\s*[-\s]\s*\d{{4}}\b'), lambda v: regexp_replace(v, '\D', '', 'g')))"
DIGITS = "regexp_replace({x}, '\\D', '', 'g')"
URL_KEY = "regexp_replace(regexp_replace(lower({x}), '^https?://', ''), '[.,;:)\\]}}]+$', '')"
BAD_URLS = (
    f"list_sort(list_distinct(list_filter(regexp_extract_all(t, '{RE2(fixed.URL_CANDIDATE)}'), lambda v: regexp_matches(v, '{RE2(fixed.URL_HINT)}') "
    f"AND NOT list_contains(list_transform({URLS}, lambda u: {URL_KEY.format(x='u')}), {URL_KEY.format(x='v')}))))"
)
BAD_PHONES = f"list_sort(list_distinct(list_transform(regexp_extract_all(t, '{RE2(fixed.PHONE_CANDIDATE)}'), lambda v: regexp_replace({strip('v')}, '\\s+', ' ', 'g'))))"

IOU = """CASE WHEN least({a}.x + {a}.width, {b}.x + {b}.width) <= greatest({a}.x, {b}.x) OR least({a}.y + {a}.height, {b}.y + {b}.height) <= greatest({a}.y, {b}.y) THEN 0.0
ELSE ((least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x)) * (least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y)))::DOUBLE
/ ({a}.width * {a}.height + {b}.width * {b}.height - (least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x)) * (least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y))) END"""
CONTAINS = "({a}.x <= {b}.x AND {a}.y <= {b}.y AND {a}.x + {a}.width >= {b}.x + {b}.width AND {a}.y + {a}.height >= {b}.y + {b}.height)"
BOXES = f"boxes AS ({fixtures.sql('boxes')})"
ROTATION = (
    f"{n('t', '[가-힣]')} * 2.0 + {n('t', '[가-힣]{2,}')} * 3.0 + " + n("t", r"\d") + " * 0.8 + " + n("t", r"\d{4}\s*[.\-/]\s*\d{1,2}") + " * 8.0 + "
    + n("t", r"\d{2,4}[-\s]\d{3,4}[-\s]\d{4}") + " * 8.0 + " + n("t", r"(?i)https?://|www\.|bit\.ly") + " * 12.0 - " + n("t", r"\?") + " * 0.5"
)
TABLE_SCORE = (
    f"(len({URLS}) + len({found('t', fixed.TABLE_PHONE)})) * 5.0 + (len({found('t', fixed.TABLE_DATE, fixed.TABLE_SHORT_DATE)}) + len({found('t', fixed.TABLE_TIME)}) + len({found('t', fixed.AMOUNT)})) * 3.0 "
    f"+ CASE WHEN {n('t', M)} >= 120 THEN 3.0 WHEN {n('t', M)} >= 50 THEN 2.0 WHEN {n('t', M)} >= 15 THEN 1.0 ELSE -3.0 END "
    f"+ CASE WHEN (CASE WHEN length({compact('t')}) = 0 THEN 1.0 ELSE len(regexp_extract_all({compact('t')}, '[^가-힣A-Za-z0-9]')) / length({compact('t')}) END) > 0.55 THEN -2.0 ELSE 0.0 END"
)
T = "t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
CORE = f"(len({URLS}) + len({found('t', fixed.GATE_TIME)}) + len({found('t', fixed.AMOUNT)}) + len({found('t', fixed.DOTTED_DATE)}) + meal + phones)"
#: Meal dates and phones need look-around: neighbours are matched and cut off again, on a text whose blanks are doubled so that neighbours can be shared.
MEAL = (
    r"list_distinct(list_transform(list_filter(regexp_extract_all(' ' || regexp_replace(t, '([^\d.])', '\1\1', 'g') || ' ', '[^\d.](?:[1-9]|1[0-2])\s*/\s*(?:[1-9]|[12]\d|3[01])(?:\([^)]+\))?[^\d.]'), "
    r"lambda v: true), lambda v: substr(v, 2, length(v) - 2)))"
)
GATE_PHONES = r"list_distinct(list_transform(regexp_extract_all(' ' || regexp_replace(t, '(\D)', '\1\1', 'g'), '\D0\d{1,2}\s*[-\s]+\s*\d{3,4}\s*[-\s]+\s*\d{4}\b'), lambda v: regexp_replace(v, '\D', '', 'g')))"


def gate_sql(source: str, threshold: float) -> str:
    """The gate over a relation of (doc_id, t), t the clean text without Hangul: general notices."""
    return f"""c AS (SELECT doc_id, t, {profile('t')}, {line_counts('t')}, len({MEAL}) AS meal, len({GATE_PHONES}) AS phones, len({URLS}) AS urls FROM {source}),
sc AS (SELECT *, {scored('t')} AS text_score, garbage / greatest(total, 1) AS garbage_ratio, {CORE} AS core, {NOTICE_WORDS} AS words, len({BAD_URLS}) AS bad_urls, len({BAD_PHONES}) AS bad_phones FROM c),
ps AS (SELECT *, least(greatest(least(core / 5, 1.0) * 0.72 + least(words / 5, 1.0) * 0.28, 0.0), 1.0) AS pattern_score FROM sc),
o AS (SELECT *, round(text_score, 4) * 0.62 + round(pattern_score, 4) * 0.38 AS overall FROM ps),
d AS (SELECT *, list_filter([CASE WHEN overall < {threshold} THEN '{fixed.BELOW_THRESHOLD}' END, CASE WHEN round(garbage_ratio, 4) > 0.10 THEN '{fixed.GARBAGE_REASON}' END,
CASE WHEN core = 0 THEN '{fixed.NO_CORE}' END, CASE WHEN bad_urls > 0 AND urls = 0 THEN '{fixed.BROKEN_URLS}' END, CASE WHEN bad_phones > 0 AND phones = 0 THEN '{fixed.BROKEN_PHONES}' END], lambda r: r IS NOT NULL) AS reasons FROM o)"""


NT = "norm AS (SELECT doc_id, " + normalized("coalesce(text, '')") + " AS t FROM documents)"
CLEANED = f"{NT}, {dedup_ctes('norm')}, cl AS (SELECT doc_id, {strip('clean')} AS t FROM clean)"
EVENT_ROWS = "e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)"
POSITIONS = "p AS (SELECT user_id, list_sort(list_distinct(list((event_id % 997)::INT))) AS ps FROM events GROUP BY user_id)"


def spaced_fold(seed: str, items: str) -> str:
    return f"list_reduce(list_transform({items}, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] > 5 THEN list_concat(acc, x) ELSE acc END, [{seed}])"


GRID_ROWS = " UNION ALL ".join(f"SELECT {i} AS band, {j} AS ordinal, {r} AS n_rows, {c} AS n_cols" for i, (_, g) in enumerate(fixed.GRIDS) for j, (r, c) in enumerate(g))

def edge(at: str, n: str, lines: str, side: str, step: int) -> str:
    """A boundary: 0, the lines' places and the side's end, or an even share of the side."""
    return f"(CASE WHEN {lines} > 0 THEN CASE WHEN {at} = {n} THEN {side} ELSE ({at}) * {step} END ELSE round_even({side} * ({at})::DOUBLE / {n}, 0) END)::INT"


ORACLE_SQL = {
    "text_profile": f"WITH {T} SELECT doc_id, {profile('t')} FROM t",
    "normalize_text": f"WITH {NT} SELECT doc_id, md5(t) AS clean_md5, length(t) AS n_chars FROM norm",
    "line_dedup": f"WITH {T}, {dedup_ctes('t')} SELECT doc_id, n_kept, md5(clean) AS kept_md5 FROM clean",
    "line_quality": f"WITH {T} SELECT doc_id, {line_counts('t')} FROM t",
    "text_quality_score": f"""WITH {T}, c AS (SELECT doc_id, t, {profile('t')}, {line_counts('t')} FROM t) SELECT doc_id, {scored('t')} AS score,
(length({strip('t')}) < 120)::INT + (garbage / greatest(total, 1) > 0.10)::INT + (n_short / greatest(n_lines, 1) > 0.35)::INT + (spaced_runs / greatest(total, 1) > 0.12)::INT AS n_warnings FROM c""",
    "urls": f"WITH {T} SELECT doc_id, {bar(URLS)} AS urls FROM t",
    "table_dates": f"WITH {T} SELECT doc_id, {bar(found('t', fixed.TABLE_DATE, fixed.TABLE_SHORT_DATE))} AS dates FROM t",
    "table_phones_times": f"WITH {T} SELECT doc_id, {bar(found('t', fixed.TABLE_PHONE))} AS phones, {bar(found('t', fixed.TABLE_TIME))} AS times FROM t",
    "table_text_score": f"WITH {T} SELECT doc_id, {TABLE_SCORE} AS score FROM t",
    "rotation_score": f"WITH {T} SELECT doc_id, {ROTATION} AS score FROM t",
    "best_rotation": f"""WITH r AS (SELECT conv_id, turn, {ROTATION} AS score FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations))
SELECT conv_id, CASE WHEN score > 0 THEN turn ELSE 0 END AS turn, score FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) = 1""",
    "doc_type_words": f"""WITH d AS (SELECT doc_id::BIGINT AS doc_id, text AS t FROM ({fixtures.sql('notices')}))
SELECT doc_id, CASE WHEN regexp_matches(t, '{RE2(fixed.MEAL_NOTICE)}') THEN 'meal_notice' ELSE 'general_notice' END AS doc_type, ({MENU_WORDS})::BIGINT AS menu_words, ({NOTICE_WORDS})::BIGINT AS notice_words FROM d""",
    "suspicious_urls": f"WITH {T} SELECT doc_id, len({BAD_URLS}) AS n_bad, {bar(BAD_URLS)} AS bad FROM t",
    "suspicious_phones": f"""WITH {T}, v AS (SELECT doc_id, {BAD_PHONES} AS c, {GATE_PHONES} AS ok FROM t), b AS (SELECT doc_id, list_filter(c, lambda x: NOT list_contains(ok, {DIGITS.format(x='x')})) AS b FROM v)
SELECT doc_id, len(b) AS n_bad, {bar('b')} AS bad FROM b""",
    "pattern_score": f"WITH {T}, {gate_sql('t', 0.9)} SELECT doc_id, 'general_notice' AS doc_type, pattern_score, (core = 0)::INT + (bad_urls > 0)::INT + (bad_phones > 0)::INT AS n_warnings FROM d",
    "gate_decision": f"""WITH {CLEANED}, {gate_sql('cl', 0.9)} SELECT doc_id, 'general_notice' AS doc_type, md5(t) AS clean_md5, text_score, pattern_score, garbage_ratio, len(reasons) = 0 AS auto_pass,
CASE WHEN len(reasons) = 0 THEN 'verified' ELSE 'review' END AS route, {bar('reasons', '; ')} AS reasons FROM d""",
    "route_counts": f"""WITH {CLEANED}, {gate_sql('cl', 0.5)} SELECT CASE WHEN len(reasons) = 0 THEN 'verified' ELSE 'review' END AS route, count(*) AS n,
count(*) FILTER (list_contains(reasons, '{fixed.BELOW_THRESHOLD}')) AS n_below, count(*) FILTER (list_contains(reasons, '{fixed.NO_CORE}')) AS n_no_core FROM d GROUP BY 1""",
    "gate_vs_labels": f"WITH {T}, c AS (SELECT doc_id, t, {profile('t')}, {line_counts('t')} FROM t) SELECT quality, count(*) AS n, avg({scored('t')}) AS mean_score FROM c JOIN labels USING (doc_id) GROUP BY quality",
    "first_section": rf"WITH {T}, f AS (SELECT doc_id, {full_lines('t')} AS ls FROM t) SELECT doc_id, coalesce(list_min(list_filter(list_transform(ls, lambda l, i: CASE WHEN regexp_matches(l, '\d{{1,2}}/\d{{1,2}}') THEN i - 1 END), lambda x: x IS NOT NULL)), -1)::BIGINT AS first_line FROM f",
    "model_input": f"""WITH {NT}, {dedup_ctes('norm')}, b AS (SELECT n.doc_id, length(coalesce(d.text, '')) AS o, len({full_lines('n.t')}) AS before, {strip('c.clean')} AS c FROM norm n JOIN clean c USING (doc_id) JOIN documents d USING (doc_id))
SELECT doc_id, o AS original_length, length(c) AS normalized_length, before AS line_count_before, len({full_lines('c')}) AS line_count_after, greatest(before - len({full_lines('c')}), 0) AS removed_duplicate_lines FROM b""",
    "best_variant": f"""WITH v AS (SELECT conv_id AS doc_id, turn AS ordinal, {normalized("coalesce(text, '')")} AS t FROM conversations), c AS (SELECT doc_id, ordinal, t, {profile('t')}, {line_counts('t')} FROM v WHERE t <> '')
SELECT doc_id, ordinal, {scored('t')} AS quality FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC, ordinal) = 1""",
    "priority_topk": """WITH v AS (SELECT conv_id AS doc_id, turn AS ordinal, CASE WHEN turn % 2 = 0 THEN length(coalesce(text, '')) ELSE 0 END AS p, length(coalesce(text, '')) / 2 AS c FROM conversations)
SELECT doc_id, ordinal, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(nullif(p, 0), nullif(c, 0), 0) DESC, ordinal) AS rank FROM v QUALIFY rank <= 3""",
    "token_prf": overlap_query(TOKENS.format(x=normalized("truth")), TOKENS.format(x=normalized("hyp"))),
    "char_prf": overlap_query(r"list_filter(string_split(regexp_replace(truth, '[ \n]', '', 'g'), ''), lambda x: x <> '')", r"list_filter(string_split(regexp_replace(hyp, '[ \n]', '', 'g'), ''), lambda x: x <> '')"),
    "line_accuracy": f"""WITH {PAIRS}, l AS (SELECT conv_id, turn, {full_lines('truth')} AS a, {full_lines('hyp')} AS b FROM pairs)
SELECT conv_id, turn, CASE WHEN greatest(len(a), len(b)) = 0 THEN 1.0 ELSE len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) / greatest(len(a), len(b)) END AS line_accuracy FROM l""",
    "cer_ascii": rf"""WITH {PAIRS}, q AS (SELECT conv_id, turn, regexp_replace(truth, '[ \n]', '', 'g') AS a, regexp_replace(hyp, '[ \n]', '', 'g') AS b, {normalized('truth')} AS na, {normalized('hyp')} AS nb
FROM pairs WHERE regexp_full_match(truth, '[\x00-\x7F]*') AND regexp_full_match(hyp, '[\x00-\x7F]*'))
SELECT conv_id, turn, CASE WHEN length(a) > 0 THEN levenshtein(a, b) / length(a) ELSE (length(b) > 0)::INT::DOUBLE END AS cer, levenshtein(nb, na) / greatest(length(na), 1) AS gate_cer FROM q""",
    "pattern_merge": f"""WITH d AS (SELECT source, coalesce(text, '') AS t FROM documents), u AS (SELECT source, flatten(list({URLS})) AS u, flatten(list({found('t', fixed.TABLE_DATE, fixed.TABLE_SHORT_DATE)})) AS d FROM d GROUP BY source)
SELECT source, {bar('list_sort(list_distinct(u))')} AS urls, {bar('list_sort(list_distinct(d))')} AS dates FROM u""",
    "word_lines": f"""WITH w AS (SELECT *, round_even(top / 4.0, 0)::BIGINT AS bucket FROM ({fixtures.sql('words')})), g AS (SELECT doc_id, page, trim(string_agg(text, ' ' ORDER BY x0, top, text)) AS text, min(x0) AS x, min(top) AS y,
max(x1) - min(x0) AS width, max(bottom) - min(top) AS height FROM w GROUP BY doc_id, page, bucket) SELECT doc_id::BIGINT AS doc_id, page, text, x, y, width, height FROM g WHERE text <> ''""",
    "event_lines": """WITH w AS (SELECT user_id AS page, event_type AS text, (event_id % 1000)::DOUBLE AS x0, (event_id % 1000 + 5)::DOUBLE AS x1, value AS top, round_even(value / 4.0, 0)::BIGINT AS bucket FROM events WHERE value IS NOT NULL),
g AS (SELECT page, string_agg(text, ' ' ORDER BY x0, top, text) AS text, min(x0) AS x, min(top) AS y, max(x1) - min(x0) AS width FROM w GROUP BY page, bucket) SELECT page, length(text) AS n, md5(text) AS text_md5, x, y, width FROM g""",
    "box_iou": f"""WITH {BOXES}, e AS (SELECT doc_id, ordinal, x - 12 AS x, y - 12 AS y, width + 24 AS width, height + 24 AS height FROM boxes)
SELECT a.doc_id::BIGINT AS doc_id, a.ordinal AS i, b.ordinal AS j, {IOU.format(a='a', b='b')} AS iou, {CONTAINS.format(a='a', b='b')} AS contains, {IOU.format(a='w', b='b')} > 0.05 AS nearby,
least(a.x, b.x) AS u_x, least(a.y, b.y) AS u_y, greatest(a.x + a.width, b.x + b.width) - least(a.x, b.x) AS u_width, greatest(a.y + a.height, b.y + b.height) - least(a.y, b.y) AS u_height
FROM boxes a JOIN boxes b ON a.doc_id = b.doc_id AND a.ordinal < b.ordinal JOIN e w ON w.doc_id = a.doc_id AND w.ordinal = a.ordinal""",
    "box_padding": f"""WITH {BOXES} SELECT doc_id::BIGINT AS doc_id, ordinal, greatest(x - 20, 0) AS p_x, greatest(y - 20, 0) AS p_y, least(x + width + 20, 1000) - greatest(x - 20, 0) AS p_width, least(y + height + 20, 1400) - greatest(y - 20, 0) AS p_height FROM boxes""",
    "box_containment": f"""WITH {BOXES} SELECT doc_id::BIGINT AS doc_id, ordinal, x, y, width, height FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM boxes o WHERE o.doc_id = b.doc_id
AND NOT (o.x = b.x AND o.y = b.y AND o.width = b.width AND o.height = b.height) AND {CONTAINS.format(a='o', b='b')})""",
    "geometry_score": f"""WITH {BOXES}, g AS (SELECT doc_id, ordinal, y, width, height, (ordinal % 5) * 0.02::DOUBLE AS density, width * height AS area, width * height / 1400000 AS share, width / height AS aspect FROM boxes),
f AS (SELECT *, width < 100 OR height < 40 OR share < 0.003 AS small, share > 0.8 AS large, y < 280 AND density < 0.08 AS header, density < 0.015 AS faint FROM g)
SELECT doc_id::BIGINT AS doc_id, ordinal, area, share AS relative_area, aspect AS aspect_ratio, small AS is_too_small, large AS is_too_large, header AS is_header_like, faint AS is_low_text_density,
{bar("list_filter([CASE WHEN small THEN 'too_small' END, CASE WHEN large THEN 'too_large' END, CASE WHEN header THEN 'header_or_logo_like' END, CASE WHEN faint THEN 'low_text_density' END], lambda r: r IS NOT NULL)", ', ')} AS filter_reason,
least(share * 100, 8.0) + least(density * 80, 8.0) + CASE WHEN aspect BETWEEN 1.2 AND 8 THEN 2.0 ELSE 0.0 END - header::INT * 4.0 - small::INT * 5.0 - large::INT * 6.0 - faint::INT * 3.0 AS candidate_priority_score,
NOT (small OR large OR header OR faint) AS is_candidate FROM f""",
    "run_islands": f"""WITH {EVENT_ROWS}, r AS (SELECT user_id, i, value >= 50 AS inside, sum((NOT (value >= 50))::INT) OVER (PARTITION BY user_id ORDER BY i) AS run FROM e)
SELECT user_id, ((min(i) + max(i) + 1) // 2)::BIGINT AS center FROM r WHERE inside GROUP BY user_id, run""",
    "tolerance_dedup": f"WITH {POSITIONS} SELECT user_id, array_to_string({spaced_fold('ps[1]', 'ps[2:]')}, ',') AS kept FROM p",
    "boundaries": f"""WITH {POSITIONS}, k AS (SELECT user_id, {spaced_fold('0', 'list_concat(ps, [1000])')} AS k FROM p), b AS (SELECT user_id, CASE WHEN k[-1] = 1000 THEN k ELSE list_append(k, 1000) END AS b FROM k)
SELECT user_id, len(b) AS n, b[-2] AS second_last FROM b""",
    "line_parameters": """WITH r AS (SELECT unnest([0, 1, 2]) AS i, unnest([3, 5, 8]) AS v), t AS (SELECT unnest([0, 1, 2]) AS i, unnest([0.40::DOUBLE, 0.30::DOUBLE, 0.20::DOUBLE]) AS v),
g AS (SELECT n_nationkey AS table_id, h.i AS hi, h.v AS h_ratio, v.i AS vi, v.v AS v_ratio, t.i AS ti, t.v AS t_fraction, (n_nationkey * h.v + t.i) % 9 AS h, (n_nationkey + v.v * (t.i + 1)) % 8 AS v FROM nation, r h, r v, t),
s AS (SELECT *, (CASE WHEN h = 0 THEN 0.0 ELSE least(h, 5) - greatest(h - 5, 0) * 0.5 END + CASE WHEN v = 0 THEN 0.0 ELSE least(v, 5) - greatest(v - 5, 0) * 0.5 END + CASE WHEN h > 0 AND v > 0 THEN 2.0 ELSE 0.0 END)::DOUBLE AS score FROM g)
SELECT table_id, h_ratio, v_ratio, t_fraction, score FROM s QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY score DESC, hi, vi, ti) = 1""",
    "grids": f"""WITH p AS (SELECT p_partkey AS id, p_size * 20 AS w, (p_partkey % 700 + 50)::INT AS h FROM part), b AS (SELECT *, CASE WHEN w / h >= 2.5 THEN 0 WHEN w / h >= 1.2 THEN 1 WHEN w / h >= 0.8 THEN 2 ELSE 3 END AS band FROM p), g AS ({GRID_ROWS})
SELECT id, ordinal, n_rows, n_cols, array_to_string(list_transform(range(0, n_cols + 1), lambda i: round_even(w * i / n_cols, 0)::INT), ',') AS col_boundaries,
CASE WHEN w / h >= 3 THEN 3 ELSE 2 END AS cols, CASE WHEN w / h < 0.5 THEN 4 WHEN w / h < 1 THEN 3 ELSE 2 END AS rows,
CASE WHEN ordinal >= 3 AND n_rows >= 3 THEN 'line_split' WHEN ordinal >= 3 THEN 'line_split_rows_only' WHEN n_rows >= 3 THEN 'line_split_cols_only' ELSE 'uniform_grid' END AS method FROM b JOIN g USING (band)""",
    "cell_limit": """WITH c AS (SELECT l_suppkey AS table_id, l_quantity AS w, l_tax * 1000 AS h, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_tax * 1000) AS n FROM lineitem)
SELECT table_id, n, CASE WHEN w < 20 OR h < 20 THEN 0.0 ELSE greatest(2.0, least(80.0 / greatest(least(w, h), 1.0), 4.0)) END AS zoom FROM c WHERE n <= 30""",
    "grid_cells": f"""WITH p AS (SELECT p_partkey AS id, p_size * 20 + 100 AS w, p_partkey % 700 + 150 AS h, p_partkey % 3 AS nh, p_partkey % 2 * 2 AS nv FROM part),
m AS (SELECT *, CASE WHEN nh > 0 AND nv > 0 THEN 'line_split' WHEN nh > 0 THEN 'line_split_rows_only' WHEN nv > 0 THEN 'line_split_cols_only' ELSE 'uniform_grid' END AS method FROM p),
g AS (SELECT *, CASE WHEN nh > 0 THEN nh + 1 WHEN nv = 0 THEN 3 WHEN w / h < 0.5 THEN 4 WHEN w / h < 1 THEN 3 ELSE 2 END AS nr, CASE WHEN nv > 0 THEN nv + 1 WHEN nh = 0 THEN 4 WHEN w / h >= 3 THEN 3 ELSE 2 END AS nc FROM m),
r AS (SELECT *, unnest(range(nr)) AS r FROM g), c AS (SELECT *, unnest(range(nc)) AS c FROM r),
b AS (SELECT id, method, r, c, {edge('c', 'nc', 'nv', 'w', 30)} AS x, {edge('r', 'nr', 'nh', 'h', 40)} AS y, {edge('c + 1', 'nc', 'nv', 'w', 30)} AS x2, {edge('r + 1', 'nr', 'nh', 'h', 40)} AS y2 FROM c)
SELECT id, method, r::INT AS "row", c::INT AS col, x, y, x2 - x AS w, y2 - y AS h, CASE WHEN x2 - x < 20 OR y2 - y < 20 THEN 0.0 ELSE greatest(2.0, least(80.0 / least(x2 - x, y2 - y), 4.0)) END::DOUBLE AS zoom FROM b""",
    "highlight_exact_substring": rf"""WITH d AS (SELECT doc_id, unnest({full_lines("coalesce(text, '')")}) AS l, generate_subscripts({full_lines("coalesce(text, '')")}, 1) - 1 AS line FROM documents),
k AS (SELECT doc_id, line, lower(regexp_replace(l, '[^0-9A-Za-z가-힣]+', '', 'g')) AS c FROM d), b AS (SELECT item_id, lower(regexp_replace(text, '[^0-9A-Za-z가-힣]+', '', 'g')) AS q FROM benchmark)
SELECT item_id, doc_id, line, length(q) / length(c) AS score FROM b JOIN k ON length(q) >= 24 AND contains(c, q)""",
    "collected_text": """WITH v AS (SELECT conv_id AS doc_id, turn AS ordinal, turn % 3 AS p, coalesce(text, '') AS t FROM conversations), o AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY doc_id, p ORDER BY ordinal) = 1),
a AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY ordinal) AS t FROM o GROUP BY doc_id) SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM a""",
    "duplicate_lines": f"""WITH {T}, l AS (SELECT doc_id, unnest({full_lines('t')}) AS x FROM t), k AS (SELECT doc_id, {compact('x')} AS k, count(*) AS n FROM l GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*) AS n_distinct, max(n) AS most FROM k GROUP BY doc_id""",
    "score_islands": f"""WITH {T}, l AS (SELECT doc_id, unnest({full_lines('t')}) AS x, generate_subscripts({full_lines('t')}, 1) - 1 AS i FROM t),
r AS (SELECT doc_id, i, length(x) >= 40 AS inside, sum((length(x) < 40)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM l) SELECT doc_id, min(i) AS first_line, count(*) AS n FROM r WHERE inside GROUP BY doc_id, run""",
    "longest_lines": f"""WITH {T}, l AS (SELECT doc_id, unnest({full_lines('t')}) AS x, generate_subscripts({full_lines('t')}, 1) - 1 AS line_no FROM t), m AS (SELECT doc_id, line_no, {n('x', M)} AS meaningful FROM l)
SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY meaningful DESC, line_no) AS rank, meaningful FROM m QUALIFY rank <= 3""",
    "slot_corrections": f"SELECT case_id, expected AS corrected, CASE case_id WHEN 'OCR-SLOT-002' THEN 2 WHEN 'OCR-SLOT-003' THEN 2 WHEN 'OCR-SLOT-004' THEN 2 WHEN 'OCR-SLOT-006' THEN 0 WHEN 'OCR-SLOT-007' THEN 5 ELSE 1 END AS n, false AS review_required FROM ({fixtures.sql('slot_cases')})",
}
