"""SQL for the queries, in DuckDB's dialect, over the same tables."""

from permway.functions import lexicon as L
from permway.plans.queries import COLLECTION_START, NOW


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _i(pattern: str) -> str:
    return _q("(?i)" + pattern)


_LEX = ", ".join(f"({_q(c)}, {_q(f)}, {_q(label)}, {_i(p)})" for c, f, label, p in L.CATEGORIES)
_SUBJECT = " AND ".join(f"NOT regexp_matches(coalesce({c}, ''), {_i(p)})" for c in ("head", "text") for p in (L.MACHINE_OUT, L.TEST_ALERT))


def _plain(x: str) -> str:
    t = f"coalesce({x}, '')"
    for _ in range(2):
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#38;", "&"), ("&nbsp;", " "), ("&amp;", "&")):
            t = f"replace({t}, '{entity}', '{char}')"
    t = f"regexp_replace({t}, {_q(L.BLOCK)}, '. ', 'gi')"
    t = f"regexp_replace({t}, {_q(L.TAG)}, ' ', 'g')"
    t = f"trim(regexp_replace(replace({t}, chr(160), ' '), '\\s+', ' ', 'g'))"
    return f"regexp_replace({t}, '\\s*\\.(\\s*\\.)+', '.', 'g')"


def _readable(x: str) -> str:
    t = f"regexp_replace({_plain(x)}, {_q(L.APOLOGY)}, ' ', 'gi')"
    t = f"regexp_replace({t}, {_q(L.INITIALS)}, '')"
    t = f"regexp_replace({t}, {_q(L.UPDATE_STAMP)}, '', 'i')"
    return f"trim(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' .,-')"


def _sentences(x: str) -> str:
    """A list: full stops beside a digit are kept from the cut by another character."""
    t = f"regexp_replace(regexp_replace({x}, '(\\d)\\.', '\\1' || chr(2), 'g'), '\\.(\\d)', chr(2) || '\\1', 'g')"
    t = f"replace(replace({t}, ' - ', ' ' || chr(1) || ' '), ' - ', ' ' || chr(1) || ' ')"
    parts = f"string_split_regex({t}, '[.;?!' || chr(1) || ']')"
    parts = f"list_filter({parts}, lambda p: trim(replace(p, chr(2), '.'), ' ,.') <> '')"
    return f"list_transform({parts}, lambda p: trim(replace(p, chr(2), '.'), ' ,'))"


def _minutes(x: str) -> str:
    return f"try_cast(nullif(regexp_extract(replace(coalesce({x}, ''), chr(160), ' '), {_i(L.MINUTES)}, 1), '') AS INT)"


_MARKER, _TAIL = _i(L.MARKER), _i(L.TAIL)


def _segments(sentence: str) -> str:
    """A list of (marker, clause) without empty clauses."""
    marks, parts = f"regexp_extract_all({sentence}, {_MARKER}, 1)", f"string_split_regex({sentence}, {_MARKER})"
    cut = f"trim(string_split_regex({parts}[i + 1], {_TAIL})[1], ' ,.-')"
    made = f"list_transform(range(1, len({marks}) + 1), lambda i: {{'marker': lower({marks}[i]), 'clause': {cut}}})"
    return f"list_filter({made}, lambda z: z.clause <> '')"


def _reading(source: str) -> str:
    """Common tables of the readings of `source` (id, head, text): `causes` (id, ord, ...) and `unread` (id, ord, clause)."""
    unmarked = ", ".join(map(_q, L.UNMARKED))
    losers = ", ".join(map(_q, L.BEATS["vehicle_strike"]))
    return f"""
    lex(category, family, label, pat) AS (VALUES {_LEX}),
    src AS MATERIALIZED ({source}),
    clean AS MATERIALIZED (SELECT id, {_readable("head")} AS h, {_readable("text")} AS t FROM src),
    sents AS MATERIALIZED (SELECT id, 0 AS fld, unnest({_sentences("h")}) AS s, generate_subscripts({_sentences("h")}, 1) AS sord FROM clean
        UNION ALL SELECT id, 1, unnest({_sentences("t")}), generate_subscripts({_sentences("t")}, 1) FROM clean),
    segs AS MATERIALIZED (SELECT id, fld, sord, unnest({_segments("s")}) AS g, generate_subscripts({_segments("s")}, 1) AS gord FROM sents),
    clauses AS MATERIALIZED (SELECT id, fld, sord, gord, g.clause AS clause, g.marker AS marker, CASE WHEN gord = 1 THEN 'proximate' ELSE 'root' END AS role FROM segs
        UNION ALL SELECT id, fld, sord, 1, s, '', 'proximate' FROM sents WHERE id NOT IN (SELECT id FROM segs)),
    hits0 AS (SELECT c.*, x.category, x.family, x.label, regexp_extract(clause, pat) AS matched, regexp_matches(clause, {_i(L.EARLIER)}) AS earlier
        FROM clauses c JOIN lex x ON regexp_matches(c.clause, x.pat)),
    hits AS MATERIALIZED (SELECT *, strpos(clause, matched) AS place FROM hits0 h WHERE NOT (category IN ({losers})
        AND EXISTS (SELECT 1 FROM hits0 v WHERE v.category = 'vehicle_strike' AND (v.id, v.fld, v.sord, v.gord) = (h.id, h.fld, h.sord, h.gord)))),
    kept AS (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY fld, sord, gord) AS rn FROM hits WHERE marker <> '' OR category IN ({unmarked})),
    causes AS MATERIALIZED (SELECT id, row_number() OVER (PARTITION BY id ORDER BY fld, sord, gord, place, category) - 1 AS ord, category, family, label, clause AS phrase, matched, marker, role, earlier
        FROM kept k WHERE rn = 1 AND NOT (category IN ({losers}) AND EXISTS (SELECT 1 FROM kept v WHERE v.category = 'vehicle_strike' AND v.id = k.id))),
    unread AS MATERIALIZED (SELECT DISTINCT id, clause FROM clauses c WHERE marker <> '' AND NOT EXISTS (SELECT 1 FROM lex x WHERE regexp_matches(c.clause, x.pat)))
    """


_NOTICES = "SELECT notice_id AS id, head, text FROM notices"
_READ = "WITH " + _reading(_NOTICES)

_NO_ERROR = "(network_error IS NULL OR network_error = '')"
def _strict(x: str, kind: str) -> str:
    """Whether a text is strict JSON of a kind; the reader's leniencies are looked for outside of strings."""
    bare = f"""regexp_replace({x}, '"(\\\\.|[^"\\\\])*"', 's', 'g')"""
    return f"(CASE WHEN {x} IS NOT NULL AND json_valid({x}) THEN json_type({x}) = '{kind}' AND NOT regexp_matches({bare}, ',\\s*[\\]}}]|NaN|Infinity|nan|inf') ELSE false END)"


def _strict_array(x: str) -> str:
    return _strict(x, "ARRAY")


_STRICT = _strict_array("body")
_LOG = f"""lines AS (SELECT line_id, line FROM raw_lines WHERE file_name LIKE '%.jsonl' AND {_strict('line', 'OBJECT')}),
    poll_log AS (SELECT line_id, CASE WHEN regexp_full_match(line->>'http_status', '\\d{{1,9}}') AND json_type(line, '$.http_status') <> 'VARCHAR' THEN (line->>'http_status')::INT END AS http_status,
        CASE WHEN coalesce(line->'network_error', 'null') NOT IN ('null', 'false', '0', '""', '[]', '{{}}') THEN line->>'network_error' END AS network_error, line->>'fetched_at_utc' AS fetched_at_utc,
        CASE WHEN json_type(line, '$.body') = 'VARCHAR' THEN line->>'body' END AS body FROM lines)"""
_GOOD = f"""good AS (SELECT * FROM poll_runs WHERE http_status = 200 AND {_NO_ERROR} AND {_strict_array('body')}),
    timed AS (SELECT *, try_strptime(fetched_at_utc, '%Y-%m-%dT%H:%M:%SZ') AS tm FROM good WHERE try_strptime(fetched_at_utc, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL),
    horizon AS (SELECT max(tm) AS horizon, count(*) AS runs FROM timed)"""


def _items(source: str) -> str:
    strip = lambda x: f"regexp_replace(coalesce({x}, ''), '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"
    field = lambda f: strip(f"json_extract_string(e, '$.{f}')") + f" AS {f}"
    stop = lambda f: f"nullif({strip(f'''json_extract_string(e, '$.eventStops[0].{f}')''')}, '')"
    legs = "CASE WHEN json_type(e, '$.eventStops') = 'ARRAY' THEN json_array_length(e, '$.eventStops')::INT ELSE 0 END AS legs"
    codes = "CASE WHEN json_type(e, '$.locationCodes') = 'ARRAY' THEN array_to_string(list_filter(json_extract_string(e, '$.locationCodes[*]'), lambda c: c IS NOT NULL), '|') ELSE '' END AS codes"
    return f"""els AS (SELECT *, unnest(range(json_array_length(body)::BIGINT))::INT AS item_pos FROM {source}),
    raw AS (SELECT *, json_extract(body, '$[' || item_pos || ']') AS e FROM els),
    items AS (SELECT *, {field("head")}, {field("text")}, {field("start")}, {stop("sStop")} AS origin, {stop("eStop")} AS destination, {legs}, {codes} FROM raw WHERE json_type(e) = 'OBJECT')"""


def _listed(record: str, field: str) -> str:
    """The elements of a field as a list of JSON values: none for null, a single value as one."""
    return f"CASE json_type({record}, '$.{field}') WHEN 'ARRAY' THEN json_extract({record}, '$.{field}[*]') WHEN 'NULL' THEN [] ELSE list_filter([json_extract({record}, '$.{field}')], lambda v: v IS NOT NULL) END"


_FORMATS = [
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y/%m/%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d.%m.%Y %H.%M", "%d %b %Y %H:%M", "%d %B %Y, %I:%M %p",
    "%a, %d %b %Y %H:%M:%S", "%Y%m%dT%H%M%S", "%Y%m%d%H%M%S",
]


def _instants(name: str, source: str, text: str, local: bool) -> str:
    """Common tables up to `name`: `source` with `us`, the UTC microseconds of `text`, and `odd`, whether its local time is shown twice or never."""
    last_sunday = lambda month: f"(last_day(make_date(year(l), {month}, 1)) - dayofweek(last_day(make_date(year(l), {month}, 1)))::INT)::TIMESTAMP"
    spring, autumn = last_sunday(3), last_sunday(10)
    summer = f"CASE WHEN l >= {spring} + INTERVAL 2 HOUR AND l < {autumn} + INTERVAL 2 HOUR THEN 60 ELSE 0 END"
    digits = "regexp_replace(z, '[^0-9]', '', 'g')"
    written = f"(CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END) * (left({digits}, 2)::INT * 60 + coalesce(nullif(substr({digits}, 3), ''), '0')::INT)"
    within = lambda day: f"(l >= {day} + INTERVAL 1 HOUR AND l < {day} + INTERVAL 2 HOUR)"
    formats = ", ".join(map(_q, _FORMATS))
    return f"""{name}0 AS (SELECT *, regexp_extract({text}, '(Z|UTC|GMT|IST|Europe/Dublin|[+-]\\d{{1,2}}(:?\\d{{2}})?)(\\[[A-Za-z/]+\\])?$', 1) AS z,
        trim(regexp_replace({text}, '(Z|UTC|GMT|IST|Europe/Dublin|[+-]\\d{{1,2}}(:?\\d{{2}})?)(\\[[A-Za-z/]+\\])?$', '')) AS b FROM {source}),
    {name}1 AS (SELECT *, regexp_extract(b, ':\\d{{1,2}}[.](\\d+)$', 1) AS fr, try_strptime(regexp_replace(b, '(:\\d{{1,2}})[.]\\d+$', '\\1'), [{formats}]) AS l FROM {name}0),
    {name} AS (SELECT *, CASE WHEN regexp_full_match({text}, '\\d{{10}}') THEN {text}::BIGINT * 1000000 WHEN regexp_full_match({text}, '\\d{{13}}') THEN {text}::BIGINT * 1000
        ELSE epoch_us(l) - 60000000::BIGINT * (CASE WHEN regexp_matches(z, '^[+-]') THEN {written} WHEN z = 'IST' THEN 60 WHEN z IN ('Z', 'UTC', 'GMT') THEN 0 WHEN z = 'Europe/Dublin' OR {local} THEN {summer} ELSE 0 END)
            + left(rpad(fr, 6, '0'), 6)::BIGINT END AS us, {within(spring)} OR {within(autumn)} AS odd FROM {name}1)"""


_CELL = '("(?:[^"]|"")*"|[^",\\r\\n]*)'
_RECORD = ",".join([_CELL] * 4)


def _cell(x: str) -> str:
    return f"""CASE WHEN {x} LIKE '"%' THEN replace(substr({x}, 2, length({x}) - 2), '""', '"') ELSE {x} END"""


_FOLD = f"""
    seen AS MATERIALIZED (SELECT sighting_id, sighting_id AS seq, head, text, start, nullif(origin, '') AS origin, nullif(destination, '') AS destination, seen_at, legs FROM sightings WHERE {_SUBJECT} AND seen_at IS NOT NULL),
    net AS (SELECT start FROM seen GROUP BY start HAVING max(coalesce(legs, 0)) > 1),
    routes AS (SELECT DISTINCT start, origin, destination FROM seen WHERE origin IS NOT NULL OR destination IS NOT NULL),
    single AS (SELECT start, any_value({{'o': origin, 'd': destination}}) AS r FROM routes GROUP BY start HAVING count(*) = 1),
    last AS (SELECT start, head, text, arg_max({{'o': origin, 'd': destination}}, (seen_at, seq)) AS r FROM seen WHERE origin IS NOT NULL OR destination IS NOT NULL GROUP BY ALL),
    branched AS (SELECT s.*, CASE WHEN n.start IS NOT NULL OR (s.start IS NULL AND EXISTS (SELECT 1 FROM net WHERE start IS NULL)) THEN 'network' WHEN origin IS NOT NULL OR destination IS NOT NULL THEN 'own' WHEN g.r IS NOT NULL THEN 'single' WHEN l.r IS NOT NULL THEN 'wording' ELSE 'none' END AS branch, g.r AS gr, l.r AS lr
        FROM seen s LEFT JOIN net n ON s.start = n.start LEFT JOIN single g ON s.start IS NOT DISTINCT FROM g.start LEFT JOIN last l ON s.start IS NOT DISTINCT FROM l.start AND s.head IS NOT DISTINCT FROM l.head AND s.text IS NOT DISTINCT FROM l.text),
    resolved AS MATERIALIZED (SELECT *, CASE branch WHEN 'network' THEN '{L.SEVERAL}' WHEN 'own' THEN origin WHEN 'single' THEN gr.o WHEN 'wording' THEN lr.o END AS route_from,
        CASE branch WHEN 'own' THEN destination WHEN 'single' THEN gr.d WHEN 'wording' THEN lr.d END AS route_to FROM branched),
    lagged AS (SELECT *, lag({{'h': head, 't': text}}) OVER w AS prev, row_number() OVER w AS rn FROM resolved WINDOW w AS (PARTITION BY start, route_from, route_to ORDER BY seen_at, seq)),
    changes AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY start, route_from, route_to) AS k FROM lagged WHERE rn = 1 OR prev.h IS DISTINCT FROM head OR prev.t IS DISTINCT FROM text)"""
_WORDINGS = """SELECT row_number() OVER () AS id, * FROM (SELECT k, head, text, min((seen_at, seq)) AS wt FROM changes GROUP BY k, head, text)"""
_DISRUPTIONS = f"""WITH {_FOLD}, {_reading(_WORDINGS)},
    kc AS (SELECT s.k, c.category, c.family, c.label, s.wt, c.ord, row_number() OVER (PARTITION BY s.k, c.category ORDER BY s.wt, c.ord) AS rn FROM src s JOIN causes c ON s.id = c.id),
    dc AS MATERIALIZED (SELECT k, category, family, label, row_number() OVER (PARTITION BY k ORDER BY wt, ord) - 1 AS pos FROM kc WHERE rn = 1),
    cl AS (SELECT k, string_agg(category, ',' ORDER BY pos) AS causes, count_if(family = 'origin') AS origins, count_if(family = 'consequence') AS cons, count_if(family <> 'unstated') AS others FROM dc GROUP BY k),
    spans AS (SELECT start, route_from, route_to, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS sightings FROM resolved GROUP BY ALL),
    ups AS (SELECT k, start, route_from, route_to, count(*) AS n_updates, arg_max({{'h': head, 't': text}}, (seen_at, seq)) AS latest, arg_min(seq, (seen_at, seq)) AS first_seq FROM changes GROUP BY ALL),
    figs AS (SELECT k, max(coalesce({_minutes("head")}, {_minutes("text")})) AS minutes, bool_and(regexp_matches(coalesce(head, '') || ' ' || coalesce(text, ''), {_i(L.CAPACITY)})) AS is_capacity FROM src GROUP BY k),
    dis AS MATERIALIZED (SELECT u.k, u.start, CASE WHEN u.route_from <> u.route_to THEN u.route_from || ' to ' || u.route_to ELSE coalesce(u.route_from, u.route_to, '{L.UNNAMED}') END AS route, latest.h AS head, latest.t AS text,
        first_seen, last_seen, sightings, n_updates, minutes, is_capacity, first_seq, coalesce(causes, '') AS causes, coalesce(origins, 0) AS origins, coalesce(cons, 0) AS cons, coalesce(others, 0) AS others,
        (first_seen AT TIME ZONE 'Europe/Dublin')::DATE AS day FROM ups u JOIN spans s ON u.start IS NOT DISTINCT FROM s.start AND u.route_from IS NOT DISTINCT FROM s.route_from AND u.route_to IS NOT DISTINCT FROM s.route_to
        JOIN figs f ON u.k = f.k LEFT JOIN cl ON u.k = cl.k),
    found AS (SELECT *, strftime(day, '%Y-%m') AS ym FROM dis WHERE NOT is_capacity)"""
_LOCAL = "(timezone('Europe/Dublin', timezone('UTC', {})))::DATE"
_START_DAY = _LOCAL.format(f"TIMESTAMP '{COLLECTION_START}'")
_TODAY = _LOCAL.format(f"TIMESTAMP '{NOW}'")
_MONTHS = f"""{_GOOD}, ml AS (SELECT unnest(generate_series(date_trunc('month', {_START_DAY})::TIMESTAMP, date_trunc('month', {_LOCAL.format("horizon")})::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m FROM horizon
    UNION SELECT date_trunc('month', day)::DATE FROM found),
    days AS (SELECT m, unnest(generate_series(m::TIMESTAMP, (m + INTERVAL 1 MONTH - INTERVAL 1 DAY)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM ml),
    per AS (SELECT day, count(*) AS n FROM found GROUP BY day),
    counted AS (SELECT strftime(m, '%Y-%m') AS ym, day, CASE WHEN day <= {_LOCAL.format("horizon")} AND day >= {_START_DAY} THEN coalesce(n, 0) END AS total FROM days LEFT JOIN per USING (day) CROSS JOIN horizon),
    flagged AS (SELECT *, total IS NULL AND day > {_TODAY} AS future FROM counted)"""


def _golden(select: str) -> str:
    wordings = lambda where: f"SELECT DISTINCT coalesce(head, '') AS head, coalesce(text, '') AS text FROM notices WHERE {where}"
    return f"""WITH {_reading("SELECT row_number() OVER () AS id, * FROM (SELECT DISTINCT coalesce(head, '') AS head, coalesce(text, '') AS text FROM notices)")},
    told AS (SELECT id, string_agg(category, ',' ORDER BY ord) AS told, string_agg(CASE WHEN category = 'signalling' THEN 'points' ELSE category END, ',' ORDER BY ord) AS renamed FROM causes GROUP BY id),
    missed AS (SELECT id, bool_or(upper(clause) <> clause) AS louder FROM unread GROUP BY id),
    readings AS (SELECT head, text, coalesce(told, '') AS told, coalesce(renamed, '') AS renamed, coalesce(louder, false) AS louder FROM src LEFT JOIN told USING (id) LEFT JOIN missed USING (id)),
    stored AS (SELECT * FROM readings SEMI JOIN ({wordings("notice_id % 2 = 0")}) USING (head, text)),
    cur AS (SELECT * FROM readings SEMI JOIN ({wordings("notice_id % 3 <> 0")}) USING (head, text)) {select}"""


_SNAPSHOTS = f"""WITH good5 AS (SELECT * FROM poll_runs WHERE http_status = 200 AND network_error IS NULL AND {_STRICT}), {_instants("t", "good5", "fetched_at_utc", False)},
        snaps AS (SELECT run_id, feed, body, row_number() OVER (PARTITION BY feed ORDER BY us, run_id) AS n FROM t WHERE us IS NOT NULL),
        els AS (SELECT run_id, feed, n, unnest(json_extract(body, '$[*]')) AS e, generate_subscripts(json_extract(body, '$[*]'), 1) AS pos FROM snaps),
        its AS MATERIALIZED (SELECT feed, n, json_extract_string(e, '$.itemRef') AS ref, arg_min(e, pos) AS e FROM els WHERE json_type(e) = 'OBJECT' AND json_type(e, '$.itemRef') NOT IN ('NULL') GROUP BY ALL)"""
_FAULTS = f"""WITH j0 AS (SELECT line_id, line, CASE WHEN line IS NOT NULL AND json_valid(line) THEN json_type(line) = 'OBJECT' AND NOT regexp_matches(regexp_replace(line, '"(\\\\.|[^"\\\\])*"', 's', 'g'), ',\\s*[\\]}}]|NaN|Infinity|nan|inf')
            AND json_exists(line, '$.http_status') AND json_exists(line, '$.network_error') AND json_exists(line, '$.fetched_at_utc') AND json_exists(line, '$.body') ELSE false END AS fine FROM raw_lines WHERE file_name LIKE '%.jsonl'),
        j AS (SELECT line_id, json_type(line, '$.http_status') AS ht, json_extract_string(line, '$.http_status') AS h, json_type(line, '$.network_error') AS nt, json_extract_string(line, '$.network_error') AS n,
            json_type(line, '$.body') AS bt, json_extract_string(line, '$.body') AS b FROM j0 WHERE fine),
        c0 AS (SELECT line_id, line, coalesce(regexp_full_match(line, '{_RECORD}'), false) AS fine FROM raw_lines WHERE file_name LIKE '%.csv'),
        c1 AS (SELECT line_id, regexp_extract(line, '^{_RECORD}$', ['f', 'h', 'n', 'b']) AS x FROM c0 WHERE fine),
        c AS (SELECT line_id, {_cell("x.h")} AS h, {_cell("x.n")} AS n, {_cell("x.b")} AS b FROM c1),
        faults AS (SELECT line_id, 'line' AS fault FROM j0 WHERE NOT fine UNION ALL SELECT line_id, 'line' FROM c0 WHERE NOT fine
        UNION ALL SELECT line_id, CASE WHEN NOT (ht = 'NULL' OR (ht IN ('UBIGINT', 'BIGINT') AND regexp_full_match(h, '[1-5][0-9]{{2}}'))) THEN 'http_status'
            WHEN NOT (nt = 'NULL' OR (nt = 'BOOLEAN' AND n = 'false') OR (nt = 'VARCHAR' AND regexp_full_match(n, '[A-Za-z_]*'))) THEN 'network_error'
            WHEN h = '200' AND (nt <> 'VARCHAR' OR n IN ('', 'false')) AND NOT (bt = 'VARCHAR' AND {_strict_array("b")}) THEN 'body' END FROM j
        UNION ALL SELECT line_id, CASE WHEN h <> '' AND NOT regexp_full_match(h, '[1-5][0-9]{{2}}') THEN 'http_status' WHEN NOT regexp_full_match(n, '[A-Za-z_]*') THEN 'network_error'
            WHEN h = '200' AND n IN ('', 'false') AND NOT {_strict_array("b")} THEN 'body' END FROM c)"""
_NESTED = f"""WITH polls AS (SELECT run_id, body FROM poll_runs WHERE {_STRICT}),
        els AS (SELECT run_id, body, unnest(range(json_array_length(body)::BIGINT))::INT AS item_pos FROM polls),
        items AS (SELECT run_id, item_pos, json_extract(body, '$[' || item_pos || ']') AS e FROM els WHERE json_type(body, '$[' || item_pos || ']') = 'OBJECT'),
        codes AS (SELECT run_id, item_pos, {_listed("e", "locationCodes")} AS l FROM items),
        code AS (SELECT run_id, item_pos, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM codes),
        stops AS (SELECT run_id, item_pos, {_listed("e", "eventStops")} AS l FROM items),
        leg AS (SELECT * FROM (SELECT run_id, item_pos, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS pos FROM stops) WHERE json_type(x) = 'OBJECT'),
        vias AS (SELECT run_id, item_pos, pos, {_listed("x", "via")} AS l FROM leg),
        via AS (SELECT * FROM (SELECT run_id, item_pos, pos, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS sub_pos FROM vias) WHERE json_type(x) = 'OBJECT')"""
_VIA_KEY = "run_id || '/' || item_pos || '/l' || pos || '/v' || sub_pos"
_OBJECT_PART = "CASE WHEN json_type(x, '$.platform') = 'OBJECT' THEN json_extract_string(x, '$.platform.{}') END"

ORACLE = {
    "p6_items": f"""{_NESTED} SELECT run_id, item_pos, run_id || '/' || item_pos AS pk, run_id::VARCHAR AS parent_pk, e->>'itemRef' AS item_ref, e->>'head' AS head, e->>'text' AS text, e->>'start' AS start FROM items""",
    "p6_vias": f"""{_NESTED} SELECT run_id, item_pos, pos::INT AS pos, sub_pos::INT AS sub_pos, {_VIA_KEY} AS pk, run_id || '/' || item_pos || '/l' || pos AS parent_pk, x->>'stop' AS stop,
        {_OBJECT_PART.format("no")} AS platform_no, {_OBJECT_PART.format("side")} AS platform_side FROM via""",
    "p6_calls": f"""{_NESTED}, called AS (SELECT run_id, item_pos, pos, sub_pos, {_listed("x", "calls")} AS l FROM via),
        each AS (SELECT run_id, item_pos, pos, sub_pos, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS n FROM called)
        SELECT run_id, item_pos, pos::INT AS pos, sub_pos::INT AS sub_pos, {_VIA_KEY} || '/a' || n AS pk, {_VIA_KEY} AS parent_pk, x->>'due' AS due FROM each WHERE json_type(x) = 'OBJECT'""",
    "log_decode": f"WITH {_LOG} SELECT * FROM poll_log",
    "log_horizon": f"WITH {_LOG}, {_GOOD.replace('FROM poll_runs', 'FROM poll_log')} SELECT epoch_us(horizon) AS horizon, runs FROM horizon",
    "log_items": f"WITH {_LOG}, {_GOOD.replace('FROM poll_runs', 'FROM poll_log')}, {_items('good')} SELECT line_id, item_pos, head, text, start, origin, destination, legs, codes FROM items",
    "runs_horizon": f"WITH {_GOOD} SELECT epoch_us(horizon) AS horizon, runs FROM horizon",
    "sightings_decode": f"WITH {_GOOD}, {_items('timed')} SELECT run_id, item_pos, head, text, start, origin, destination, legs, epoch_us(tm) AS seen_at FROM items",
    "notices_decode": f"WITH {_GOOD}, {_items('good')} SELECT run_id, item_pos, head, text, start, codes FROM items",
    "subject_filter": f"SELECT notice_id FROM notices WHERE {_SUBJECT}",
    "plain_text": f"SELECT notice_id, {_plain('head')} AS head, {_plain('text')} AS text FROM notices",
    "readable_text": f"SELECT notice_id, {_readable('head')} AS head, {_readable('text')} AS text FROM notices",
    "sentence_split": f"WITH {_reading(_NOTICES)} SELECT id AS notice_id, fld AS field, (sord - 1)::INT AS pos, s AS sentence FROM sents",
    "marker_segments": f"WITH {_reading(_NOTICES)} SELECT id AS notice_id, fld AS field, (sord - 1)::INT AS pos, (gord - 1)::INT AS seg, g.marker AS marker, g.clause AS clause FROM segs",
    "clause_cut": f"WITH {_reading(_NOTICES)} SELECT id AS notice_id, fld AS field, (sord - 1)::INT AS pos, trim(string_split_regex(s, {_TAIL})[1], ' ,.-') AS clause FROM sents",
    "cause_read": f"{_READ} SELECT id AS notice_id, ord::INT AS pos, category, family, label, phrase, matched, marker, role, earlier FROM causes",
    "unread_clauses": f"{_READ} SELECT clause, count(*) AS n FROM unread GROUP BY clause",
    "silent_notices": f"{_READ} SELECT notice_id FROM notices WHERE notice_id NOT IN (SELECT id FROM causes UNION SELECT id FROM unread)",
    "category_histogram": f"{_READ} SELECT category, label, count(*) AS n FROM causes GROUP BY ALL",
    "family_histogram": f"{_READ} SELECT family, count(*) AS n FROM causes GROUP BY ALL",
    "origin_causes": f"{_READ} SELECT id AS notice_id, string_agg(category, ',' ORDER BY ord) AS origins FROM causes WHERE family = 'origin' GROUP BY id",
    "shown_causes": f"""{_READ} SELECT notice_id, coalesce(CASE WHEN count_if(family <> 'unstated') > 0 THEN string_agg(category, ',' ORDER BY ord) FILTER (family <> 'unstated') ELSE string_agg(category, ',' ORDER BY ord) END, '') AS shown
        FROM notices LEFT JOIN causes ON notice_id = id GROUP BY notice_id""",
    "claimed_minutes": f"SELECT notice_id, coalesce({_minutes('head')}, {_minutes('text')}) AS minutes FROM notices",
    "distinct_notices": "SELECT head, text, f.s AS start, f.a AS first_seen, n AS sightings FROM (SELECT head, text, arg_min({'s': start, 'a': epoch_us(seen_at)}, sighting_id) AS f, count(*) AS n FROM sightings GROUP BY head, text)",
    "poll_notices": f"WITH {_GOOD}, {_items('good')} SELECT head, text, f.s AS start, f.c AS codes, f.t AS first_seen, n AS sightings FROM (SELECT head, text, arg_min({{'s': start, 'c': codes, 't': fetched_at_utc}}, (run_id, item_pos)) AS f, count(*) AS n FROM items GROUP BY head, text)",
    "network_starts": f"SELECT start FROM sightings WHERE {_SUBJECT} GROUP BY start HAVING max(coalesce(legs, 0)) > 1",
    "routes_by_start": f"SELECT start, nullif(origin, '') AS origin, nullif(destination, '') AS destination, count(*) AS n FROM sightings WHERE {_SUBJECT} AND (nullif(origin, '') IS NOT NULL OR nullif(destination, '') IS NOT NULL) GROUP BY ALL",
    "resolve_route": f"WITH {_FOLD} SELECT sighting_id, route_from, route_to, branch FROM resolved",
    "updates_log": f"WITH {_FOLD} SELECT start, route_from, route_to, epoch_us(seen_at) AS seen_at, seq, head, text FROM changes",
    "disruptions": f"{_DISRUPTIONS} SELECT start, route, head, text, epoch_us(first_seen) AS first_seen, epoch_us(last_seen) AS last_seen, sightings, n_updates, minutes, is_capacity, causes FROM dis",
    "capacity_split": f"{_DISRUPTIONS} SELECT is_capacity, count(*) AS n FROM dis GROUP BY is_capacity",
    "capacity_by_month": f"{_DISRUPTIONS} SELECT strftime(day, '%Y-%m') AS ym, count(*) AS n FROM dis WHERE is_capacity GROUP BY 1",
    "month_list": f"{_DISRUPTIONS}, {_MONTHS} SELECT strftime(m, '%Y-%m') AS ym FROM ml",
    "day_counts": f"{_DISRUPTIONS}, {_MONTHS} SELECT ym, strftime(day, '%Y-%m-%d') AS day, total, future FROM flagged",
    "day_band": f"""{_DISRUPTIONS}, {_MONTHS} SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN future THEN '9' WHEN total IS NULL THEN '8' WHEN total = 0 THEN '0' WHEN total <= 3 THEN '1' WHEN total <= 9 THEN '2' ELSE '3' END AS band,
        CASE WHEN future THEN 'still to come' WHEN total IS NULL THEN 'the collector missed this day' WHEN total = 0 THEN 'nothing listed' WHEN total = 1 THEN '1 disruption' ELSE total || ' disruptions' END AS caption FROM flagged""",
    "day_family_counts": f"""{_DISRUPTIONS}, df AS (SELECT DISTINCT k, family FROM dc) SELECT strftime(day, '%Y-%m-%d') AS day, family, count(*) AS n FROM found f LEFT JOIN df ON f.k = df.k GROUP BY ALL""",
    "month_tiles": f"{_DISRUPTIONS} SELECT ym, count(*) AS listed, count_if(origins > 0)::BIGINT AS named, count_if(cons > 0)::BIGINT AS blamed, count_if(others = 0)::BIGINT AS silent FROM found GROUP BY ym",
    "routes_named": f"{_DISRUPTIONS} SELECT ym, count(DISTINCT route) FILTER (route <> '{L.UNNAMED}') AS routes FROM found GROUP BY ym",
    "origin_ranking": f"""{_DISRUPTIONS}, oc AS (SELECT ym, category, label, count(*) AS n, min((first_seen, route, first_seq, pos)) AS first FROM found JOIN dc USING (k) WHERE family = 'origin' GROUP BY ALL)
        SELECT ym, category, label, n, greatest(2, round_even(100 * n / max(n) OVER (PARTITION BY ym), 0))::INT AS width, row_number() OVER (PARTITION BY ym ORDER BY n DESC, first)::INT AS place FROM oc""",
    "paged_cases": f"""{_DISRUPTIONS}, pl AS (SELECT *, row_number() OVER (PARTITION BY ym ORDER BY first_seen DESC, route, first_seq) AS place, count(*) OVER (PARTITION BY ym) AS all_n FROM found)
        SELECT ym, place, ceil(place / 10)::BIGINT AS page, ceil(all_n / 10)::BIGINT AS pages, start, route, epoch_us(first_seen) AS first_seen, first_seq FROM pl""",
    "disruption_order": f"{_DISRUPTIONS} SELECT row_number() OVER (ORDER BY first_seen, route, first_seq) AS place, start, route, epoch_us(first_seen) AS first_seen, first_seq FROM found",
    "staleness": f"WITH {_GOOD} SELECT TIMESTAMP '{NOW}' > horizon + INTERVAL 10 HOUR AS stale, strftime(horizon, '%Y-%m-%d %H:%M') AS stamp FROM horizon",
    "golden_diff": _golden("SELECT head, text, cur.told <> cur.renamed AS causes_moved, cur.louder AS unread_moved FROM cur JOIN stored USING (head, text) WHERE cur.told <> cur.renamed OR cur.louder"),
    "golden_new": _golden("SELECT head, text FROM cur ANTI JOIN stored USING (head, text)"),
    "golden_merge": _golden("SELECT head, text, renamed AS causes FROM cur UNION ALL SELECT head, text, told FROM stored ANTI JOIN cur USING (head, text)"),
    "p6_found": f"""{_NESTED}
        SELECT run_id, item_pos, 'code' AS kind, pos::INT AS pos, -1 AS sub_pos, json_extract_string(x, '$') AS label FROM code WHERE json_type(x) = 'VARCHAR'
        UNION ALL SELECT run_id, item_pos, 'leg', pos::INT, -1, coalesce(json_extract_string(x, '$.sStop'), '') FROM leg
        UNION ALL SELECT run_id, item_pos, 'via', pos::INT, sub_pos::INT, coalesce(json_extract_string(x, '$.stop'), '') FROM via""",
    "p1_found": f"""WITH {_instants("s", "sightings", "start", True)}, {_instants("r", "poll_runs", "fetched_at_utc", False)}
        SELECT 'sightings' AS table_name, sighting_id AS row_id, us AS utc_us FROM s WHERE us IS NOT NULL AND (NOT regexp_full_match(start, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d') OR odd)
        UNION ALL SELECT 'poll_runs', run_id, us FROM r WHERE us IS NOT NULL AND NOT regexp_full_match(fetched_at_utc, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ')""",
    "p5_fields": f"""{_SNAPSHOTS},
        parts AS MATERIALIZED (SELECT i.feed, i.n, i.ref, f.key AS field, string_agg(j.fullkey || ' ' || j.type || ' ' || coalesce(json_extract_string(j.atom, '$'), ''), chr(1) ORDER BY j.fullkey) AS form
            FROM its i, json_each(i.e) f, json_tree(f.value) j GROUP BY ALL),
        both_in AS (SELECT b.feed, b.n, b.ref, s.run_id FROM its a JOIN its b ON a.feed IS NOT DISTINCT FROM b.feed AND a.n + 1 = b.n AND a.ref = b.ref JOIN snaps s ON s.feed IS NOT DISTINCT FROM b.feed AND s.n = b.n),
        sides AS (SELECT t.run_id, p.ref, p.field, p.form, 1 AS side FROM parts p JOIN both_in t ON p.feed IS NOT DISTINCT FROM t.feed AND p.n = t.n AND p.ref = t.ref
            UNION ALL SELECT t.run_id, p.ref, p.field, p.form, 2 FROM parts p JOIN both_in t ON p.feed IS NOT DISTINCT FROM t.feed AND p.n + 1 = t.n AND p.ref = t.ref)
        SELECT run_id, ref AS item_ref, field FROM sides GROUP BY ALL HAVING count(*) = 1 OR min(form) <> max(form)""",
    "p5_found": f"""{_SNAPSHOTS},
        forms AS MATERIALIZED (SELECT i.feed, i.n, i.ref, string_agg(j.fullkey || ' ' || j.type || ' ' || coalesce(json_extract_string(j.atom, '$'), ''), chr(1) ORDER BY j.fullkey) AS form FROM its i, json_tree(i.e) j GROUP BY ALL),
        later AS (SELECT s.run_id, f.* FROM forms f JOIN snaps s ON s.feed IS NOT DISTINCT FROM f.feed AND s.n = f.n WHERE s.n > 1),
        earlier AS (SELECT s.run_id, f.* FROM forms f JOIN snaps s ON s.feed IS NOT DISTINCT FROM f.feed AND s.n = f.n + 1)
        SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.ref, b.ref) AS item_ref, CASE WHEN b.ref IS NULL THEN 'added' WHEN a.ref IS NULL THEN 'removed' ELSE 'changed' END AS delta
        FROM later a FULL JOIN earlier b ON a.run_id = b.run_id AND a.ref = b.ref WHERE a.form IS DISTINCT FROM b.form""",
    "p2_found": f"{_FAULTS} SELECT line_id, fault FROM faults WHERE fault IS NOT NULL",
    "p2_loaded": f"""{_FAULTS}, good AS (SELECT line_id FROM faults WHERE fault IS NULL),
        values_j AS (SELECT line_id, line->>'fetched_at_utc' AS f, line->>'http_status' AS h, CASE WHEN json_type(line, '$.network_error') = 'VARCHAR' THEN line->>'network_error' END AS n,
            CASE json_type(line, '$.body') WHEN 'VARCHAR' THEN line->>'body' WHEN 'NULL' THEN NULL ELSE '#' || (line->'body') END AS b FROM raw_lines WHERE file_name LIKE '%.jsonl' AND line_id IN (FROM good)),
        values_c AS (SELECT line_id, {_cell("x.f")} AS f, {_cell("x.h")} AS h, {_cell("x.n")} AS n, {_cell("x.b")} AS b FROM c1 WHERE line_id IN (FROM good))
        SELECT line_id, nullif(f, '') AS fetched_at_utc, nullif(h, '')::INT AS http_status, nullif(n, '') AS network_error, nullif(b, '') AS body FROM (FROM values_j UNION ALL FROM values_c)""",
}
