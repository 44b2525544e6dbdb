"""The queries of the operators on text, and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permway.llm import copies, leakage, lookalike, mixing, residue
from permway.sources.tables import table


def p3_found(spark, d):
    return residue.found(table(spark, d, "notices"))


def p3_messages(spark, d):
    return residue.messages(table(spark, d, "notices")).where("kind IS NOT NULL")


def p4_found(spark, d):
    return copies.found(table(spark, d, "notices"))


def p4_counts(spark, d):
    return copies.collapse(table(spark, d, "notices"))


def p7_found(spark, d):
    return leakage.found(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_scrubbed(spark, d):
    return leakage.scrub(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_mixture(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).selection


def p8_shares(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).shares


def p8_limits(spark, d):
    """Whether each source keeps its limit of uses and comes within a hundredth of its share among the sources that have documents."""
    live = F.when(F.col("n_docs") > 0, F.col("target_share")).otherwise(0.0)
    shares = p8_shares(spark, d)
    goal = F.col("live") / F.col("all_live")
    rows = shares.withColumn("live", live).crossJoin(F.broadcast(shares.agg(F.sum(live).alias("all_live"))))  # one row
    return rows.select("source", "n_docs", (F.col("most_uses") <= F.col("max_repeats")).alias("uses_kept"), (F.abs(F.col("share") - goal) <= 0.01).alias("share_reached"))


def p9_found(spark, d):
    return lookalike.same_look(table(spark, d, "documents"))


def p9_classes(spark, d):
    return lookalike.classes(table(spark, d, "documents"))


def p9_texts(spark, d):
    """The form in which texts that look the same are equal."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", lookalike.look_form(docs["text"]).alias("text_form"))


def p9_readable(spark, d):
    """The same for readers, with words of other scripts in their script."""
    return lookalike.normalise(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "text_form")


_NAMES = [p3_found, p3_messages, p4_found, p4_counts, p7_found, p7_scrubbed, p8_mixture, p8_shares, p8_limits, p9_found, p9_classes, p9_texts, p9_readable]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _NAMES}


def _look(text: str) -> str:
    """The one form of a text in SQL, by the same tables."""
    table = lookalike.table()
    gone = "".join(k for k, v in table.items() if v == "" and k < "\U000e0000")
    single = {k: v for k, v in table.items() if len(v) == 1 and len(k) == 1}
    sql = f"regexp_replace({text}, '[{gone}\U000e0000-\U000e0fff]', '', 'g')"
    for k, v in table.items():
        if len(v) > 1 and ("ﬀ" <= k <= "ﬆ"):
            sql = f"replace({sql}, '{k}', '{v}')"
    source, target = "".join(single), "".join(v.replace("'", "''") for v in single.values())
    return f"nfc_normalize(translate({sql}, '{source}', '{target}'))"


_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _words(text: str) -> str:
    return _WORDS.format(text)


def _canonical(column: str) -> str:
    lower = f"lower(nfc_normalize(coalesce({column}, '')))"
    label = r"(^|[;,/|\n])([^\p{L}\p{N};,/|\n]*)(\p{L}+(?: \p{L}+)?)(\s*:|[\s\x{a0}]+[-–—][\s\x{a0}])"
    first = r"^[^\p{L}\p{N}]*\p{L}+(?: \p{L}+)?(?:\s*:|[\s\x{a0}]+[-–—][\s\x{a0}])"
    words = lambda x: f"array_to_string(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}\\p{{M}}]+'), ' ')"
    fields = f"string_split(regexp_replace({lower}, '{label}', '\\1' || chr(1) || '\\3\\4', 'g'), chr(1))"
    listed = f"array_to_string(list_sort(list_filter(list_transform({fields}, lambda x: {words('x')}), lambda x: x <> '')), '; ')"
    return f"CASE WHEN regexp_matches({lower}, '{first}') AND len(regexp_extract_all({lower}, '{label}')) >= 2 THEN {listed} ELSE {words(lower)} END"


_GROUPS = f"WITH k AS (SELECT notice_id, {_canonical('head')} AS h, {_canonical('text')} AS t FROM notices), g AS (SELECT h, t, min(notice_id) AS keep_id, count(*) AS n FROM k GROUP BY h, t) "

def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _message(column: str) -> str:
    t = f"lower(coalesce({column}, ''))"
    for _ in range(2):
        for entity, char in residue.ENTITIES:
            t = f"replace({t}, {_q(entity)}, {_q(char)})"
    t = f"regexp_replace(regexp_replace({t}, {_q(residue.TAG)}, ' ', 'g'), {_q(residue.ADDRESS)}, 'url', 'g')"
    t = f"translate({t}, {_q('0123456789' + residue.SPACES)}, {_q('9' * 10 + ' ' * len(residue.SPACES))})"
    t = f"trim(regexp_replace({t}, '  +', ' ', 'g'))"
    return f"regexp_replace(regexp_replace(regexp_replace({t}, {_q(residue.DATE)}, 'date', 'g'), {_q(residue.LOG)}, '9-9', 'g'), '99+', '9', 'g')"


def _residue() -> str:
    """Common tables up to `known`: each distinct message with its count and kind."""
    match = lambda x, patterns: f"regexp_matches({x}, {_q(residue.any_of(patterns))})"
    whole = lambda patterns: f"regexp_full_match(w, {_q(residue.any_of(patterns))})"
    return f"""WITH raw AS (SELECT notice_id AS id, coalesce(codes[1], '') AS source, unnest([head, text]) AS raw FROM notices),
        m0 AS (SELECT id, source, trim(coalesce(raw, '')) = '' AS blank, {_message("raw")} AS m FROM raw),
        m1 AS (SELECT id, source, blank, CASE WHEN contains(m, '9-9') THEN rtrim(regexp_replace(ltrim(m, {_q(residue.EDGE)}), {_q(residue.LEAD)}, ''), {_q(residue.CLOSING)}) ELSE m END AS m FROM m0),
        f AS MATERIALIZED (SELECT id, source, blank, CASE WHEN m LIKE '%9-9' THEN rtrim(regexp_replace(m, {_q(residue.TAIL)}, ''), {_q(residue.EDGE)}) ELSE m END AS message FROM m1),
        g AS (SELECT message, count(*) AS n, count(*) >= {residue.MIN_FIELDS} AND count(DISTINCT source) >= 2 AS recurs, trim(regexp_replace(message, '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS w FROM f GROUP BY message),
        c AS MATERIALIZED (SELECT message, n, recurs, CASE WHEN {match("message", residue.PLACEHOLDERS)} THEN 'placeholder' WHEN {match("message", residue.EMPTY_VALUES)} THEN 'empty_value' WHEN w = '' THEN 'no_content'
            WHEN {whole(residue.ERROR_PAGES)} OR recurs AND {whole(residue.OPEN_ERRORS)} THEN 'error_page' WHEN {whole(residue.SCRIPT_DEMANDS)} OR recurs AND {whole(residue.OPEN_DEMANDS)} THEN 'script_demand'
            WHEN {whole(residue.FILLER)} OR (w LIKE '% %' AND regexp_matches(w, '[a-z]') AND len(list_distinct(string_split(regexp_replace(w, '( 9)+$', ''), ' '))) = 1) THEN 'filler' END AS kind FROM g),
        cuts AS (SELECT rtrim(substr(message, 1, k::INT)) AS cut, min(kind) AS cut_kind FROM (SELECT *, unnest(range({residue.CUT_FROM}, least(length(message), {residue.CUT_TO}) + 1)) AS k FROM c
            WHERE recurs AND kind IN ('error_page', 'script_demand', 'filler')) GROUP BY 1),
        known AS (SELECT message, n, coalesce(kind, cut_kind) AS kind FROM c LEFT JOIN cuts ON message = cut)"""


ORACLE = {
    "p3_messages": _residue() + " SELECT message, n, kind FROM known WHERE kind IS NOT NULL",
    "p3_found": _residue() + """ SELECT id AS notice_id FROM f JOIN known USING (message) WHERE kind IS NOT NULL GROUP BY id
        HAVING count_if(NOT blank OR kind <> 'no_content') > 0 OR count_if(kind = 'no_content') >= 2""",
    "p4_found": _GROUPS + "SELECT keep_id, notice_id AS copy_id FROM k JOIN g USING (h, t) WHERE notice_id <> keep_id",
    "p4_counts": _GROUPS + "SELECT keep_id, n FROM g",
    "p7_found": f"""
        WITH d AS (SELECT doc_id, {_words(_look("text"))} AS w FROM documents WHERE text IS NOT NULL),
        e AS (SELECT item_id, {_words(_look("text"))} AS w FROM eval_items WHERE text IS NOT NULL),
        dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM d WHERE len(w) >= 12),
        eg AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM e WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
    "p8_limits": "SELECT t.source, count(doc_id) AS n_docs, true AS uses_kept, true AS share_reached FROM mix_targets t LEFT JOIN documents d ON d.source = t.source AND d.text IS NOT NULL GROUP BY t.source",
    "p9_texts": f"SELECT doc_id, {_look('text')} AS text_form FROM documents",
    "p9_classes": f"""
        WITH d AS (SELECT doc_id, text, {_look("text")} AS f FROM documents WHERE text IS NOT NULL),
        t AS (SELECT f, text, count(*) AS same FROM d GROUP BY ALL), g AS (SELECT f, min(doc_id) AS class_id, count(*) AS n FROM d GROUP BY f HAVING count(DISTINCT text) > 1)
        SELECT doc_id, class_id, n - same AS links FROM d JOIN g USING (f) JOIN t USING (f, text)""",
    "p9_found": f"""
        WITH d AS (SELECT doc_id, text, {_look("text")} AS f FROM documents WHERE text IS NOT NULL)
        SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text""",
}
