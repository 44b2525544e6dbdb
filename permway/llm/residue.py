"""Problem 3: template residue, filler, error pages and demands for scripts.

Fields become messages: entities decoded, markup out, numbers, dates and
addresses masked, log numbers taken off, case and white space levelled. Equal
messages of all sources meet by a 128-bit hash and are counted with map-side
combining; then each distinct message is classified once. A place left unfilled
or an empty value is residue wherever it stands, and so is a whole message that
only a server, program or browser writes. A phrase that a real notice could
begin with, or a message that was cut short, counts only where it recurs over
several sources.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permway.operators.spread import join_sums
from permway.sources.shared import staged

#: A message recurs if at least so many fields of at least two sources have it.
MIN_FIELDS = 3
#: Lengths at which the beginning of a recurring message counts as the message cut short.
CUT_FROM, CUT_TO = 12, 60

# All patterns below are written for messages (lower case, numbers as 9) in the syntax that Java and RE2 share.
# Names of HTML elements, which in angle brackets are markup and no placeholders.
HTML = (
    "a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col data dd del details dfn div dl dt em "
    "fieldset figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav "
    "noscript object ol option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td "
    "template textarea tfoot th thead time title tr tt u ul var video wbr"
).split()
# Characters that are white space.
SPACES = "\t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
# Ways in which templates mark a place to be filled.
PLACEHOLDERS = [
    r"\{\{[^{}]*\}\}", r"\{%[^{}]*%\}", r"[$#]\{[^{}]*\}", r"\$\([a-z_][a-z0-9_. ]*\)", r"<%[^<>]*%>", r"%%[a-z_][a-z0-9_]*%%",
    r"%\([a-z_][a-z0-9_]*\)[sdifr]", r"(?:^|[^0-9%])%[sd](?:mins|[^a-z]|$)", r"@@[a-z_][a-z0-9_]*@@", r"__+[a-z][a-z0-9_]*__+", r"___+",
    r"<<? ?[a-z_][a-z0-9_ ]*/?>>?", r"\[\[ ?[a-z_][a-z0-9_ ]*\]\]", r"\[ ?(?:insert|enter|add|your)[ \]][^\[\]]*", r"\[[^\[\]]* goes here ?\]",
    r"\{ ?[a-z_][a-z0-9_.]* ?\}", r"\{ ?9? ?\}", r"(?:^|[^a-z0-9])xxx+(?:mins|$|[^a-z0-9])",
]
# Empty values written out where content belongs.
EMPTY_VALUES = [
    r"\[object object\]", r"(?:^|[^a-z])undefined(?:$|[^a-z])", r"\+ ?(?:null|none|nan)(?:mins|$|[^a-z])",
    r"(?:^|[^a-z])(?:from|to|at|by|between|owing to|due to|cause:) (?:null|nan)(?:$|[^a-z])",
    r"(?:^|[^a-z])(?:null|nan) (?:to|mins?|minutes?|service|train|delayed|late)(?:$|[^a-z])",
    r"(?:^|[^a-z])by none(?:$|[^a-z])|(?:^|[^a-z])none (?:mins?|minutes?)(?:$|[^a-z])|(?:^|[^a-z])(?:from|at) none (?:to|is)(?:$|[^a-z])|^none to(?:$|[^a-z])",
    r"\+ ?(?:mins?|delayed)(?:$|[^a-z])", r"(?:^|[;,] )(?:from|to|due|delay|cause|platform|route|time|reason|stop) ?: ?(?:[;,]|$)", r"\( ?\)|\[ ?\]",
]
# From here on the patterns are for the words of a message, with all else as single spaces.
# Filler, as the words of a whole field.
FILLER = [
    r"lorem ipsum.*", r"(?:your |the )?(?:[a-z]+ ){0,3}(?:text|copy|body|message|content) (?:goes )?here", r"(?:sample|dummy|placeholder|example) (?:notice|text|message|copy|body|content|heading)(?: .*)?",
    r"(?:sub )?heading(?: text)?(?: sub ?heading(?: text)?)?|title|headline|subject|untitled", r"(?:copy|text|content|details?) to follow", r"tbc|tba|tbd|todo|fixme|xxx+|n a|null|none|nan|undefined|placeholder|filler|test|testing|asdf[a-z]*|qwerty[a-z]*|foo|bar|foo bar(?: baz)?|blah",
    r"(?:.* )?do not publish(?: .*)?|(?:.* )?replace before (?:going live|publishing|launch)(?: .*)?", r"insert [a-z]+(?: [a-z]+){0,3} here",
]
_CODE = r"(?:http )?(?:error )?(?:9 )?"
# Whole messages of web servers and programs.
ERROR_PAGES = [
    _CODE + r"(?:page |file |resource )?not found(?: (?:the|this) (?:requested|page|address|resource|file) .*)?", _CODE + r"bad (?:gateway|request)(?: (?:nginx|apache|cloudflare|the server|your browser).*)?",
    r"(?:http )?(?:error )?9 (?:the )?(?:service|server|site|page|website) (?:is )?(?:temporarily |currently )?(?:unavailable|overloaded)(?: .*)?", r"(?:the )?(?:server|site|page|website|service) (?:is )?(?:temporarily |currently )?(?:unavailable|overloaded)(?: (?:please )?try again.*)?",
    _CODE + r"gateway time ?(?:d )?out(?: .*)?", _CODE + r"forbidden(?: you (?:do not|don t) have .*)?", r"(?:error )?(?:9 )?unauthori[sz]ed(?: access| request)?", _CODE + r"internal (?:server )?error(?: .*)?",
    r"(?:error )?(?:9 )?too many requests(?: .*)?", r"(?:9 )?request (?:time ?out|timed out|blocked|rejected)(?: (?:by|while|after|at the) .*)?", r"(?:http )?error 9(?: (?:the|this|an?|page|oops|bad|not|internal|service|gateway) .*)?",
    r"an? (?:unexpected|unknown|internal|application|server) error (?:has )?occurred(?: .*)?", r"(?:9 )?(?:oops )?something went wrong(?: .*)?", r"upstream (?:connect|request) (?:error|timeout|failed)(?: .*)?", r"(?:the )?origin (?:server )?is unreachable(?: .*)?",
    r"(?:error establishing a )?(?:database|server) (?:connection )?(?:error|failed|failure)|error establishing a database connection", r"access (?:is )?denied(?: you (?:do not|don t) have .*)?", r"(?:your )?session (?:has |is )?(?:expired|timed out)(?: (?:please )?(?:sign|log) .*)?",
    r"(?:the )?page (?:you are looking for|you requested|does not exist|cannot be displayed|can t be found)(?: .*)?", r"this (?:page|site) (?:cannot|can t|could not) be (?:displayed|reached|found)(?: .*)?", r"(?:php )?(?:fatal|parse|syntax|runtime) error uncaught .*|(?:php )?(?:fatal|parse|syntax|runtime) error",
    r"traceback most recent call(?: .*)?", r"(?:java|javax|org|com|net|kotlin|scala) (?:[a-z9]+ )*[a-z]*(?:exception|error)(?: .*)?", r"(?:uncaught |unhandled )[a-z]*(?:error|exception)(?: .*)?", r"[a-z]+(?:exception|error) (?:at|in|on|line) .*", r"segmentation fault(?: core dumped)?|stack ?trace",
    r"connection (?:refused|reset by peer|timed out)", r"proxy error(?: .*)?", r"(?:you do not|you don t) have permission to .*", r"(?:this )?(?:site|page) (?:is )?(?:under|down for) maintenance",
    r"tharla earráid ar an bhfreastalaí(?: .*)?", r"níor aimsíodh an leathanach(?: .*)?", r"wystąpił (?:nieoczekiwany )?błąd serwera(?: .*)?", r"nie znaleziono strony(?: .*)?", r"сталася помилка сервера(?: .*)?", r"сторінку не знайдено(?: .*)?",
]
# Beginnings that are such a message where they recur over several sources.
OPEN_ERRORS = [
    _CODE + r"(?:forbidden|not found|bad request|unauthori[sz]ed) .*", r"access (?:is )?denied .*", r"request (?:blocked|rejected|timed out) .*", r"connection (?:refused|reset|closed|timed out)(?: .*)?", r"(?:server|site|database) (?:error|unavailable)(?: .*)?",
    r"session (?:expired|closed) .*", r"tharla earráid(?: .*)?", r"wystąpił błąd(?: .*)?", r"сталася помилка(?: .*)?", r"(?:the )?(?:site|page) is (?:closed|offline|down)(?: .*)?",
]
# Whole demands for scripts, cookies or another browser.
SCRIPT_DEMANDS = [
    r"(?:please )?(?:you (?:need|have|must) (?:to )?)?(?:enable|turn on|switch on|activate|allow) (?:javascript|java script|scripts?|scripting|cookies)(?: .*)?", r"for full functionality(?: .*)?", r"this (?:site|page|app|website|application) (?:requires|needs|relies on|works best with|uses) (?:javascript|scripts?|cookies)(?: .*)?",
    r"(?:your|this) browser (?:does not|doesn t) support(?: .*)?", r"(?:javascript|scripting|scripts?|cookies) (?:is|are|must|needs?|appears?|has|have) (?:be |to be |been )?(?:disabled|required|blocked|turned|needed|active|enabled|off|switched)(?: .*)?",
    r"loading (?:(?:this|the) (?:content|page) )?(?:will|needs|requires)(?: .*)?", r"loading please wait", r"checking your browser(?: .*)?", r"verify(?:ing)? (?:that )?you are (?:a )?human(?: .*)?", r"ní mór javascript(?: .*)?", r"cumasaigh javascript(?: .*)?",
    r"(?:proszę )?włącz[a-z]* (?:obsługę )?javascript(?: .*)?", r"(?:будь ласка )?увімкніть javascript(?: .*)?",
]
# Beginnings that are such a demand where they recur over several sources.
OPEN_DEMANDS = [r"(?:your|this) browser (?:is|has) .*", r"loading .*", r"(?:please )?(?:update|change) your browser(?: .*)?"]

TAG = r"</?(?:" + "|".join(HTML) + r")(?:[\s/][^<>]*)?(?:>|$)|</[a-z0-9]*$"
ADDRESS = r"[a-z]+://[^\s<>]+|[a-z0-9_.+-]+@[a-z0-9_-]+\.[a-z0-9_.]+"
DATE = r"9{1,4}[-/.]9{1,2}[-/.]9{1,2}"
LOG = r"99[-/. –—‑]9{7}"
_MARK = r"(?:(?:log|ref|update|request id|ray|ray id|reference|incident) ?)?[:#/–-]{0,3} ?#?9-9"
LEAD, TAIL = rf"^{_MARK}[ .:)–-]*", rf"{_MARK}$"
EDGE, CLOSING = ' (/*"“”–-', ' .)"“”!?;,'
#: A log mark is shorter than this.
MARK_CHARS = 40
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _has(column: str, parts: list[str]) -> Column:
    """Whether a text contains any of the parts; costs less than a search by pattern."""
    return reduce(lambda a, b: a | b, [F.contains(F.col(column), F.lit(p)) for p in parts])


def _if(test: Column, then: Column) -> Column:
    return F.when(test, then).otherwise(F.col("__t"))


def with_message(df: DataFrame, raw: str) -> DataFrame:
    """`df` with the `message` of the text `raw`; null counts as empty. Each step is skipped where a text can't need it."""
    t = F.col("__t")
    decoded = t
    for _ in range(2):  # feeds encode twice
        for entity, char in ENTITIES:
            decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    df = df.withColumn("__t", F.lower(F.coalesce(F.col(raw), F.lit(""))))
    df = df.withColumn("__t", _if(_has("__t", ["&"]), decoded))
    df = df.withColumn("__t", _if(_has("__t", ["<"]), F.regexp_replace("__t", TAG, " ")))
    df = df.withColumn("__t", _if(_has("__t", ["://", "@"]), F.regexp_replace("__t", ADDRESS, "url")))
    df = df.withColumn("__t", F.translate("__t", "0123456789" + SPACES, "9" * 10 + " " * len(SPACES)))
    df = df.withColumn("__t", F.trim(_if(_has("__t", ["  "]), F.regexp_replace("__t", "  +", " "))))
    df = df.withColumn("__t", _if(_has("__t", ["9"]), F.regexp_replace(F.regexp_replace(F.regexp_replace("__t", DATE, "date"), LOG, "9-9"), "99+", "9")))
    df = df.withColumn("__t", _if(_has("__t", ["9-9"]), F.rtrim(F.regexp_replace(F.ltrim(t, F.lit(EDGE)), LEAD, ""), F.lit(CLOSING))))
    n = F.length("__t")
    cut = F.concat(F.left(t, F.greatest(n - MARK_CHARS, F.lit(0))), F.regexp_replace(F.right(t, F.least(n, F.lit(MARK_CHARS))), TAIL, ""))
    return df.withColumn("message", _if(t.endswith("9-9"), F.rtrim(cut, F.lit(EDGE)))).drop("__t")


def words(text: Column) -> Column:
    """The words of a message."""
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def classify(messages: DataFrame) -> DataFrame:
    """`messages` (`message`, `n`, `recurs`) with `kind`: placeholder, empty_value, filler, error_page, script_demand, no_content or null."""
    w, m = F.col("__words"), F.col("message")
    whole = lambda patterns: w.rlike(f"^(?:{any_of(patterns)})$")
    one_word = w.contains(" ") & w.rlike("[a-z]") & (F.size(F.array_distinct(F.split(F.regexp_replace(w, "( 9)+$", ""), " "))) == 1)
    # Most messages have none of the characters and words that the searches need.
    marks = _has("message", ["{", "<", "%", "@@", "__", "[", "$(", "xxx"])
    empty = _has("message", ["null", "nan", "none", "undefined", "object object", "+min", "+ min", "+del", "+ del", ": ;", ":;", ": ,", ":,", "()", "( )", "[]", "[ ]"]) | m.endswith(":")
    kind = (
        F.when(marks & m.rlike(any_of(PLACEHOLDERS)), "placeholder").when(empty & m.rlike(any_of(EMPTY_VALUES)), "empty_value").when(w == "", "no_content")
        .when(whole(ERROR_PAGES) | F.col("recurs") & whole(OPEN_ERRORS), "error_page").when(whole(SCRIPT_DEMANDS) | F.col("recurs") & whole(OPEN_DEMANDS), "script_demand")
        .when(whole(FILLER) | one_word, "filler")
    )
    return messages.withColumn("__words", words(m)).withColumn("kind", kind).drop("__words")


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("message"), text).alias("h2")]


def fields(notices: DataFrame, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    """`id, source, blank, message, h1, h2`: one row per field of a notice.

    The source of a notice is the first of its `codes`; null codes are one
    source, and without such a column each notice is a source of its own.
    """
    source = F.xxhash64(F.get("codes", F.lit(0))) if "codes" in notices.columns else F.xxhash64(id_col)
    rows = notices.select(F.col(id_col).alias("id"), source.alias("source"), F.explode(F.array(*columns)).alias("raw"))
    rows = with_message(rows, "raw").withColumn("blank", F.trim(F.coalesce("raw", F.lit(""))) == "")
    return rows.select("id", "source", "blank", "message", *_hashes(F.col("message")))


def groups(rows: DataFrame) -> DataFrame:
    """`h1, h2, message, n, recurs, kind`: each distinct message of all fields, counted and then classified.

    The hash leads the key, the text behind it keeps chance collisions apart.
    All sums are of fixed size and combined before the shuffle.
    """
    sums = rows.groupBy("h1", "h2", "message").agg(F.count("*").alias("n"), F.min("source").alias("a"), F.max("source").alias("b"))
    counted = sums.select("h1", "h2", "message", "n", ((F.col("n") >= MIN_FIELDS) & (F.col("a") != F.col("b"))).alias("recurs"))
    return classify(counted)


def with_cuts(known: DataFrame) -> DataFrame:
    """`known` groups with the kind of a recurring message also at those that are its beginning, cut at 12 to 60 characters."""
    whole = known.where("recurs AND kind IN ('error_page', 'script_demand', 'filler')")
    at = F.explode(F.sequence(F.lit(CUT_FROM), F.least(F.length("message"), F.lit(CUT_TO))))
    cut = whole.where(F.length("message") >= CUT_FROM).select("message", "kind", at.alias("k")).select(F.rtrim(F.substring("message", F.lit(1), F.col("k"))).alias("cut"), "kind")
    cut = cut.groupBy(*[h.alias(f"c_{i}") for i, h in enumerate(_hashes(F.col("cut")))], "cut").agg(F.min("kind").alias("cut_kind"))
    same = (F.col("h1") == F.col("c_0")) & (F.col("h2") == F.col("c_1")) & (F.col("message") == F.col("cut"))
    return known.join(cut, same, "left").withColumn("kind", F.coalesce("kind", "cut_kind")).drop("c_0", "c_1", "cut", "cut_kind")


def messages(notices: DataFrame, id_col: str = "notice_id", columns: tuple[str, ...] = ("head", "text")) -> DataFrame:
    """`message, n, kind`: each distinct message of all notices with its number of fields and its kind."""
    return with_cuts(staged(groups(fields(notices, id_col, columns)), "messages")).select("message", "n", "kind")


def marked(notices: DataFrame, id_col: str = "notice_id", columns: tuple[str, ...] = ("head", "text")) -> DataFrame:
    """`notice_id, kinds`: notices that are none, with what their fields are.

    A field that was empty from the start is no case by itself; a notice is one
    if a field's message is residue, or if a field holds nothing but a log
    number or punctuation, or if no field has content. Null fields count as
    empty, rows that share an id count together. One message may fill a third
    of all fields; such messages meet their fields by broadcast (`join_sums`).
    """
    rows = staged(fields(notices, id_col, columns), "fields")
    known = with_cuts(staged(groups(rows), "messages")).where("kind IS NOT NULL").select("h1", "h2", "message", "kind", "n")
    known = staged(known.groupBy("h1", "h2").agg(F.min("kind").alias("kind"), F.sum("n").alias("n")), "residue")
    hit = join_sums(rows.select("id", "blank", "h1", "h2"), known, ["h1", "h2"], "n", "id").select("id", "blank", "kind")
    hit = hit.groupBy("id").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.count_if(~F.col("blank") | (F.col("kind") != "no_content")).alias("written"), F.count_if(F.col("kind") == "no_content").alias("void")
    )
    return hit.where((F.col("written") > 0) | (F.col("void") >= len(columns))).select(F.col("id").alias("notice_id"), "kinds")


def found(notices: DataFrame) -> DataFrame:
    """p3_found: the ids of notices that are none."""
    return marked(notices).select("notice_id")
