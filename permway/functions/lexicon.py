"""The closed vocabulary of causes: categories, families, labels and patterns."""

# Category, family, label and pattern (case-insensitive, found anywhere in a clause).
CATEGORIES = [
    ("technical", "origin", "Technical or mechanical fault", r"technical issue|mechanical issue|train failure|train issue|broken down train|loco swap|train set replacement"),
    ("signalling", "origin", "Signalling fault", r"signalling"),
    ("infrastructure", "origin", "Speed restriction or power supply", r"speed restriction|power supply"),
    ("level_crossing", "origin", "Level crossing issue", r"level crossing"),
    (
        "vehicle_strike", "origin", "Road vehicle struck the railway",
        r"(?:strik\w+|struck|hitting|colli\w+)[^.]{0,40}\b(?:vehicle|tractor|bridge|level crossing|train)\b"
        r"|\b(?:vehicle|tractor)\b[^.]{0,40}(?:strik\w+|struck|hitting|colli\w+)",
    ),
    ("passenger", "origin", "Passenger issue", r"passenger issue|ill passenger|medical emergency|ambulance"),
    ("incident", "origin", "Incident on the line", r"incident|emergency services|vulnerable person"),
    ("congestion", "consequence", "Congestion", r"congestion|congestiion"),
    (
        "knock_on", "consequence", "Knock-on delay",
        r"late arrival|late running|incoming service delay|earlier (?:service )?delays?|delays/alterations|service (?:delays? and )?alterations|service disruptions"
        r"|earlier (?:service )?cancellation|(?:dart|service) cancellation|being cancelled|earlier closure|earlier (?:service )?terminating|earlier stopped train|\+\d+\s*(?:mins?|minutes?)?\s*delayed",
    ),
    ("planned", "planned", "Planned works", r"planned works|planned maintenance|engineering works"),
    ("unspecified", "unstated", "No cause given", r"operational (?:issues?|reasons)"),
]
# Words that introduce a cause, and words after which a clause says something else.
MARKER = r"\b(due to|as a result of|caused by|because of|owing to|following|arising from)\b"
TAIL = (
    r"\s+(?:and\s+)?(?:will|it will|creating|causing)\s"
    r"|,\s*(?:the\s+\d{1,2}[:.]\d{2}\b|this service|this train|services? (?:are|will)|it is)"
    r"|\s+to aid service recovery"
)
# One reading that beats others, categories that need no marker, and signs of another service.
BEATS = {"vehicle_strike": ("level_crossing", "incident")}
UNMARKED = ("planned", "vehicle_strike", "level_crossing", "signalling", "technical", "passenger", "congestion")
EARLIER = r"\bearlier\b|\blate running\b"
# Notices that are about something else, seating notices, and figures of delay.
MACHINE_OUT = r"\b(lifts?|escalators?)\b.*\bout of (order|service)\b"
TEST_ALERT = r"\btest HIM alert\b"
CAPACITY = r"\breduced capacity\b"
MINUTES = r"\+?\s*(\d{1,3})\s*(?:/\s*\d{1,3}\s*)?(?:mins?|minutes?)\b"
# The cleaning pipeline.
APOLOGY = r"(?:Iarnr[oó]d\s+[ÉE]ireann\s+)?(?:Irish\s+Rail\s+)?apolog\w+\s+(?:for|or)\s+(?:any|the)\s+inconvenience\s+caused\s*\.*"
UPDATE_STAMP = r"^\s*(?:Update\s*(?:at|@)?\s*)?\d{1,2}[:.]\d{2}\s*(?:hrs)?\s*[-:.]\s*"
INITIALS = r"\s*-\s*[A-Z]{2}\s*$"
BLOCK = r"<\s*br\b[^>]*>|</\s*p\s*>"
TAG = r"<[^>]+>"
SENTENCE = r"(?<!\d)\.(?!\d)|;|(?<=\s)-(?=\s)|\?|!"
# What a route reads as that is none.
SEVERAL, UNNAMED = "Several services", "Route not stated"

FAMILY = {c: f for c, f, _, _ in CATEGORIES}
LABEL = {c: label for c, _, label, _ in CATEGORIES}


def java(pattern: str) -> str:
    """The pattern without case, with Unicode's classes where it has any, and `.` stopped by a line feed only."""
    classes = any(c in pattern for c in (r"\w", r"\b", r"\d", r"\s"))
    return ("(?iUd)" if classes else "(?iud)") + pattern
