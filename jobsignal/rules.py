"""Rule values and regex builders shared by every operator.

Everything under "Fixed values" must equal the behaviour being matched
(keyword lists, label sets, points, limits).  Regexes are written in a
*portable dialect* understood identically by Java regex (Spark) and RE2
(DuckDB, the correctness oracle): no look-around, no ``\\b``/``\\w``/``\\s``
shortcuts.  Word boundaries are spelled out with explicit classes that
follow Python's Unicode notion of a word character (letters, digits, ``_``)
and of whitespace.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values — classifier (labels, keywords, points)
# ---------------------------------------------------------------------------

ROLE_FAMILIES = (
    "software_engineering", "data", "ml_ai", "security", "product",
    "design", "sales", "support", "other",
)
ROLE_TYPES = (
    "backend", "frontend", "full_stack", "infra", "platform", "data_engineering",
    "ml_ai", "security", "product_engineering", "mobile", "devops", "qa", "other",
)
SENIORITIES = ("intern", "new_grad", "junior", "mid", "senior", "staff", "manager", "unknown")
LOCATION_FITS = ("us_remote", "us_onsite", "hybrid_us", "non_us", "unclear")

DEFAULT_MIN_RELEVANCE_SCORE = 75
DEFAULT_MODEL = "local-keyword-v1"
DESCRIPTION_LIMIT = 1500
REASON_LIMIT = 500
LAST_SEEN_INTERVAL_SECONDS = 21600

CLASSIFIER_US_STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut",
    "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa",
    "kansas", "kentucky", "louisiana", "maine", "maryland", "massachusetts", "michigan",
    "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada",
    "new hampshire", "new jersey", "new mexico", "new york", "north carolina",
    "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island",
    "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont",
    "virginia", "washington", "west virginia", "wisconsin", "wyoming",
    "district of columbia", "washington dc",
)
US_STATE_ABBR = (
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il",
    "in", "ia", "ks", "ky", "la", "me", "md", "ma", "mi", "mn", "ms", "mo", "mt",
    "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok", "or", "pa", "ri",
    "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy", "dc",
)
NON_US_HINTS = (
    "canada", "united kingdom", "uk", "england", "london", "germany", "berlin", "france",
    "paris", "india", "bengaluru", "bangalore", "hyderabad", "singapore", "australia",
    "sydney", "netherlands", "amsterdam", "ireland", "dublin", "poland", "spain",
)
US_SIGNAL_PHRASES = ("united states", "usa", "u.s.", "us", "u.s.a.")

ROLE_FAMILY_PATTERNS: dict[str, tuple[str, ...]] = {
    "software_engineering": (
        "software engineer", "software developer", "backend", "back end", "frontend", "front end",
        "full stack", "fullstack", "platform engineer", "product engineer", "founding engineer",
        "api engineer", "application engineer", "web engineer", "systems engineer",
    ),
    "data": ("data analyst", "analytics", "business intelligence", "bi engineer"),
    "ml_ai": ("machine learning", " ml ", "ai engineer", "artificial intelligence", "llm", "modeling"),
    "security": ("security engineer", "application security", "appsec", "security analyst"),
    "product": ("product manager", "product owner", "program manager"),
    "design": ("designer", "ux", "ui designer", "visual design"),
    "sales": ("sales", "account executive", "business development", "solutions consultant"),
    "support": ("support", "customer success", "technical account manager", "implementation specialist"),
}
ROLE_TYPE_PATTERNS: dict[str, tuple[str, ...]] = {
    "backend": ("backend", "back end", "api", "server", "distributed systems", "python", "go ", "java"),
    "frontend": ("frontend", "front end", "react", "typescript", "javascript", "web ui"),
    "full_stack": ("full stack", "fullstack"),
    "infra": ("infrastructure", "infra", "systems", "compute", "storage", "networking"),
    "platform": ("platform", "developer platform", "internal tools"),
    "data_engineering": ("data engineer", "data engineering", "etl", "pipeline", "spark", "warehouse"),
    "ml_ai": ("machine learning", " ml ", "ai engineer", "llm", "model training", "inference"),
    "security": ("security", "appsec", "detection", "vulnerability"),
    "product_engineering": ("product engineer", "founding engineer", "forward deployed engineer"),
    "mobile": ("ios", "android", "mobile"),
    "devops": ("devops", "sre", "site reliability", "kubernetes", "terraform"),
    "qa": ("qa", "quality assurance", "test automation", "sdet"),
}
# Tried in this order; inside a label, keywords in this order.
SENIORITY_PATTERNS: dict[str, tuple[str, ...]] = {
    "manager": ("manager", "director", "head of", "vp ", "vice president", "chief", "lead "),
    "staff": ("staff", "principal", "architect"),
    "senior": ("senior", "sr.", "sr "),
    "intern": ("intern", "internship", "co-op", "coop"),
    "new_grad": ("new grad", "university grad", "graduate", "early career", "entry level"),
    "junior": ("junior", "jr.", "associate", "software engineer i", "engineer i", "level 1"),
    "mid": ("software engineer ii", "engineer ii", "level 2", "mid-level", "mid level"),
}

FAMILY_POINTS = {"software_engineering": 45, "data": 25, "ml_ai": 25, "security": 25, "product": 10}
TYPE_POINTS = {
    "backend": 25, "full_stack": 25, "platform": 25, "infra": 25, "data_engineering": 25,
    "ml_ai": 25, "product_engineering": 25, "frontend": 18,
    "devops": 10, "security": 10, "mobile": 10, "qa": 10,
}
SENIORITY_POINTS = {
    "intern": 20, "new_grad": 20, "junior": 20, "unknown": 8, "mid": 5,
    "senior": -20, "staff": -35, "manager": -35,
}
FIT_POINTS = {"us_remote": 10, "hybrid_us": 10, "us_onsite": 10, "unclear": -5, "non_us": -30}
PAIR_BONUS = 5  # family_score >= 3 and type_score >= 2

# ---------------------------------------------------------------------------
# Fixed values — monitors (deterministic alert path), health, reports
# ---------------------------------------------------------------------------

# Title patterns, applied to the normalised title (lower case, only word
# characters and single spaces).  Each pattern is wrapped by
# ``title_bounded`` which supplies the leading/trailing word boundary.
TITLE_EXCLUDE_PATTERNS = (
    "senior", r"sr\.?", "staff", "principal", "lead", "manager", "director", "head", "vp",
    "vice president", "chief",
    r"machine\s*learning", "ml", "data", "analytics", "security", "infrastructure", "sre",
    "site reliability", "devops", "embedded", "firmware", "network", "test", "qa", "quality",
    "automation", "mobile", "ios", "android", "game", "graphics", "robotics", "reliability",
)
# "<lead> ... (engineer|developer)" patterns: the gap between the two words
# must start and end on a boundary, spelled ``( | .* )``.
TITLE_INCLUDE_PATTERNS = (
    r"software\s+engineer",
    r"software\s+developer",
    r"backend( | .* )(engineer|developer)",
    r"front\s*end( | .* )(engineer|developer)",
    r"frontend( | .* )(engineer|developer)",
    r"full\s*stack( | .* )(engineer|developer)",
    r"fullstack( | .* )(engineer|developer)",
    r"web( | .* )(engineer|developer)",
    r"application( | .* )(engineer|developer)",
    r"platform( | .* )(engineer|developer)",
    r"api( | .* )(engineer|developer)",
)
# Early-career gate (off by default).
TITLE_LEVEL_PATTERNS = (
    "intern", r"co[- ]?op", r"new\s*grad", "graduate", r"early\s*career", "entry",
    r"entry[- ]?level", "junior", "associate", r"(level|lvl)\s*(1|i)",
    r"software\s+engineer\s*(1|i)", r"engineer\s*(1|i)",
)

MONITOR_US_STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware",
    "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana",
    "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana",
    "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina",
    "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina",
    "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia",
    "wisconsin", "wyoming",
    "district of columbia", "washington dc", "d c", "d.c.",
)
# Country and "remote + US" patterns on raw lower-cased location text.
US_COUNTRY_PATTERNS = (r"usa", r"u\.s\.a\.?", r"u\.s\.?", r"united states", r"united states of america")
US_TOKEN = r"(us|usa|u\.s\.?|united states)"

NON_ERROR_STATUSES = ("ok", "new match", "unchanged (304)")
BADGE_ERROR_PREFIXES = ("error", "exception", "timeout", "http_", "gql_error")

EVENT_RETENTION = 1000
CYCLE_RETENTION = 3000
CYCLE_SECONDS = 3600
HISTORY_WINDOW = 360
RECENT_EVENTS = 100
TREND_POINTS = 20
DISTRIBUTION_ROWS = 8
LATEST_HIGH_RELEVANCE = 20
TOP_CONSECUTIVE = 25
ALERT_LIMIT_BOARD = 15       # greenhouse / lever / classified alerts
ALERT_LIMIT_ASHBY = 25
MESSAGE_MAX_LEN = 1900
SEARCH_MAX_START = 900
SEARCH_EMPTY_STREAK = 5
RESERVED_SLUGS = ("jobs", "job", "search", "api", "assets")
ERROR_COUNT_BANDS = (1,)            # errors >= 1 -> red
ERROR_RATIO_BANDS = (0.05, 0.20)    # ratio bands, percent 5 and 20
METRIC_PREFIX = "job_tracker_"
SHORT_LOG_FIELDS = ("timestamp", "level", "service", "event")

HOSTS = {
    "ashby": "jobs.ashbyhq.com",
    "greenhouse": "boards.greenhouse.io",
    "lever": "jobs.lever.co",
}

# ---------------------------------------------------------------------------
# Portable regex building blocks
# ---------------------------------------------------------------------------

# Python's str.isspace() set, as one character class body.
WS_BODY = (
    r"\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WS = f"[{WS_BODY}]"
#: The same white space as a list of characters.
WS_CHARS = "".join(map(chr, [9, 10, 11, 12, 13, *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
NOT_WORD_NOT_WS = rf"[^\p{{L}}\p{{N}}_{WS_BODY}]"


def alternation(parts) -> str:
    return "(" + "|".join(parts) + ")"


def title_bounded(pattern: str) -> str:
    """Word-bounded pattern on a normalised title (only spaces separate words)."""
    return f"(^| )({pattern})( |$)"


def literal_bounded(term: str) -> str:
    """``\\b term \\b`` for a literal term on raw text, written portably."""
    body = re.escape(term).replace("\\ ", " ")
    left = f"(^|{NON_WORD})" if re.match(r"\w", term[0]) else f"({WORD})"
    right = f"({NON_WORD}|$)" if re.match(r"\w", term[-1]) else f"({WORD})"
    return left + body + right


def pattern_bounded(pattern: str) -> str:
    """``\\b pattern \\b`` when pattern starts and ends on word characters."""
    return f"(^|{NON_WORD})({pattern})({NON_WORD}|$)"


def letters_bounded(terms) -> str:
    """``(?<![a-z]) term (?![a-z])`` without look-around."""
    return f"(^|[^a-z]){alternation(terms)}([^a-z]|$)"


# One boundary group around one alternation: same matches as bounding each
# pattern separately, far less backtracking.
TITLE_EXCLUDE_RE = title_bounded("|".join(TITLE_EXCLUDE_PATTERNS))
TITLE_INCLUDE_RE = title_bounded("|".join(TITLE_INCLUDE_PATTERNS))
TITLE_LEVEL_RE = title_bounded("|".join(TITLE_LEVEL_PATTERNS))

_GAP = f"({NON_WORD}|{NON_WORD}[^\\n]*{NON_WORD})"
_WORD_EDGED = [t for t in MONITOR_US_STATES if re.match(r"\w", t[0]) and re.match(r"\w", t[-1])]
US_LOCATION_RE = "|".join(
    [pattern_bounded("|".join(US_COUNTRY_PATTERNS))]
    + [
        f"(^|{NON_WORD})remote{_GAP}{US_TOKEN}({NON_WORD}|$)",
        f"(^|{NON_WORD}){US_TOKEN}{_GAP}remote({NON_WORD}|$)",
    ]
    + [pattern_bounded("|".join(re.escape(t).replace("\\ ", " ") for t in _WORD_EDGED))]
    + [literal_bounded(t) for t in MONITOR_US_STATES if t not in _WORD_EDGED]
    + [letters_bounded(US_STATE_ABBR)]
)
ABBR_RE = letters_bounded(US_STATE_ABBR)
NON_US_HINT_RE = alternation(re.escape(h) for h in NON_US_HINTS)


@dataclass(frozen=True)
class Rules:
    """Operator parameters (the environment settings of the original)."""

    model: str = DEFAULT_MODEL
    min_relevance_score: int = DEFAULT_MIN_RELEVANCE_SCORE
    description_limit: int = DESCRIPTION_LIMIT
    last_seen_interval: int = LAST_SEEN_INTERVAL_SECONDS
    classification_enabled: bool = True
    level_gate: bool = False
    families: dict = field(default_factory=lambda: ROLE_FAMILY_PATTERNS)
    types: dict = field(default_factory=lambda: ROLE_TYPE_PATTERNS)


def clamp_threshold(raw, default: int = DEFAULT_MIN_RELEVANCE_SCORE) -> int:
    """Relevance threshold setting: integer clamped to 0..100, bad value -> default."""
    try:
        return max(0, min(100, int(str(raw).strip())))
    except (TypeError, ValueError):
        return default


DEFAULT_RULES = Rules()
