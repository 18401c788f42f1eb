"""Scalar text functions (X1-X22) as native Column expressions.

Every function has a twin in :class:`sql` that renders the same logic as a
DuckDB expression string; the twins feed the correctness oracle, so both
engines run the very same regex text (see :mod:`jobsignal.rules`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsignal import rules as R

# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------


def lit_str(s: str) -> Column:
    return F.lit(s)


def one_by_one(chars: str) -> str:
    """Body of a character class that names its characters singly: the regex engine looks
    these up in a table, where each range of a class costs calls per character."""
    return "".join("\\" + ch if ch in "[]^&-\\" else ch for ch in chars)


_VISIBLE = "".join(map(chr, range(0x21, 0x7F)))
_TOKEN = one_by_one("abcdefghijklmnopqrstuvwxyz0123456789.+#-")
#: Runs of white space; a visible ASCII character is turned away by the table alone.
WS_RUN = f"(?![{one_by_one(_VISIBLE)}]){R.WS}+"


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(R.WS_CHARS))


def clean(c: Column) -> Column:
    """Null -> '', then strip."""
    return strip_ws(F.coalesce(c.cast("string"), F.lit("")))


def compact_text(c: Column) -> Column:
    """Collapse whitespace runs to one space and strip."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), WS_RUN, " "))


def strip_html(c: Column) -> Column:
    """<br>, </p> -> newline; other tags -> space; collapse.  No entity decoding."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    t = F.regexp_replace(t, f"(?i)<br{R.WS}*/?>", "\n")
    t = F.regexp_replace(t, f"(?i)</p{R.WS}*>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    return compact_text(t)


def join_text(values: Column, sep: str = " ") -> Column:
    """Compact each value, drop empties, keep first occurrences, join."""
    compacted = F.transform(values, lambda v: compact_text(v))
    return F.array_join(F.array_distinct(F.filter(compacted, lambda v: v != F.lit(""))), sep)


def normalize_title(c: Column) -> Column:
    """Lower, non-word/non-space -> space, collapse, strip."""
    t = F.lower(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, R.NOT_WORD_NOT_WS, " ")
    return F.trim(F.regexp_replace(t, WS_RUN, " "))


def norm_text(c: Column) -> Column:
    """Classifier normalisation (ASCII token alphabet)."""
    t = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    t = F.regexp_replace(t, f"[^{_TOKEN}]+", " ")
    return F.trim(t)


def truncate(c: Column, n: int) -> Column:
    """First n characters (code points)."""
    return F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, n)


#: Characters that stand for themselves in a JSON string of plain ASCII; the rest is escaped one by one.
JSON_PLAIN = r" !#-\[\]-~"
_PLAIN = one_by_one(" " + _VISIBLE.replace('"', "").replace("\\", ""))
_UNESCAPED = one_by_one(" " + _VISIBLE.replace("\\", "") + "\x01\x02")
_PRINTED = one_by_one(" " + _VISIBLE + "\x01\x02")


def _unicode_escape(ch: Column) -> Column:
    """JSON escape of one character; beyond U+FFFF the pair of surrogates."""
    n = F.ascii(ch)
    high = F.lit(0xD800) + F.shiftright(n - 0x10000, 10)
    low = F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))
    return F.when(n < 0x10000, F.format_string("\\u%04x", n)).otherwise(F.format_string("\\u%04x\\u%04x", high, low))


def json_string(c: Column) -> Column:
    """A text as JSON string of plain ASCII; only texts that need escapes are taken apart."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def escape(t: Column) -> Column:
        out = F.when(t.rlike(f"^[{_PLAIN}]"), t)
        for k, v in short.items():
            out = out.when(t == F.lit(k), F.lit(v))
        return out.otherwise(_unicode_escape(t))

    parts = F.regexp_extract_all(c, F.lit(f"([{_PLAIN}]+|[^{_PLAIN}])"), F.lit(1))
    body = F.when(c.rlike(f"[^{_PLAIN}]"), F.array_join(F.transform(parts, escape), "")).otherwise(c)
    return F.concat(F.lit('"'), body, F.lit('"'))


def canonical_json(compact: Column) -> Column:
    """Compact JSON with sorted keys (``to_json`` of a VARIANT) as plain ASCII with ``", "`` and ``": "``.

    Escaped backslashes and quotes become U+0001 and U+0002, which no JSON text holds, so
    splitting at quotes gives structure and string contents in turn, at any depth.  Numbers
    stay as VARIANT writes them; keys are in VARIANT's order (UTF-16).  Null stays null."""
    marked = F.replace(F.replace(compact, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))

    def escape(t: Column) -> Column:
        return (F.when(t.rlike(r"^\\u"), F.lower(t)).when(t.rlike("^[ -~\x01\x02]"), t).otherwise(_unicode_escape(t)))

    def content(x: Column) -> Column:
        parts = F.regexp_extract_all(x, F.lit(f"(\\\\u[0-9A-Fa-f]{{4}}|\\\\[^u]|[{_UNESCAPED}]+|[^{_PRINTED}])"), F.lit(1))
        return F.when(x.rlike(f"[^{_PRINTED}]") | F.contains(x, F.lit("\\u")), F.array_join(F.transform(parts, escape), "")).otherwise(x)

    def piece(x: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.replace(F.replace(x, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))).otherwise(content(x))

    text = F.array_join(F.transform(F.split(marked, '"', -1), piece), '"')
    return F.replace(F.replace(text, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))


def content_hash(company: Column, title: Column, location: Column, url: Column, description: Column, cleaned: bool = False) -> Column:
    """SHA-256 of the compact ASCII JSON object with sorted keys (``cleaned``: the fields are clean already)."""
    fix = (lambda c: c) if cleaned else clean
    fields = {"company": company, "description": description, "location": location, "title": title, "url": url}
    parts = []
    for k, v in fields.items():
        parts += [F.lit(("," if parts else "{") + f'"{k}":'), json_string(fix(v))]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


def work_type(c: Column) -> Column:
    """Remote > hybrid > on-site from free text."""
    t = F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(F.instr(t, "remote") > 0, F.lit("remote"))
        .when(F.instr(t, "hybrid") > 0, F.lit("hybrid"))
        .otherwise(F.lit("on-site"))
    )


def ashby_workplace(workplace: Column, location: Column) -> Column:
    """Accepted workplace values, otherwise inferred from the location."""
    w = strip_ws(F.lower(F.coalesce(workplace, F.lit(""))))
    return (
        F.when(w.isin("onsite", "on-site"), F.lit("on-site"))
        .when(w.isin("remote", "hybrid"), w)
        .otherwise(work_type(location))
    )


def utc_wall_time(ts: Column) -> Column:
    """Epoch seconds as a TIMESTAMP_NTZ holding the UTC wall time (no session-zone shift)."""
    return F.timestamp_add("SECOND", ts, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def format_ts(ts: Column) -> Column:
    """X14: 'yyyy-MM-dd HH:mm:ss' in UTC; '-' for null/0."""
    return F.when(F.coalesce(ts, F.lit(0)) == 0, F.lit("-")).otherwise(
        F.date_format(utc_wall_time(ts), "yyyy-MM-dd HH:mm:ss")
    )


def short_ts(ts: Column) -> Column:
    """X15: 'HH:mm:ss' in UTC."""
    return F.date_format(utc_wall_time(ts), "HH:mm:ss")


def _url_path(raw: Column) -> Column:
    return F.regexp_extract(raw, "^[^:/?#]*://[^/?#]*([^?#]*)", 1)


def _first_segment(path: Column) -> Column:
    return F.regexp_extract(path, "^/*([^/]+)", 1)


def percent_decode(c: Column) -> Column:
    """Python ``unquote``: '+' stays '+'; malformed input is kept as is."""
    protected = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(protected), c)


def slugify_ashby(c: Column) -> Column:
    """Board slug from a hosted page name or URL."""
    raw = strip_ws(F.coalesce(c, F.lit("")))
    seg = _first_segment(_url_path(raw))
    raw = F.when((F.instr(raw, "://") > 0) & (seg != ""), seg).otherwise(raw)
    raw = strip_ws(percent_decode(raw))
    raw = F.replace(F.replace(raw, F.lit("Careers Page"), F.lit("")), F.lit("careers page"), F.lit(""))
    raw = strip_ws(raw)
    raw = F.replace(raw, F.lit("&"), F.lit("and"))
    raw = F.replace(raw, F.lit("_"), F.lit("-"))
    raw = F.regexp_replace(raw, f"{R.WS}+", "-")
    raw = F.regexp_replace(raw, "[^a-zA-Z0-9-]", "")
    raw = F.lower(F.regexp_replace(raw, "^-+|-+$", ""))
    return F.regexp_replace(raw, "-{2,}", "-")


def greenhouse_slug(c: Column) -> Column:
    """Slug of a Greenhouse board line; null when the line is invalid."""
    host = R.HOSTS["greenhouse"]
    s = strip_ws(F.coalesce(c, F.lit("")))
    has_scheme = F.instr(s, "://") > 0
    has_host = F.instr(s, host) > 0
    url = (
        F.when(~has_scheme & ~has_host, F.concat(F.lit(f"https://{host}/"), F.regexp_replace(s, "^/+|/+$", "")))
        .when(~has_scheme & has_host, F.concat(F.lit("https://"), s))
        .otherwise(s)
    )
    url = F.regexp_replace(url, "/+$", "")
    seg = _first_segment(_url_path(url))
    return F.when((s == "") | (seg == ""), F.lit(None).cast("string")).otherwise(seg)


def lever_slug(c: Column) -> Column:
    """X11: company of a Lever board line; null when the line is invalid."""
    host = R.HOSTS["lever"]
    s = strip_ws(F.coalesce(c, F.lit("")))
    has_scheme = F.instr(s, "://") > 0
    has_host = F.instr(s, host) > 0
    seg = _first_segment(_url_path(F.when(~has_scheme, F.concat(F.lit("https://"), s)).otherwise(s)))
    return (
        F.when(s == "", F.lit(None).cast("string"))
        .when(~has_scheme & ~has_host, F.regexp_replace(s, "^/+|/+$", ""))
        .when(seg == "", F.lit(None).cast("string"))
        .otherwise(seg)
    )


def url_host(link: Column) -> Column:
    return F.regexp_extract(link, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def extract_slug(link: Column, expected_host: Column) -> Column:
    """First path part of a search link on the expected host."""
    path = F.regexp_extract(link, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    slug = strip_ws(_first_segment(path))
    ok = (
        (F.lower(url_host(link)) == F.lower(expected_host))
        & (slug != "")
        & ~F.lower(slug).isin(*R.RESERVED_SLUGS)
    )
    return F.when(ok, slug)


def status_badge(status: Column) -> Column:
    """Dashboard pill colour."""
    low = F.lower(F.coalesce(status.cast("string"), F.lit("")))
    pat = "^(" + "|".join(R.BADGE_ERROR_PREFIXES) + ")"
    return F.when(low.rlike(pat), F.lit("error")).otherwise(F.lit("ok"))


def escape_label(c: Column) -> Column:
    """Escape backslash, newline and double quote."""
    t = F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\"))
    t = F.replace(t, F.lit("\n"), F.lit("\\n"))
    return F.replace(t, F.lit('"'), F.lit('\\"'))


def metric_line(name: Column, labels: Column, value: Column) -> Column:
    """Exposition line; ``labels`` is a map<string,string> rendered sorted by key."""
    entries = F.array_sort(F.map_entries(labels))
    rendered = F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit('="'), escape_label(e["value"]), F.lit('"'))),
        ",",
    )
    return F.when(
        F.coalesce(F.size(labels), F.lit(0)) <= 0, F.concat_ws(" ", name, value.cast("string"))
    ).otherwise(F.concat(name, F.lit("{"), rendered, F.lit("} "), value.cast("string")))


def hundredths_text(h: Column) -> Column:
    """Python float repr of h/100 for 0 < h < 100 ('0.98', '0.9', '0.05')."""
    return F.when(h % 10 == 0, F.concat(F.lit("0."), (h / 10).cast("int").cast("string"))).otherwise(
        F.concat(F.lit("0."), F.lpad(h.cast("string"), 2, "0"))
    )


# ---------------------------------------------------------------------------
# DuckDB twins (oracle)
# ---------------------------------------------------------------------------


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


class sql:  # noqa: N801 - namespace
    @staticmethod
    def strip_ws(e: str) -> str:
        return f"regexp_replace({e}, {q('^' + R.WS + '+|' + R.WS + '+$')}, '', 'g')"

    @staticmethod
    def clean(e: str) -> str:
        return sql.strip_ws(f"coalesce(CAST({e} AS VARCHAR), '')")

    @staticmethod
    def compact_text(e: str) -> str:
        return f"trim(regexp_replace(coalesce(CAST({e} AS VARCHAR), ''), {q(R.WS + '+')}, ' ', 'g'))"

    @staticmethod
    def strip_html(e: str) -> str:
        t = f"coalesce(CAST({e} AS VARCHAR), '')"
        t = f"regexp_replace({t}, {q('(?i)<br' + R.WS + '*/?>')}, chr(10), 'g')"
        t = f"regexp_replace({t}, {q('(?i)</p' + R.WS + '*>')}, chr(10), 'g')"
        t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
        return sql.compact_text(t)

    @staticmethod
    def join_text(list_expr: str, sep: str = " ") -> str:
        comp = f"list_transform({list_expr}, lambda v: {sql.compact_text('v')})"
        nonempty = f"list_filter({comp}, lambda v: v <> '')"
        firsts = f"list_filter({nonempty}, lambda v, i: list_position({nonempty}, v) = i)"
        return f"coalesce(array_to_string({firsts}, {q(sep)}), '')"

    @staticmethod
    def normalize_title(e: str) -> str:
        t = f"lower(coalesce({e}, ''))"
        t = f"regexp_replace({t}, {q(R.NOT_WORD_NOT_WS)}, ' ', 'g')"
        return f"trim(regexp_replace({t}, {q(R.WS + '+')}, ' ', 'g'))"

    @staticmethod
    def norm_text(e: str) -> str:
        t = f"lower(coalesce(CAST({e} AS VARCHAR), ''))"
        return f"trim(regexp_replace({t}, '[^a-z0-9.+#-]+', ' ', 'g'))"

    @staticmethod
    def truncate(e: str, n: int) -> str:
        return f"substring(coalesce(CAST({e} AS VARCHAR), ''), 1, {n})"

    @staticmethod
    def json_string(e: str) -> str:
        escaped = " ".join(f"WHEN {k} THEN '{v}'" for k, v in (("'\"'", '\\"'), ("'\\'", "\\\\"), ("chr(10)", "\\n"), ("chr(13)", "\\r"),
                                                               ("chr(9)", "\\t"), ("chr(8)", "\\b"), ("chr(12)", "\\f")))
        code = (f"CASE WHEN unicode(t) < 65536 THEN printf('\\u%04x', unicode(t)) "
                f"ELSE printf('\\u%04x\\u%04x', 55296 + (unicode(t) - 65536) // 1024, 56320 + (unicode(t) - 65536) % 1024) END")
        token = f"CASE WHEN regexp_matches(t, '^[{JSON_PLAIN}]') THEN t ELSE CASE t {escaped} ELSE {code} END END"
        parts = f"regexp_extract_all({e}, '[{JSON_PLAIN}]+|[^{JSON_PLAIN}]')"
        return (f"""('"' || CASE WHEN regexp_matches({e}, '[^{JSON_PLAIN}]') THEN array_to_string(list_transform({parts}, lambda t: {token}), '') """
                f"""ELSE {e} END || '"')""")

    @staticmethod
    def content_hash(company: str, title: str, location: str, url: str, description: str) -> str:
        fields = {"company": company, "description": description, "location": location, "title": title, "url": url}
        parts = [f"""'"{k}":' || {sql.json_string(sql.clean(v))}""" for k, v in fields.items()]
        return "sha256('{' || " + " || ',' || ".join(parts) + " || '}')"

    @staticmethod
    def work_type(e: str) -> str:
        t = f"lower(coalesce({e}, ''))"
        return (
            f"CASE WHEN strpos({t}, 'remote') > 0 THEN 'remote' "
            f"WHEN strpos({t}, 'hybrid') > 0 THEN 'hybrid' ELSE 'on-site' END"
        )

    @staticmethod
    def ashby_workplace(workplace: str, location: str) -> str:
        w = sql.strip_ws(f"lower(coalesce({workplace}, ''))")
        return (
            f"CASE WHEN {w} IN ('onsite', 'on-site') THEN 'on-site' "
            f"WHEN {w} IN ('remote', 'hybrid') THEN {w} ELSE {sql.work_type(location)} END"
        )

    @staticmethod
    def format_ts(e: str) -> str:
        return (
            f"CASE WHEN coalesce({e}, 0) = 0 THEN '-' "
            f"ELSE strftime(make_timestamp(CAST({e} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') END"
        )

    @staticmethod
    def short_ts(e: str) -> str:
        return f"strftime(make_timestamp(CAST({e} AS BIGINT) * 1000000), '%H:%M:%S')"

    @staticmethod
    def _url_path(e: str) -> str:
        return f"regexp_extract({e}, '^[^:/?#]*://[^/?#]*([^?#]*)', 1)"

    @staticmethod
    def _first_segment(e: str) -> str:
        return f"regexp_extract({e}, '^/*([^/]+)', 1)"

    @staticmethod
    def slugify_ashby(e: str) -> str:
        raw = sql.strip_ws(f"coalesce({e}, '')")
        seg = sql._first_segment(sql._url_path(raw))
        raw = f"(CASE WHEN strpos({raw}, '://') > 0 AND {seg} <> '' THEN {seg} ELSE {raw} END)"
        dec = f"url_decode(replace({raw}, '+', '%2B'))"
        raw = sql.strip_ws(dec)
        raw = sql.strip_ws(f"replace(replace({raw}, 'Careers Page', ''), 'careers page', '')")
        raw = f"replace(replace({raw}, '&', 'and'), '_', '-')"
        raw = f"regexp_replace({raw}, {q(R.WS + '+')}, '-', 'g')"
        raw = f"regexp_replace({raw}, '[^a-zA-Z0-9-]', '', 'g')"
        raw = f"lower(regexp_replace({raw}, '^-+|-+$', '', 'g'))"
        return f"regexp_replace({raw}, '-{{2,}}', '-', 'g')"

    @staticmethod
    def greenhouse_slug(e: str) -> str:
        host = R.HOSTS["greenhouse"]
        s = sql.strip_ws(f"coalesce({e}, '')")
        url = (
            f"(CASE WHEN strpos({s}, '://') = 0 AND strpos({s}, '{host}') = 0 "
            f"THEN 'https://{host}/' || regexp_replace({s}, '^/+|/+$', '', 'g') "
            f"WHEN strpos({s}, '://') = 0 THEN 'https://' || {s} ELSE {s} END)"
        )
        url = f"regexp_replace({url}, '/+$', '')"
        seg = sql._first_segment(sql._url_path(url))
        return f"(CASE WHEN {s} = '' OR {seg} = '' THEN NULL ELSE {seg} END)"

    @staticmethod
    def lever_slug(e: str) -> str:
        host = R.HOSTS["lever"]
        s = sql.strip_ws(f"coalesce({e}, '')")
        url = f"(CASE WHEN strpos({s}, '://') = 0 THEN 'https://' || {s} ELSE {s} END)"
        seg = sql._first_segment(sql._url_path(url))
        return (
            f"(CASE WHEN {s} = '' THEN NULL "
            f"WHEN strpos({s}, '://') = 0 AND strpos({s}, '{host}') = 0 THEN regexp_replace({s}, '^/+|/+$', '', 'g') "
            f"WHEN {seg} = '' THEN NULL ELSE {seg} END)"
        )

    @staticmethod
    def url_host(e: str) -> str:
        return f"regexp_extract({e}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"

    @staticmethod
    def extract_slug(link: str, host: str) -> str:
        path = f"regexp_extract({link}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
        slug = sql.strip_ws(sql._first_segment(path))
        reserved = ", ".join(q(s) for s in R.RESERVED_SLUGS)
        return (
            f"(CASE WHEN lower({sql.url_host(link)}) = lower({host}) AND {slug} <> '' "
            f"AND lower({slug}) NOT IN ({reserved}) THEN {slug} END)"
        )

    @staticmethod
    def status_badge(e: str) -> str:
        pat = "^(" + "|".join(R.BADGE_ERROR_PREFIXES) + ")"
        return f"(CASE WHEN regexp_matches(lower(coalesce(CAST({e} AS VARCHAR), '')), {q(pat)}) THEN 'error' ELSE 'ok' END)"

    @staticmethod
    def escape_label(e: str) -> str:
        return f"replace(replace(replace(CAST({e} AS VARCHAR), '\\', '\\\\'), chr(10), '\\n'), '\"', '\\\"')"

    @staticmethod
    def hundredths_text(h: str) -> str:
        return (
            f"(CASE WHEN {h} % 10 = 0 THEN '0.' || CAST(CAST({h} // 10 AS INTEGER) AS VARCHAR) "
            f"ELSE '0.' || lpad(CAST({h} AS VARCHAR), 2, '0') END)"
        )
