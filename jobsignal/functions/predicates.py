"""Predicates (F1-F17) as Column expressions, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import text as X
from jobsignal.functions.text import q


def fenced_where(df, cond: Column):
    """``df.where(cond)`` evaluated where it stands in the plan.

    The condition leaves through a one-element Generate, so Catalyst cannot push
    an expensive predicate (big regex alternations) below a preceding exchange;
    it still runs before any later shuffle."""
    return df.select("*", F.inline(F.array(F.struct(cond.alias("_keep"))))).where("_keep").drop("_keep")


def title_matches(title: Column, level_gate: bool = False) -> Column:
    """F1 (+F2 when ``level_gate``): exclude list first, then need an include pattern."""
    t = X.normalize_title(title)
    ok = ~t.rlike(R.TITLE_EXCLUDE_RE) & t.rlike(R.TITLE_INCLUDE_RE)
    return ok & t.rlike(R.TITLE_LEVEL_RE) if level_gate else ok


def level_hint(title: Column) -> Column:
    """early-career hint on the normalised title."""
    return X.normalize_title(title).rlike(R.TITLE_LEVEL_RE)


def is_us_location(text: Column) -> Column:
    """US location test on raw lower-cased text (monitor rules)."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(R.US_LOCATION_RE)


def any_us_location(texts: Column) -> Column:
    """any of an array of location texts is US."""
    return F.coalesce(F.exists(texts, lambda t: is_us_location(t)), F.lit(False))


def nonempty_id(c: Column) -> Column:
    """id present ('' / 0 / null dropped)."""
    s = X.strip_ws(F.coalesce(c.cast("string"), F.lit("")))
    return (s != "") & (s != "0")


def has_us_signal(norm: Column) -> Column:
    """US signal on X5-normalised text."""
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    hit = F.lit(False)
    for p in R.US_SIGNAL_PHRASES + R.CLASSIFIER_US_STATES:
        hit = hit | (F.instr(padded, f" {p} ") > 0)
    return hit | norm.rlike(R.ABBR_RE)


def non_us_hint(norm: Column) -> Column:
    """substring test against the non-US hint list."""
    return norm.rlike(R.NON_US_HINT_RE)


def is_error_status(status: Column) -> Column:
    """anything but ok / new match / unchanged (304) after strip+lower."""
    s = F.lower(X.strip_ws(F.coalesce(status, F.lit(""))))
    return ~s.isin(*R.NON_ERROR_STATUSES)


def required_present(*cols: Column) -> Column:
    """each required field non-empty after clean."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & (F.length(X.clean(c)) > 0)
    return ok


def is_relevant(score: Column, threshold: int) -> Column:
    """F8: score >= clamped threshold; missing classification -> false."""
    return F.coalesce(score >= F.lit(R.clamp_threshold(threshold)), F.lit(False))


def valid_classification(family, rtype, seniority, fit, reason, score, confidence) -> Column:
    """enum, reason, score and confidence checks."""
    return (
        X.strip_ws(F.coalesce(family, F.lit(""))).isin(*R.ROLE_FAMILIES)
        & X.strip_ws(F.coalesce(rtype, F.lit(""))).isin(*R.ROLE_TYPES)
        & X.strip_ws(F.coalesce(seniority, F.lit(""))).isin(*R.SENIORITIES)
        & X.strip_ws(F.coalesce(fit, F.lit(""))).isin(*R.LOCATION_FITS)
        & (F.length(X.strip_ws(F.coalesce(reason, F.lit("")))) > 0)
        & F.coalesce(score.between(0, 100), F.lit(False))
        & F.coalesce(confidence.between(0.0, 1.0), F.lit(False))
    )


def classification_problem(family, rtype, seniority, fit, reason, score, confidence) -> Column:
    """what the first failed check says; null where the classification is valid."""
    names = (("role_family", family, R.ROLE_FAMILIES), ("role_type", rtype, R.ROLE_TYPES),
             ("seniority", seniority, R.SENIORITIES), ("location_fit", fit, R.LOCATION_FITS))
    checks = []
    for name, value, allowed in names:
        given = X.strip_ws(F.coalesce(value, F.lit("")))
        checks.append(F.when(~given.isin(*allowed), F.concat(F.lit(f"invalid {name}: "), given)))
    return F.coalesce(
        *checks,
        F.when(F.length(X.strip_ws(F.coalesce(reason, F.lit("")))) == 0, F.lit("missing reason")),
        F.when(score.isNull(), F.lit("missing relevance_score")), F.when(confidence.isNull(), F.lit("missing confidence")),
        F.when(~score.between(0, 100), F.lit("relevance_score must be between 0 and 100")),
        F.when(~confidence.between(0.0, 1.0), F.lit("confidence must be between 0 and 1")))


def _in_list(values) -> str:
    return ", ".join(q(v) for v in values)


class sql:  # noqa: N801
    @staticmethod
    def title_matches(e: str, level_gate: bool = False) -> str:
        t = X.sql.normalize_title(e)
        ok = f"(NOT regexp_matches({t}, {q(R.TITLE_EXCLUDE_RE)}) AND regexp_matches({t}, {q(R.TITLE_INCLUDE_RE)}))"
        return f"({ok} AND regexp_matches({t}, {q(R.TITLE_LEVEL_RE)}))" if level_gate else ok

    @staticmethod
    def level_hint(e: str) -> str:
        return f"regexp_matches({X.sql.normalize_title(e)}, {q(R.TITLE_LEVEL_RE)})"

    @staticmethod
    def is_us_location(e: str) -> str:
        return f"regexp_matches(lower(coalesce({e}, '')), {q(R.US_LOCATION_RE)})"

    @staticmethod
    def nonempty_id(e: str) -> str:
        s = X.sql.strip_ws(f"coalesce(CAST({e} AS VARCHAR), '')")
        return f"({s} <> '' AND {s} <> '0')"

    @staticmethod
    def has_us_signal(norm: str) -> str:
        padded = f"(' ' || {norm} || ' ')"
        tests = [f"strpos({padded}, {q(' ' + p + ' ')}) > 0" for p in R.US_SIGNAL_PHRASES + R.CLASSIFIER_US_STATES]
        tests.append(f"regexp_matches({norm}, {q(R.ABBR_RE)})")
        return "(" + " OR ".join(tests) + ")"

    @staticmethod
    def non_us_hint(norm: str) -> str:
        return f"regexp_matches({norm}, {q(R.NON_US_HINT_RE)})"

    @staticmethod
    def is_error_status(e: str) -> str:
        s = "lower(" + X.sql.strip_ws(f"coalesce({e}, '')") + ")"
        return f"({s} NOT IN ({_in_list(R.NON_ERROR_STATUSES)}))"

    @staticmethod
    def required_present(*cols: str) -> str:
        return "(" + " AND ".join(f"length({X.sql.clean(c)}) > 0" for c in cols) + ")"

    @staticmethod
    def classification_problem(family, rtype, seniority, fit, reason, score, confidence) -> str:
        def given(e):
            return X.sql.strip_ws(f"coalesce({e}, '')")

        names = (("role_family", family, R.ROLE_FAMILIES), ("role_type", rtype, R.ROLE_TYPES),
                 ("seniority", seniority, R.SENIORITIES), ("location_fit", fit, R.LOCATION_FITS))
        return ("(CASE " + " ".join(f"WHEN {given(e)} NOT IN ({_in_list(allowed)}) THEN 'invalid {n}: ' || {given(e)}" for n, e, allowed in names)
                + f" WHEN length({given(reason)}) = 0 THEN 'missing reason' WHEN {score} IS NULL THEN 'missing relevance_score' "
                f"WHEN {confidence} IS NULL THEN 'missing confidence' "
                f"WHEN {score} NOT BETWEEN 0 AND 100 THEN 'relevance_score must be between 0 and 100' "
                f"WHEN {confidence} NOT BETWEEN 0.0 AND 1.0 THEN 'confidence must be between 0 and 1' END)")

    @staticmethod
    def valid_classification(family, rtype, seniority, fit, reason, score, confidence) -> str:
        s = X.sql.strip_ws
        return (
            f"({s(f'coalesce({family}, {q(str())})')} IN ({_in_list(R.ROLE_FAMILIES)}) "
            f"AND {s(f'coalesce({rtype}, {q(str())})')} IN ({_in_list(R.ROLE_TYPES)}) "
            f"AND {s(f'coalesce({seniority}, {q(str())})')} IN ({_in_list(R.SENIORITIES)}) "
            f"AND {s(f'coalesce({fit}, {q(str())})')} IN ({_in_list(R.LOCATION_FITS)}) "
            f"AND length({s(f'coalesce({reason}, {q(str())})')}) > 0 "
            f"AND coalesce({score} BETWEEN 0 AND 100, false) "
            f"AND coalesce({confidence} BETWEEN 0.0 AND 1.0, false))"
        )
