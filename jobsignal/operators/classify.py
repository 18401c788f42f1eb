"""Rule classifier (C1-C8) as one narrow projection.

No shuffle and no Python.  The padded, normalised strings are computed once
per row; each label's score is a higher-order ``aggregate`` over a literal needle
array (evaluated JVM-side, without codegen: one flat ``instr`` per keyword
overflows Janino's 64 KB method limit and falls back anyway, after a long
failed compile).  Work scales linearly with the input partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import predicates as P
from jobsignal.functions import text as X
from jobsignal.functions.text import q

OUTPUT_COLUMNS = (
    "role_family", "family_score", "role_type", "type_score", "seniority", "seniority_score",
    "location_fit", "relevance_score", "confidence", "reason", "model",
)
_HELPERS = ("_t", "_l", "_d", "_pt", "_full", "_us", "_nonus", "_sen", "_h")


def _needle(keyword: str) -> str:
    return f" {keyword.strip()} "


def _needles(keywords) -> Column:
    return F.array(*[F.lit(_needle(k)) for k in keywords])


def _label_score(pt: Column, full: Column, keywords) -> Column:
    """3 points per keyword in the padded title, 1 per keyword in the full text.

    The padded title is a prefix of the full text, so it is searched only for what the text holds."""
    return F.aggregate(_needles(keywords), F.lit(0), lambda points, n: points + F.when(
        F.contains(full, n), F.when(F.contains(pt, n), F.lit(4)).otherwise(F.lit(1))).otherwise(F.lit(0)))


def _best(scores: Column, labels, default: str) -> tuple[Column, Column]:
    """Arg-max with strict '>' (first label reaching the maximum wins); none -> default.

    ``scores`` is one array column; each output references it a bounded number of
    times, so optimizer rewrites that inline aliases (filter pushdown) stay linear.
    """
    best = F.greatest(F.lit(0), F.array_max(scores))
    label = F.when(best == 0, F.lit(default)).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(scores, best).cast("int")))
    return label, best


def _seniority_hit(full: Column) -> Column:
    """First (label, keyword) in rule order found in the full text, or null."""
    pairs = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(_needle(k)).alias("needle"))
        for label, keywords in R.SENIORITY_PATTERNS.items() for k in keywords
    ])
    return F.try_element_at(F.filter(pairs, lambda s: F.contains(full, s["needle"])), F.lit(1))


def _seniority(pt: Column, hit: Column) -> tuple[Column, Column]:
    """Label of the first hit; 3 points if the keyword is in the title, else 1.

    The padded title is a prefix of the full text, so "title hit" implies "text hit".
    """
    label = F.coalesce(hit["label"], F.lit("unknown"))
    score = F.when(hit.isNull(), F.lit(0)).when(F.contains(pt, hit["needle"]), F.lit(3)).otherwise(F.lit(1))
    return label, score


def location_fit(norm_loc: Column, us: Column | None = None, non_us: Column | None = None) -> Column:
    """C4 on the X5-normalised location."""
    us = P.has_us_signal(norm_loc) if us is None else us
    non_us = P.non_us_hint(norm_loc) if non_us is None else non_us
    return (
        F.when(norm_loc == "", F.lit("unclear"))
        .when(non_us & ~us, F.lit("non_us"))
        .when(us & (F.instr(norm_loc, "remote") > 0), F.lit("us_remote"))
        .when(us & (F.instr(norm_loc, "hybrid") > 0), F.lit("hybrid_us"))
        .when(us, F.lit("us_onsite"))
        .otherwise(F.lit("unclear"))
    )


def _points(c: Column, table: dict[str, int]) -> Column:
    """Point table lookup (one reference to ``c``); labels outside the table score 0."""
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, c), F.lit(0))


def relevance(family: Column, rtype: Column, seniority: Column, fit: Column, fs: Column, ts: Column) -> Column:
    """Additive points, pair bonus, clamp to 0..100."""
    raw = (
        _points(family, R.FAMILY_POINTS) + _points(rtype, R.TYPE_POINTS)
        + _points(seniority, R.SENIORITY_POINTS) + _points(fit, R.FIT_POINTS)
        + F.when((fs >= 3) & (ts >= 2), F.lit(R.PAIR_BONUS)).otherwise(F.lit(0))
    )
    return F.least(F.lit(100), F.greatest(F.lit(0), raw))


def confidence_hundredths(fs: Column, ts: Column, ss: Column, fit: Column) -> Column:
    """C6 in integer hundredths (exact; avoids decimal vs binary rounding differences)."""
    raw = (
        F.lit(25) + F.least(F.lit(30), fs * 8) + F.least(F.lit(25), ts * 6)
        + F.when(ss != 0, 10).otherwise(0) + F.when(fit != "unclear", 10).otherwise(0)
    )
    return F.least(F.lit(98), F.greatest(F.lit(5), raw))


def reason(family, rtype, seniority, fit, score, hundredths) -> Column:
    """C7."""
    return F.concat(
        F.lit("Local classifier scored this as "), family, F.lit("/"), rtype,
        F.lit(", seniority="), seniority, F.lit(", location_fit="), fit,
        F.lit("; score="), score.cast("string"), F.lit(", confidence="), X.hundredths_text(hundredths), F.lit("."),
    )


def classify(df: DataFrame, rules: R.Rules = R.DEFAULT_RULES, title: str = "title",
             location: str = "location", description: str = "description") -> DataFrame:
    """Append the classification columns to ``df`` (narrow, no shuffle)."""
    base = df.select(
        "*",
        X.norm_text(F.col(title)).alias("_t"),
        X.norm_text(F.col(location)).alias("_l"),
        X.norm_text(X.truncate(F.col(description), rules.description_limit)).alias("_d"),
    )
    base = base.select(
        "*",
        F.concat(F.lit(" "), F.col("_t"), F.lit(" ")).alias("_pt"),
        F.concat(F.lit(" "), F.col("_t"), F.lit(" "), F.col("_l"), F.lit(" "), F.col("_d"), F.lit(" ")).alias("_full"),
        P.has_us_signal(F.col("_l")).alias("_us"),
        P.non_us_hint(F.col("_l")).alias("_nonus"),
    )
    pt, full = F.col("_pt"), F.col("_full")
    fam_labels, typ_labels = list(rules.families), list(rules.types)
    scored = base.select(
        "*",
        F.array(*[_label_score(pt, full, rules.families[lab]) for lab in fam_labels]).alias("_fam"),
        F.array(*[_label_score(pt, full, rules.types[lab]) for lab in typ_labels]).alias("_typ"),
        _seniority_hit(full).alias("_sen"),
        location_fit(F.col("_l"), F.col("_us"), F.col("_nonus")).alias("location_fit"),
    )
    fl, fs = _best(F.col("_fam"), fam_labels, "other")
    tl, ts = _best(F.col("_typ"), typ_labels, "other")
    sl, ss = _seniority(F.col("_pt"), F.col("_sen"))
    out = scored.select("*", fs.alias("family_score"), ts.alias("type_score"), ss.alias("seniority_score"))
    out = out.select(
        "*",
        F.when(F.col("family_score") == 0, F.lit("other")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in fam_labels]), F.array_position("_fam", F.col("family_score")).cast("int"))).alias("role_family"),
        F.when(F.col("type_score") == 0, F.lit("other")).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in typ_labels]), F.array_position("_typ", F.col("type_score")).cast("int"))).alias("role_type"),
        sl.alias("seniority"),
    )
    out = out.select(
        "*",
        relevance(F.col("role_family"), F.col("role_type"), F.col("seniority"), F.col("location_fit"),
                  F.col("family_score"), F.col("type_score")).alias("relevance_score"),
        confidence_hundredths(F.col("family_score"), F.col("type_score"), F.col("seniority_score"),
                              F.col("location_fit")).alias("_h"),
    )
    out = out.select(
        "*",
        (F.col("_h").cast("double") / F.lit(100.0)).alias("confidence"),
        reason(F.col("role_family"), F.col("role_type"), F.col("seniority"), F.col("location_fit"),
               F.col("relevance_score"), F.col("_h")).alias("reason"),
        F.lit(rules.model).alias("model"),
    )
    # The results leave through a one-element Generate: Catalyst never pushes a
    # predicate on generator output below it, so a downstream filter such as
    # ``relevance_score >= 75`` cannot be inlined into (and re-evaluate) the
    # keyword scoring above.
    result = F.struct(*[F.col(c).alias(c) for c in OUTPUT_COLUMNS])
    return out.select(*df.columns, F.inline(F.array(result)))


# ---------------------------------------------------------------------------
# DuckDB twin
# ---------------------------------------------------------------------------


def _sql_label_score(keywords) -> str:
    parts = []
    for k in keywords:
        n = q(_needle(k))
        parts.append(f"(CASE WHEN strpos(_pt, {n}) > 0 THEN 3 ELSE 0 END) + (CASE WHEN strpos(_full, {n}) > 0 THEN 1 ELSE 0 END)")
    return "(" + " + ".join(parts) + ")"


def _sql_best(cols: dict[str, str], default: str) -> tuple[str, str]:
    best = "greatest(0, " + ", ".join(cols.values()) + ")"
    label = f"CASE WHEN {best} = 0 THEN {q(default)} " + " ".join(
        f"WHEN {c} = {best} THEN {q(lab)}" for lab, c in cols.items()) + f" ELSE {q(default)} END"
    return label, best


def _sql_points(c: str, table: dict[str, int]) -> str:
    return f"(CASE {c} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table.items()) + " ELSE 0 END)"


def _sql_seniority(part: str) -> str:
    whens = []
    for label, keywords in R.SENIORITY_PATTERNS.items():
        for k in keywords:
            n = q(_needle(k))
            whens.append(f"WHEN strpos(_pt, {n}) > 0 THEN {q(label) if part == 'label' else 3}")
            whens.append(f"WHEN strpos(_full, {n}) > 0 THEN {q(label) if part == 'label' else 1}")
    return "CASE " + " ".join(whens) + (" ELSE 'unknown' END" if part == "label" else " ELSE 0 END")


def sql_location_fit(norm: str) -> str:
    us = P.sql.has_us_signal(norm)
    return (
        f"(CASE WHEN {norm} = '' THEN 'unclear' "
        f"WHEN {P.sql.non_us_hint(norm)} AND NOT {us} THEN 'non_us' "
        f"WHEN {us} AND strpos({norm}, 'remote') > 0 THEN 'us_remote' "
        f"WHEN {us} AND strpos({norm}, 'hybrid') > 0 THEN 'hybrid_us' "
        f"WHEN {us} THEN 'us_onsite' ELSE 'unclear' END)"
    )


def sql_classify(rel: str, rules: R.Rules = R.DEFAULT_RULES, title: str = "title",
                 location: str = "location", description: str = "description") -> str:
    """SELECT <rel columns> + classification columns FROM rel."""
    fam = {lab: f"_f{i}" for i, lab in enumerate(rules.families)}
    typ = {lab: f"_y{i}" for i, lab in enumerate(rules.types)}
    s0 = (
        f"SELECT *, {X.sql.norm_text(title)} AS _t, {X.sql.norm_text(location)} AS _l, "
        f"{X.sql.norm_text(X.sql.truncate(description, rules.description_limit))} AS _d FROM {rel}"
    )
    s1 = f"SELECT *, ' ' || _t || ' ' AS _pt, ' ' || _t || ' ' || _l || ' ' || _d || ' ' AS _full FROM ({s0}) s0"
    s2 = (
        "SELECT *, "
        + ", ".join(f"{_sql_label_score(rules.families[lab])} AS {c}" for lab, c in fam.items()) + ", "
        + ", ".join(f"{_sql_label_score(rules.types[lab])} AS {c}" for lab, c in typ.items()) + ", "
        + f"{_sql_seniority('label')} AS seniority, {_sql_seniority('score')} AS seniority_score, "
        + f"{sql_location_fit('_l')} AS location_fit FROM ({s1}) s1"
    )
    fl, fs = _sql_best(fam, "other")
    tl, ts = _sql_best(typ, "other")
    s3 = f"SELECT *, {fl} AS role_family, {fs} AS family_score, {tl} AS role_type, {ts} AS type_score FROM ({s2}) s2"
    rel_pts = (
        f"{_sql_points('role_family', R.FAMILY_POINTS)} + {_sql_points('role_type', R.TYPE_POINTS)} + "
        f"{_sql_points('seniority', R.SENIORITY_POINTS)} + {_sql_points('location_fit', R.FIT_POINTS)} + "
        f"(CASE WHEN family_score >= 3 AND type_score >= 2 THEN {R.PAIR_BONUS} ELSE 0 END)"
    )
    h = (
        "least(98, greatest(5, 25 + least(30, family_score * 8) + least(25, type_score * 6) + "
        "(CASE WHEN seniority_score <> 0 THEN 10 ELSE 0 END) + (CASE WHEN location_fit <> 'unclear' THEN 10 ELSE 0 END)))"
    )
    s4 = f"SELECT *, least(100, greatest(0, {rel_pts})) AS relevance_score, {h} AS _h FROM ({s3}) s3"
    reason_sql = (
        "'Local classifier scored this as ' || role_family || '/' || role_type || ', seniority=' || seniority || "
        "', location_fit=' || location_fit || '; score=' || CAST(relevance_score AS VARCHAR) || ', confidence=' || "
        f"{X.sql.hundredths_text('_h')} || '.'"
    )
    s5 = (
        f"SELECT *, CAST(_h AS DOUBLE) / 100.0 AS confidence, {reason_sql} AS reason, {q(rules.model)} AS model "
        f"FROM ({s4}) s4"
    )
    drop = ", ".join(["_t", "_l", "_d", "_pt", "_full", "_h"] + list(fam.values()) + list(typ.values()))
    return f"SELECT * EXCLUDE ({drop}) FROM ({s5}) s5"
