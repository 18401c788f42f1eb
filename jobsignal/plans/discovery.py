"""Discovery queries over search hits and board lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import text as X
from jobsignal.operators import discover as D
from jobsignal.plans.registry import register
from jobsignal.session import state_root
from jobsignal.sources.testdata import table, v_search_hits, with_views

N_QUERIES = 3
SLUG_SQL = X.sql.extract_slug("link", "platform")
HB = (f"SELECT *, {SLUG_SQL} AS slug, CASE WHEN {SLUG_SQL} IS NOT NULL THEN 'https://' || platform || '/' || {SLUG_SQL} END AS base "
      "FROM v_search_hits")


def _yield_sql() -> str:
    ctes = [("hb", HB)]
    parts = []
    for q in range(N_QUERIES):
        excl = "" if q == 0 else f" AND NOT EXISTS (SELECT 1 FROM seen{q-1} s WHERE s.run = h.run AND s.platform = h.platform AND s.base = h.base)"
        ctes += [
            (f"cand{q}", f"""SELECT run, platform, start FROM (SELECT run, platform, start, row_number() OVER (PARTITION BY run, platform ORDER BY start) AS rn
                FROM (SELECT DISTINCT run, platform, start FROM hb WHERE query_idx = {q} AND start <= {R.SEARCH_MAX_START}) p) x WHERE start = 10 * (rn - 1)"""),
            (f"f{q}", f"""SELECT h.run, h.platform, h.base, min(h.start) AS start FROM hb h JOIN cand{q} c ON c.run = h.run AND c.platform = h.platform AND c.start = h.start
                WHERE h.query_idx = {q} AND h.base IS NOT NULL{excl} GROUP BY h.run, h.platform, h.base"""),
            (f"n{q}", f"""SELECT c.run, c.platform, c.start, count(f.base) AS new_boards FROM cand{q} c LEFT JOIN f{q} f
                ON f.run = c.run AND f.platform = c.platform AND f.start = c.start GROUP BY c.run, c.platform, c.start"""),
            (f"k{q}", f"""SELECT *, sum(CASE WHEN new_boards = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run, platform, grp ORDER BY start ROWS UNBOUNDED PRECEDING) AS streak
                FROM (SELECT *, sum(CASE WHEN new_boards > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run, platform ORDER BY start ROWS UNBOUNDED PRECEDING) AS grp FROM n{q}) s"""),
            (f"a{q}", f"""SELECT k.run, k.platform, {q} AS query_idx, k.start, CAST(k.new_boards AS BIGINT) AS new_boards FROM k{q} k
                LEFT JOIN (SELECT run, platform, min(start) AS stop FROM k{q} WHERE streak >= {R.SEARCH_EMPTY_STREAK} GROUP BY run, platform) z USING (run, platform)
                WHERE z.stop IS NULL OR k.start <= z.stop"""),
            (f"seen{q}", f"SELECT run, platform, base FROM f{q} f WHERE EXISTS (SELECT 1 FROM a{q} a WHERE a.run = f.run AND a.platform = f.platform AND a.start = f.start)"
             + (f" UNION ALL SELECT run, platform, base FROM seen{q-1}" if q else "")),
        ]
        parts.append(f"SELECT * FROM a{q}")
    body = ("SELECT run, platform, query_idx, start, new_boards, CAST(sum(new_boards) OVER (PARTITION BY run, platform ORDER BY query_idx, start "
            "ROWS UNBOUNDED PRECEDING) AS BIGINT) AS discovered_total FROM (" + " UNION ALL ".join(parts) + ") u")
    return with_views(["v_search_hits"], body, ctes)


def _hits(spark, sf):
    return v_search_hits(spark, sf)


@register("extract_slug", ids="X12 F11",
          sql=lambda: with_views(["v_search_hits"], f"SELECT link, {SLUG_SQL} AS slug FROM v_search_hits"))
def extract_slug(spark, sf):
    return D.with_slug(_hits(spark, sf)).select("link", "slug")


@register("slug_filter", ids="F11",
          sql=lambda: with_views(["v_search_hits"], "SELECT link, base FROM (" + HB + ") h WHERE slug IS NOT NULL"))
def slug_filter(spark, sf):
    return D.with_slug(_hits(spark, sf)).where(F.col("slug").isNotNull()).select("link", "base")


@register("search_yield", ids="W11 S5", sql=_yield_sql)
def search_yield(spark, sf):
    return D.search_yield(_hits(spark, sf), N_QUERIES)


@register("discovered_total", ids="A18 U4",
          sql=lambda: with_views(["v_search_hits"], "SELECT platform, count(DISTINCT base) AS discovered FROM (" + HB + ") h WHERE base IS NOT NULL GROUP BY platform"))
def discovered_total(spark, sf):
    h = D.with_slug(_hits(spark, sf)).where(F.col("base").isNotNull())
    return h.select("platform", "base").distinct().groupBy("platform").agg(F.count(F.lit(1)).alias("discovered"))


@register("distinct_boards", ids="U4",
          sql=lambda: with_views(["v_search_hits"], "SELECT DISTINCT platform, base FROM (" + HB + ") h WHERE base IS NOT NULL"))
def distinct_boards(spark, sf):
    return D.with_slug(_hits(spark, sf)).where(F.col("base").isNotNull()).select("platform", "base").distinct()


@register("new_boards", ids="J5 S6",
          sql=lambda: with_views(["v_search_hits"], "SELECT DISTINCT platform, base FROM (" + HB + ") h WHERE base IS NOT NULL "
                                 "EXCEPT SELECT platform, base FROM (" + HB + ") k WHERE base IS NOT NULL AND pos = 0"))
def new_boards(spark, sf):
    h = D.with_slug(_hits(spark, sf)).where(F.col("base").isNotNull())
    known = h.where(F.col("pos") == 0)
    return D.new_boards(h, known)


@register("sorted_boards", ids="T15",
          sql=lambda: with_views(["v_search_hits"], "SELECT DISTINCT slug FROM (" + HB + ") h WHERE slug IS NOT NULL ORDER BY slug"))
def sorted_boards(spark, sf):
    return D.with_slug(_hits(spark, sf)).where(F.col("slug").isNotNull()).select("slug").distinct().orderBy("slug")


# --- board-list source ----------------------------------------------------------------

LINE_SQL = ("SELECT page_id AS pos, CASE WHEN page_id % 11 = 0 THEN '' WHEN page_id % 5 = 0 THEN '# ' || url "
            "WHEN page_id % 4 = 1 THEN '  ' || url || ' # added' WHEN page_id % 7 = 3 THEN regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) "
            "ELSE url END AS line FROM pages")


def board_file_lines(spark, sf):
    """Board-list lines derived from the pages table (URLs, bare slugs, comments, blanks)."""
    p = table(spark, sf, "pages").select("page_id", "url")
    line = (F.when(F.col("page_id") % 11 == 0, F.lit("")).when(F.col("page_id") % 5 == 0, F.concat(F.lit("# "), F.col("url")))
            .when(F.col("page_id") % 4 == 1, F.concat(F.lit("  "), F.col("url"), F.lit(" # added")))
            .when(F.col("page_id") % 7 == 3, F.regexp_extract("url", "^[a-z]+://[^/]*/([^/?#]*)", 1))
            .otherwise(F.col("url")))
    return p.select(F.col("page_id").alias("pos"), line.alias("line"))


_KEPT = ("SELECT pos, raw FROM (SELECT pos, " + X.sql.strip_ws("split_part(raw0, '#', 1)") + " AS raw FROM (SELECT pos, "
         + X.sql.strip_ws("coalesce(line, '')") + " AS raw0 FROM lines) a WHERE raw0 <> '' AND NOT starts_with(raw0, '#')) b WHERE raw <> ''")


def _list_sql(slug_expr: str, limit: int = 0) -> str:
    body = (f"SELECT provider, slug, min(pos) AS pos FROM (SELECT '{{p}}' AS provider, pos, {slug_expr} AS slug FROM kept) s "
            "WHERE slug IS NOT NULL GROUP BY provider, slug")
    return body


@register("board_line_filter", ids="F12",
          sql=lambda: with_views([], "SELECT * FROM kept", [("lines", LINE_SQL), ("kept", _KEPT)]))
def board_line_filter(spark, sf):
    return D.board_lines(board_file_lines(spark, sf))


@register("slugify_board", ids="X9",
          sql=lambda: with_views([], f"SELECT pos, raw, {X.sql.slugify_ashby('raw')} AS slug FROM kept", [("lines", LINE_SQL), ("kept", _KEPT)]))
def slugify_board(spark, sf):
    return D.board_lines(board_file_lines(spark, sf)).select("pos", "raw", X.slugify_ashby(F.col("raw")).alias("slug"))


@register("greenhouse_slug", ids="X10",
          sql=lambda: with_views([], f"SELECT pos, raw, {X.sql.greenhouse_slug('raw')} AS slug FROM kept", [("lines", LINE_SQL), ("kept", _KEPT)]))
def greenhouse_slug(spark, sf):
    return D.board_lines(board_file_lines(spark, sf)).select("pos", "raw", X.greenhouse_slug(F.col("raw")).alias("slug"))


@register("lever_slug", ids="X11",
          sql=lambda: with_views([], f"SELECT pos, raw, {X.sql.lever_slug('raw')} AS slug FROM kept", [("lines", LINE_SQL), ("kept", _KEPT)]))
def lever_slug(spark, sf):
    return D.board_lines(board_file_lines(spark, sf)).select("pos", "raw", X.lever_slug(F.col("raw")).alias("slug"))


def _board_list_sql(limit: int = 0) -> str:
    ash = f"CASE WHEN {X.sql.slugify_ashby('raw')} <> '' THEN {X.sql.slugify_ashby('raw')} END"
    parts = [f"SELECT '{p}' AS provider, pos, {e} AS slug FROM kept" for p, e in
             (("ashby", ash), ("greenhouse", X.sql.greenhouse_slug("raw")), ("lever", X.sql.lever_slug("raw")))]
    body = "SELECT provider, slug, min(pos) AS pos FROM (" + " UNION ALL ".join(parts) + ") s WHERE slug IS NOT NULL GROUP BY provider, slug"
    if limit:
        body = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY pos) AS rn FROM ({body}) b) x WHERE rn <= {limit}"
        body = f"SELECT provider, slug, pos FROM ({body}) y"
    return with_views([], body, [("lines", LINE_SQL), ("kept", _KEPT)])


@register("src_board_list", ids="S4 W8 F12 X9-X11", sql=lambda: _board_list_sql())
def src_board_list(spark, sf):
    lines = board_file_lines(spark, sf)
    out = D.board_list(lines, "ashby")
    for p in ("greenhouse", "lever"):
        out = out.unionByName(D.board_list(lines, p))
    return out


@register("board_limit", ids="T14", sql=lambda: _board_list_sql(10))
def board_limit(spark, sf):
    lines = board_file_lines(spark, sf)
    out = D.board_list(lines, "ashby", 10)
    for p in ("greenhouse", "lever"):
        out = out.unionByName(D.board_list(lines, p, 10))
    return out


@register("known_boards", ids="S6 J5",
          sql=lambda: with_views(["v_search_hits"], "SELECT DISTINCT platform, base FROM (" + HB + ") h WHERE base IS NOT NULL"))
def known_boards(spark, sf):
    """Two harvests append what the known-board table lacks; the table is read back after both."""
    path = f"{state_root(spark)}/known-boards-{uuid.uuid4().hex}"
    hits = D.with_slug(_hits(spark, sf)).where(F.col("base").isNotNull())
    for harvest in (hits.where(F.col("pos") == 0), hits):
        D.append_boards(D.new_boards(harvest, D.read_known_boards(spark, path)), path)
    return D.read_known_boards(spark, path)
