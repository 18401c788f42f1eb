"""Board discovery.

Search pages are few per (run, platform, query) — at most 91 pages of 10 links —
so the windows of the yield rule are bounded, and harvest runs are dealt over tasks;
everything else is per-row projection, ``distinct`` or an anti join on ``(platform, base)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsignal import rules as R
from jobsignal.functions import text as X


def with_slug(hits: DataFrame) -> DataFrame:
    """Slug and board base URL of each search link (null when rejected)."""
    slug = X.extract_slug(F.col("link"), F.col("platform"))
    out = hits.withColumn("slug", slug)
    return out.withColumn("base", F.when(F.col("slug").isNotNull(),
                                         F.concat(F.lit("https://"), F.col("platform"), F.lit("/"), F.col("slug"))))


def search_yield(hits: DataFrame, n_queries: int, existing: DataFrame | None = None,
                 max_start: int = R.SEARCH_MAX_START, streak: int = R.SEARCH_EMPTY_STREAK) -> DataFrame:
    """Pages that the harvesting loop would read, per run, platform and query, with the
    number of new boards each page yields and the running total.

    Per query: pages run from start 0 in steps of 10 and stop at the first missing
    (empty) page, after ``start > max_start``, or after ``streak`` pages in a row
    without a new board.  The seen-set is per run and platform, starts with ``existing``
    and carries across queries; pages that are never read contribute nothing.  All runs
    step through a query together, so the plan grows with the queries of a run and not
    with the runs.  Hits without a ``run`` column are one run.
    """
    by = ["run", "platform"] if "run" in hits.columns else ["platform"]
    hb = with_slug(hits).where(F.col("start") <= max_start)
    # Pages read before the first missing (empty) page, for every query at once.
    pw = Window.partitionBy(*by, "query_idx").orderBy("start")
    cand_all = (hb.select(*by, "query_idx", "start").distinct()
                .withColumn("_rn", F.row_number().over(pw)).where(F.col("start") == (F.col("_rn") - 1) * 10))
    links_all = hb.where(F.col("base").isNotNull()).join(cand_all.select(*by, "query_idx", "start"), [*by, "query_idx", "start"], "left_semi")
    if existing is not None:
        links_all = links_all.join(existing.select("platform", "base"), ["platform", "base"], "left_anti")
    seen = None
    accepted_parts = []
    for q in range(n_queries):
        cand = cand_all.where(F.col("query_idx") == q).select(*by, "start", "_rn")
        links = links_all.where(F.col("query_idx") == q)
        if seen is not None:
            links = links.join(seen, [*by, "base"], "left_anti")
        firsts = links.groupBy(*by, "base").agg(F.min("start").alias("start"))
        per_page = cand.join(firsts.groupBy(*by, "start").agg(F.count(F.lit(1)).alias("new_boards")),
                             [*by, "start"], "left").fillna(0, ["new_boards"])
        # streak of pages without a new board = pages since the last productive one
        w = Window.partitionBy(*by).orderBy("start")
        last_hit = F.last(F.when(F.col("new_boards") > 0, F.col("_rn")), ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        per_page = per_page.withColumn("_streak", F.col("_rn") - F.coalesce(last_hit, F.lit(0)))
        stop = F.min(F.when(F.col("_streak") >= streak, F.col("start"))).over(Window.partitionBy(*by))
        acc = per_page.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("start") <= F.col("_stop")))
        acc = acc.select(*by, F.lit(q).alias("query_idx"), "start", F.col("new_boards").cast("long").alias("new_boards"))
        accepted_parts.append(acc)
        new_bases = firsts.join(acc.select(*by, "start"), [*by, "start"], "left_semi").select(*by, "base")
        seen = new_bases if seen is None else seen.unionByName(new_bases)
    out = accepted_parts[0]
    for p in accepted_parts[1:]:
        out = out.unionByName(p)
    tw = Window.partitionBy(*by).orderBy("query_idx", "start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("discovered_total", F.sum("new_boards").over(tw))
    if existing is None:
        return out
    # the running total starts from the boards already known
    known = existing.select("platform", "base").distinct().groupBy("platform").agg(F.count(F.lit(1)).alias("_known"))
    return (out.join(known, "platform", "left")
            .withColumn("discovered_total", F.col("discovered_total") + F.coalesce("_known", F.lit(0))).drop("_known"))


def new_boards(found: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct discovered boards not already known."""
    return found.select("platform", "base").distinct().join(known.select("platform", "base"), ["platform", "base"], "left_anti")


# --- board-list source (S4) -------------------------------------------------------


def board_lines(lines: DataFrame) -> DataFrame:
    """strip, drop blank and comment lines, cut inline comments.  Keeps ``pos``."""
    raw = X.strip_ws(F.coalesce(F.col("line"), F.lit("")))
    kept = lines.select("pos", raw.alias("raw")).where((F.col("raw") != "") & ~F.col("raw").startswith("#"))
    cut = X.strip_ws(F.split(F.col("raw"), "#", 2)[0])
    return kept.select("pos", cut.alias("raw")).where(F.col("raw") != "")


def board_slug(provider: str, raw: Column) -> Column:
    """X9/X10/X11 by provider; null marks an invalid line."""
    if provider == "ashby":
        s = X.slugify_ashby(raw)
        return F.when(s != "", s)
    if provider == "greenhouse":
        return X.greenhouse_slug(raw)
    return X.lever_slug(raw)


def board_list(lines: DataFrame, provider: str, limit: int = 0) -> DataFrame:
    """S4 + W8 (+T14): valid slugs, first occurrence kept, file order; ``limit`` 0 = all."""
    b = board_lines(lines).select("pos", board_slug(provider, F.col("raw")).alias("slug")).where(F.col("slug").isNotNull())
    first = b.groupBy("slug").agg(F.min("pos").alias("pos"))
    if limit > 0:
        first = first.orderBy("pos").limit(limit)
    return first.select(F.lit(provider).alias("provider"), "slug", "pos")


def read_board_file(spark, path: str) -> DataFrame:
    """S4 from text: one line per row with its position in the file (a board list is one
    small hand-kept file, so it is read as one value)."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n", -1)).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def append_boards(new: DataFrame, path: str) -> None:
    """S6 sink: add newly discovered boards to the known-board table (append only)."""
    new.select("platform", "base").write.mode("append").parquet(path)


def read_known_boards(spark, path: str) -> DataFrame:
    """S6 source: known boards (empty when the table does not exist yet)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "platform string, base string")
    return spark.read.parquet(path).select("platform", "base")
