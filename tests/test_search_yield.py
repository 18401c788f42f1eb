"""W11 against a direct simulation of the harvesting loop on random fixtures."""

import random

from jobsignal import rules as R
from jobsignal.operators import discover as D


def simulate(hits, n_queries):
    """The loop as specified: per platform a seen-set; per query pages 0,10,...
    until an empty page, start > 900, or 5 pages in a row without a new board."""
    out = []
    for platform in sorted({h[0] for h in hits}):
        seen, total = set(), 0
        for q in range(n_queries):
            start, streak = 0, 0
            while start <= R.SEARCH_MAX_START and streak < R.SEARCH_EMPTY_STREAK:
                page = sorted((h for h in hits if h[0] == platform and h[1] == q and h[2] == start), key=lambda h: h[3])
                if not page:
                    break
                new = 0
                for h in page:
                    slug = h[4].split("/")[3] if h[4].count("/") >= 3 else ""
                    if not slug or slug.lower() in R.RESERVED_SLUGS:
                        continue
                    base = f"https://{platform}/{slug}"
                    if base not in seen:
                        seen.add(base)
                        new += 1
                total += new
                streak = 0 if new else streak + 1
                out.append((platform, q, start, new, total))
                start += 10
    return sorted(out)


def test_search_yield_matches_simulation(spark):
    rnd = random.Random(7)
    hits = []
    for platform in ("a.example.com", "b.example.com"):
        for q in range(3):
            n_pages = rnd.randint(3, 14)
            for page in range(n_pages):
                if rnd.random() < 0.08:
                    continue  # an empty page ends the query
                for pos in range(rnd.randint(1, 10)):
                    slug = rnd.choice(["jobs", "x1", "x2", "x3"] + [f"s{rnd.randint(0, 40)}" for _ in range(2)])
                    hits.append((platform, q, page * 10, pos, f"https://{platform}/{slug}/p"))
    df = spark.createDataFrame(hits, "platform string, query_idx long, start long, pos long, link string")
    got = sorted(tuple(r) for r in D.search_yield(df, 3).select(
        "platform", "query_idx", "start", "new_boards", "discovered_total").collect())
    assert got == simulate(hits, 3)
