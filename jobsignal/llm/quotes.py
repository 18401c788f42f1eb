"""Operator 7: quotation linking of conversations, in DataFrame functions only.

Lines that begin with quote marks (``>`` once per level, spaces between allowed)
are quoted, the others are the message's own.  Runs of lines of one level are
passages; quoted ones are normalised (case and white space) and hashed, as are
the own texts of all messages: whole, by passage and by line.  A quoted passage is
linked to the latest earlier message of its conversation whose hashes hold the
whole passage, or else its longest line.  A message's parent is the source of its
first linked passage of the lowest level (what it answers directly), a deeper
level being what the parent itself quoted.  Threads are the trees of parents, and
``reply_order`` counts the messages of a conversation thread by thread, each in
order of turns, so that an answer follows what it quotes; ``text`` has no quotes.

No conversation, thread or message text is gathered in one task: the latest
earlier message is found in two levels (blocks of turns, then turns inside), the
order by counts per block, roots of threads by doubling.

Defined cases: null text -> null own text, no passages; a message of quotes only
keeps an empty text; quotes of nothing known link to nothing; rows of one turn
share its links and its place, which counts them all; rows without conversation or turn are
no link's end (parent null, reply_order null); other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobsignal.llm.common import Tables

#: Turns of one block of the two-level searches and counts.
BLOCK = 1024
MARKS = r"^\s{0,3}(>[> ]*)"


def _normal(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """Runs of lines of one level, an empty line ending one: conv, turn, h, level, first (line), says, lines (array).

    Works inside each message's own line array (its lines are one row), by a fold
    that keeps the open run apart, so every step is linear in the message.
    """
    line = F.transform(F.split("body", "\n", -1), lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("says")))
    step = messages.withColumn("q", line)
    step = step.withColumn("n", F.size("q")).withColumn("before", F.concat(F.array(F.struct(F.lit(-1).alias("level"), F.lit("").alias("says"))), F.col("q")))
    pair = F.arrays_zip(F.col("q").alias("this"), F.slice("before", 1, F.col("n")).alias("last"))
    starts = F.filter(F.transform(pair, lambda p, i: F.when((p["this"]["level"] != p["last"]["level"]) | ((F.trim(p["last"]["says"]) == "") & (F.trim(p["this"]["says"]) != "")), i)), lambda x: x.isNotNull())
    step = step.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size("q")))
    step = step.select("conv", "turn", "h", "q", F.inline(F.arrays_zip(F.col("starts").alias("first"), ends.alias("end"))))
    says = F.slice("q", F.col("first") + 1, F.col("end") - F.col("first"))
    return (step.withColumn("run", says).select("conv", "turn", "h", "first", F.col("run")[0]["level"].alias("level"), F.transform("run", lambda x: x["says"]).alias("lines"))
            .withColumn("says", F.array_join("lines", "\n")).where(F.trim("says") != ""))


def own_text(body: Column) -> Column:
    """The text without quoted lines."""
    kept = F.filter(F.split(body, "\n", -1), lambda x: ~x.rlike(MARKS))
    return F.when(body.rlike(r"(?m)" + MARKS), F.trim(F.array_join(kept, "\n"))).otherwise(body)


def _latest_before(asked: DataFrame, known: DataFrame) -> DataFrame:
    """For each (conv, hash, turn) asked, the latest known turn before it.

    Groups may be as large as a conversation, so turns are dealt into blocks: the
    latest inside the block, or else the latest of the blocks before.
    """
    both = (asked.select("conv", "hash", "turn", F.lit(True).alias("ask")).distinct()
            .union(known.select("conv", "hash", "turn", F.lit(False)).distinct()).withColumn("block", F.floor(F.col("turn") / BLOCK)))
    source = F.when(~F.col("ask"), F.col("turn"))
    inside = Window.partitionBy("conv", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.max(source).over(inside)).where("ask")
    ends = both.groupBy("conv", "hash", "block").agg(F.max(source).alias("last"))
    carried = Window.partitionBy("conv", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    far = ends.withColumn("far", F.max("last").over(carried)).select("conv", "hash", "block", "far")
    return (near.join(far, ["conv", "hash", "block"]).select("conv", "hash", "turn", F.coalesce("near", "far").alias("source")).where("source is not null"))


def parents(messages: DataFrame) -> DataFrame:
    """(conv, turn, parent, quotes): the message each message answers, and its linked passages (level, source)."""
    runs = passages(messages)
    quoted = runs.where("level > 0").withColumn("hash", F.xxhash64(_normal(F.col("says"))))
    longest = F.array_max(F.transform("lines", lambda x: F.struct(F.length(_normal(x)).alias("n"), _normal(x).alias("x"))))["x"]
    quoted = quoted.withColumn("line", F.xxhash64(longest, F.lit("line"))).select("conv", "turn", "first", "level", "hash", "line")
    own = runs.where("level = 0")
    whole = messages.select("conv", "turn", F.xxhash64(_normal(own_text(F.col("body")))).alias("hash"))
    part = own.select("conv", "turn", F.xxhash64(_normal(F.col("says"))).alias("hash"))
    line = own.select("conv", "turn", F.explode("lines").alias("x")).select("conv", "turn", F.xxhash64(_normal(F.col("x")), F.lit("line")).alias("hash"))
    known = whole.union(part).union(line)
    asked = quoted.select("conv", "turn", "hash").union(quoted.select("conv", "turn", F.col("line")))
    found = _latest_before(asked, known)
    by_line = found.select("conv", "turn", F.col("hash").alias("line"), F.col("source").alias("line_source"))
    linked = (quoted.join(found, ["conv", "turn", "hash"], "left").join(by_line, ["conv", "turn", "line"], "left")
              .withColumn("source", F.coalesce("source", "line_source")).where("source is not null"))
    return linked.groupBy("conv", "turn").agg(F.min_by("source", F.col("level") * (1 << 32) + F.col("first")).alias("parent"), F.count(F.lit(1)).alias("n_links"))


def _roots(tables: Tables, nodes: DataFrame) -> DataFrame:
    """(conv, turn, root) by doubling: each round follows the pointer of the pointer."""
    at = tables.save(nodes.select("conv", "turn", F.coalesce("parent", "turn").alias("root")))
    while True:
        up = at.select("conv", F.col("turn").alias("root"), F.col("root").alias("further"))
        new = tables.save(at.join(up, ["conv", "root"], "left").select("conv", "turn", F.col("root").alias("old"), F.coalesce("further", "root").alias("root")))
        moved = new.where("old <> root").limit(1).count()
        tables.drop(at)
        at = new
        if not moved:
            return at.select("conv", "turn", "root")


def conversations(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Per row of ``table``: its columns (text without quotes), parent_turn, thread, n_quotes, n_linked and reply_order."""
    tables = Tables(spark, "quotes")
    added = ("parent_turn", "thread", "n_quotes", "n_linked", "reply_order")
    keep = [c for c in table.columns if c not in added]
    rows = table.select(*keep).withColumn("_q_h", F.xxhash64("text"))
    messages = (rows.where("conv_id is not null and turn is not null and text is not null")
                .select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("_q_h").alias("h"), F.col("text").cast("string").alias("body")).distinct())
    messages = tables.save(messages)
    links = tables.save(parents(messages))
    places = tables.save(rows.where("conv_id is not null and turn is not null").groupBy(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn")).agg(F.count(F.lit(1)).alias("copies")))
    quoted = passages(messages).where("level > 0").groupBy("conv", "turn", "h").agg(F.count(F.lit(1)).alias("n_quotes"))
    roots = _roots(tables, places.join(links, ["conv", "turn"], "left"))
    # a message's place: messages of threads that begin earlier, then of its thread's earlier turns;
    # both are sums over blocks, then inside the block
    spot = places.join(roots, ["conv", "turn"]).withColumn("rb", F.floor(F.col("root") / BLOCK)).withColumn("tb", F.floor(F.col("turn") / BLOCK))
    count = spot.groupBy("conv", "rb", "root", "tb").agg(F.sum("copies").alias("n"))
    thread = count.groupBy("conv", "rb", "root").agg(F.sum("n").alias("n"))
    block = thread.groupBy("conv", "rb").agg(F.sum("n").alias("n"))
    before = Window.unboundedPreceding, -1
    block = block.select("conv", "rb", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("rb").rowsBetween(*before)), F.lit(0)).alias("b0"))
    thread = thread.select("conv", "rb", "root", F.coalesce(F.sum("n").over(Window.partitionBy("conv", "rb").orderBy("root").rowsBetween(*before)), F.lit(0)).alias("b1"))
    count = count.select("conv", "rb", "root", "tb", F.coalesce(F.sum("n").over(Window.partitionBy("conv", "root").orderBy("tb").rowsBetween(*before)), F.lit(0)).alias("b2"))
    inside = F.coalesce(F.sum("copies").over(Window.partitionBy("conv", "root", "tb").orderBy("turn").rowsBetween(*before)), F.lit(0))
    order = (spot.withColumn("b3", inside).join(count, ["conv", "rb", "root", "tb"]).join(thread, ["conv", "rb", "root"]).join(block, ["conv", "rb"])
             .select("conv", "turn", F.col("root").alias("thread"), (F.col("b0") + F.col("b1") + F.col("b2") + F.col("b3")).alias("place")))
    facts = order.join(links, ["conv", "turn"], "left")
    facts = tables.save(facts.select(F.col("conv").alias("_q_conv"), F.col("turn").alias("_q_turn"), "thread", "place", F.col("parent").alias("parent_turn"), F.coalesce("n_links", F.lit(0)).alias("n_linked")))
    quoted = quoted.select(F.col("conv").alias("_q_conv2"), F.col("turn").alias("_q_turn2"), F.col("h").alias("_q_h2"), "n_quotes")
    out = (rows.join(facts, (F.col("conv_id") == F.col("_q_conv")) & (F.col("turn").cast("long") == F.col("_q_turn")), "left")
           .join(quoted, (F.col("conv_id") == F.col("_q_conv2")) & (F.col("turn").cast("long") == F.col("_q_turn2")) & (F.col("_q_h") == F.col("_q_h2")), "left"))
    columns = [own_text(F.col("text")).alias("text") if c == "text" else F.col(c) for c in keep]
    return out.select(*columns, "parent_turn", "thread", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("place").alias("reply_order"))
