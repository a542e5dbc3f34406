"""Quotation linking: conversations in reply order, without quotes.

A line's quote level is the number of `>` marks before its text.  Own text has level 0.  Runs of lines of one
level form passages, which blank lines divide; a passage and each of its lines are units, hashed after lower
case and single blanks.  A quoted unit is linked to the latest earlier message of its conversation that holds
the unit in its own text.  A message replies to the message that its shallowest linked level quotes most
characters of, the latest one among equals.  A line like `On 3 May, Ann wrote:` before a quote goes with it.

Reply order: by the turn of the thread's first message, then the depth in the thread, then the turn; so each
reply follows what it answers, and messages that quote nothing keep their turns.

Hot keys: a hot line of a hot conversation is looked up in buckets of BUCKET turns, each with one latest
holder, so no task sees all its occurrences.  Thread roots come from pointer doubling, the places in the
conversation from a range-partitioned sort.

Null texts are empty.  Null conversations or turns are never linked.  Messages that share conversation and
turn share their links.  A message of quotes alone has an empty body.  Repeated rows stay.  An empty table
gives an empty result.  Clashing columns give way to the operator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.ranks import rank_within
from .common import written

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
WROTE = r"(?i)^on\s.{1,300}\swrote:\s*$"
BUCKET = 256
OURS = ("body", "n_passages", "n_linked", "parent_turn", "root_turn", "depth", "position")
MOST_ROUNDS = 60


def _lines(text: Column) -> Column:
    """Lines as (level, text)."""
    def one(line):
        marks = F.regexp_extract(line, MARKS, 1)
        return F.struct((F.length(marks) - F.length(F.replace(marks, F.lit(">")))).alias("level"), F.regexp_replace(line, MARKS, "").alias("line"))

    bare = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), one)
    # the line that introduces a quote has its level
    def led(x, i):
        after = F.try_element_at(bare, i + 2)
        return F.when((x["level"] == 0) & x["line"].rlike(WROTE) & (after["level"] > 0), F.struct(F.lit(-1).alias("level"), x["line"].alias("line"))).otherwise(x)

    return F.transform(bare, led)


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _passages(lines: Column) -> Column:
    """Passages as (level, lines): runs of one level, divided by blank lines."""
    start = F.array().cast("array<struct<level:int,open:boolean,lines:array<string>>>")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        line = _normal(x["line"])
        fresh = F.struct(x["level"].cast("int").alias("level"), (line != "").alias("open"), F.filter(F.array(line), lambda y: y != "").alias("lines"))
        joins = last["open"] & (last["level"] == x["level"]) & (line != "")
        grown = F.struct(last["level"].alias("level"), F.lit(True).alias("open"), F.concat(last["lines"], F.array(line)).alias("lines"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    return F.filter(F.aggregate(lines, start, step), lambda p: (F.size(p["lines"]) > 0) & (p["level"] >= 0))


def _units(parsed: DataFrame, quoted: bool) -> DataFrame:
    """(conv, turn, level, unit, size): passages and lines of quoted or own text."""
    level = F.col("p.level")
    p = parsed.select("conv", "turn", F.explode("passages").alias("p")).where(level > 0 if quoted else level == 0)
    whole = F.array_join("p.lines", " ")
    texts = F.array_distinct(F.concat(F.array(whole), F.col("p.lines")))
    u = p.select("conv", "turn", level.alias("level"), F.explode(texts).alias("t"))
    return u.select("conv", "turn", "level", F.xxhash64("t").alias("unit"), F.length("t").alias("size")).where("conv IS NOT NULL AND turn IS NOT NULL")


def links(parsed: DataFrame) -> DataFrame:
    """(conv, turn, level, source, size): quoted units and the latest earlier message with them."""
    quoted = written(_units(parsed, True), "quoted")
    keys = quoted.select("conv", "unit").distinct()
    own = _units(parsed, False).select("conv", "turn", "unit").distinct().join(keys, ["conv", "unit"], "left_semi")
    own = written(own.withColumn("bucket", F.floor(F.col("turn") / BUCKET)), "sources")
    tops = own.groupBy("conv", "unit", "bucket").agg(F.max("turn").alias("top"))
    asked = quoted.withColumn("bucket", F.floor(F.col("turn") / BUCKET))
    # the same bucket
    near = own.select("conv", "unit", "bucket", "turn", F.col("turn").alias("source"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("size"))
    both = near.unionByName(asked.withColumn("source", F.lit(None).cast("long")))
    earlier = W.partitionBy("conv", "unit", "bucket").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    here = both.withColumn("found", F.max("source").over(earlier)).where("level IS NOT NULL")
    # earlier buckets: one row each
    marks = tops.unionByName(asked.select("conv", "unit", "bucket").distinct(), allowMissingColumns=True).groupBy("conv", "unit", "bucket").agg(F.max("top").alias("top"))
    past = marks.withColumn("past", F.max("top").over(W.partitionBy("conv", "unit").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    joined = here.join(past.select("conv", "unit", "bucket", "past"), ["conv", "unit", "bucket"], "left")
    return joined.select("conv", "turn", "level", F.coalesce("found", "past").alias("source"), "size").where("source IS NOT NULL")


def parents(linked: DataFrame) -> DataFrame:
    """(conv, turn, parent, n_linked)."""
    weights = linked.groupBy("conv", "turn", "level", "source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("c"))
    best = F.max(F.struct((-F.col("level")).alias("l"), "size", "source"))
    return weights.groupBy("conv", "turn").agg(best.alias("b"), F.sum("c").alias("n_linked")).select("conv", "turn", F.col("b.source").alias("parent"), "n_linked")


def threads(parent: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) by pointer doubling; parents have smaller turns, so there are no circles."""
    now = written(parent.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(MOST_ROUNDS):
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("higher"), F.col("depth").alias("more"))
        both = now.join(up, ["conv", "root"], "left")
        step = written(both.select("conv", "turn", F.coalesce("higher", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("higher").isNotNull().alias("moved")), "threads")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now
    raise RuntimeError("a thread did not come to its root")


def reply_order(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """messages without text, with OURS: the body without quotes, the reply tree and the place in the conversation."""
    others = [c for c in messages.columns if c.lower() not in OURS and c != text]
    lines = _lines(F.col(f"`{text}`"))
    keyed = messages.select(F.col(f"`{conversation}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("own"), lines.alias("lines"))
    parsed = keyed.select("conv", "turn", _passages(F.col("lines")).alias("passages"))
    parent = written(parents(links(parsed)), "parents")
    tree = threads(parent)
    body = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    n_passages = F.size(F.filter(_passages(F.col("lines")), lambda p: p["level"] > 0))
    mine = keyed.select("conv", "turn", "own", F.btrim(body, F.lit(" \t\r\n")).alias("body"), n_passages.cast("long").alias("n_passages"))
    full = mine.join(parent, ["conv", "turn"], "left").join(tree, ["conv", "turn"], "left").select(
        "conv", "turn", "own", "body", "n_passages", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    tie = F.xxhash64("own", "body")
    placed = rank_within(full, ["conv"], [F.col("root_turn").asc_nulls_first(), F.col("depth"), F.col("turn").asc_nulls_first(), tie], "position")
    return placed.select(*[F.col("own").getField(c).alias(c) for c in others], *OURS)
