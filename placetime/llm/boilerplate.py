"""Line dedup by site-relative frequency.

A line, trimmed, is boilerplate of a host when more than `max_percent` of the host's pages, and at least
`min_pages`, hold it.  All its occurrences on that host are dropped; blank lines and order stay.

Lines travel as two hashes, counted once a page and added up before the shuffle.  Only a host's boilerplate
lines meet its pages again: they number at most (lines a page) * 100 / max_percent.  Pages of a host are
spread over SALTS groups for that join, so a host with a third of all pages is not one task.

A null host is the unnamed host.  Null texts stay null, empty texts empty; a text of boilerplate only becomes
empty.  Repeated rows are pages of their own.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, free_name, only

MAX_PERCENT, MIN_PAGES, SALTS = 10, 5, 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    """96 bits of a trimmed line."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b"))


def _is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) == ""


def boilerplate(pages: DataFrame, host: str = "source", *, max_percent: int = MAX_PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, pages, total): lines above the ratio."""
    name = F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host")
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_is_blank(x)), _key))
    seen = pages.select(name, F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("pages"))
    totals = pages.select(name).groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    return seen.where(F.col("pages") >= min_pages).join(totals, "host").where(100 * F.col("pages") > max_percent * F.col("total"))


def drop_lines(pages: DataFrame, host: str = "source", **settings) -> DataFrame:
    """pages without boilerplate lines, with n_lines (not blank, before) and n_dropped."""
    salt, drop, lines, site = (free_name(pages, x) for x in ("_salt", "_drop", "_lines", "_host"))
    hosts = boilerplate(pages, host, **settings).groupBy("host").agg(F.collect_set("key").alias(drop))
    hosts = hosts.select(F.col("host").alias(site), drop, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    others = [c for c in pages.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    keyed = only(pages, [*others, "text"]).withColumns({
        site: F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")), salt: F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"),
    })
    joined = keyed.join(hosts, [site, salt], "left").withColumn(lines, _lines(F.col("text")))
    held = F.when(F.col(drop).isNull(), F.col(lines)).otherwise(
        F.filter(F.col(lines), lambda x: _is_blank(x) | ~F.array_contains(F.col(drop), _key(x)))
    )
    count = F.size(F.filter(F.col(lines), lambda x: ~_is_blank(x)))
    return joined.select(
        *[F.col(f"`{c}`") for c in others], count.cast("long").alias("n_lines"), (F.size(lines) - F.size(held)).cast("long").alias("n_dropped"),
        F.when(F.col("text").isNotNull(), F.array_join(held, "\n")).alias("text"),
    )


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT *, list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS bare FROM d),
seen AS (SELECT host, line, count(*) AS pages FROM (SELECT host, unnest(list_distinct(list_filter(bare, lambda x: x <> ''))) AS line FROM k) GROUP BY host, line),
total AS (SELECT host, count(*) AS total FROM d GROUP BY host),
bad AS (SELECT host, list(line) AS lines FROM seen JOIN total USING (host) WHERE pages >= {MIN_PAGES} AND 100 * pages > {MAX_PERCENT} * total GROUP BY host),
kept AS (SELECT k.*, CASE WHEN bad.lines IS NULL THEN k.lines ELSE list_filter(k.lines, lambda x: NOT list_contains(bad.lines, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) END AS held
  FROM k LEFT JOIN bad USING (host))
SELECT doc_id, host AS source, CAST(len(list_filter(bare, lambda x: x <> '')) AS BIGINT) AS n_lines, CAST(len(lines) - len(held) AS BIGINT) AS n_dropped,
  CASE WHEN text IS NOT NULL THEN array_to_string(held, chr(10)) END AS text FROM kept
"""
