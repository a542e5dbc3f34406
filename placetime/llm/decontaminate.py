"""Benchmark decontamination by SimHash of item-sized windows.

Texts and items become lower-case words without punctuation and then hashed shingles of SHINGLE words (all
words of an item that has fewer).  A window of a document has as many words as the item; a document shorter
than the item, with at least `percent` of its shingles, is one window as a whole.  Its SimHash weighs each
shingle by how often the window holds it.  The 64 bits are cut into RADIUS + 1 blocks; two fingerprints
within RADIUS bits agree in one block at least, so an equality join on (window size, block, bits) finds all
pairs within the radius, and each pair is kept at its first common block only.  What remains is verified:
sum of the smaller weights over sum of the larger ones must reach `percent`.

Not every window can match: one of m shingles that reaches the similarity s shares at least 2 s m / (1 + s)
positions with the item, the first of them near its start.  So only windows with that many positions that
hold a shingle of an item of their size are formed, which loses none and spares the rest of the corpus.  A whole
text of l shingles needs s (l + m) / (1 + s) of them.

The benchmark is handled in slices whose shingles number BROADCAST_ROWS at most; each slice is broadcast and
one pass over the documents, so a large benchmark means more passes, not a larger broadcast.  Items and
windows are written to the shared folder with their fingerprints, so these are computed once.

Null and blank texts and items match nothing.  Repeated documents are judged one by one, items with one
item_id (or none) and different texts all count, and the best match of any is reported for the item_id; equal
scores go to the earlier window.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import free_name, written

SHINGLE, PERCENT, RADIUS = 5, 80, 19
BROADCAST_ROWS = 500_000
BITS = 64


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(word: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    runs = F.transform(F.sequence(F.lit(1), F.size(word) - (k - 1)), lambda i: F.xxhash64(F.slice(word, i, k)))
    return F.when(F.size(word) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Bit b is set when more than half of the hashes have it; counts of bits j and j + 32 share a long."""
    def count(j):
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(0x100000001)))

    def bits(counts):
        found = []
        for j in range(32):
            for k, n in ((j, counts[j].bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(counts[j], 32))):
                found.append(F.when(2 * n > F.size(hashes), F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
        return reduce(lambda a, b: a.bitwiseOR(b), found)

    return F.transform(F.array(F.array(*[count(j) for j in range(32)])), bits)[0]  # so that counts are taken once


def _masks(radius: int) -> list[int]:
    """One mask a block, as signed longs."""
    ends = [i * BITS // (radius + 1) for i in range(radius + 2)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(ends, ends[1:])]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def blocks(fingerprint: Column, radius: int) -> Column:
    """The fingerprint's bits in each block."""
    return F.array(*[fingerprint.bitwiseAND(F.lit(m)) for m in _masks(radius)])


def first_common_block(a: Column, b: Column, radius: int) -> Column:
    differ = a.bitwiseXOR(b)
    found = F.lit(radius + 1)
    for k, mask in reversed(list(enumerate(_masks(radius)))):
        found = F.when(differ.bitwiseAND(F.lit(mask)) == 0, F.lit(k)).otherwise(found)
    return found


def items_of(benchmark: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(item_id, n, k, hashes, weights, fingerprint) of the items with words."""
    own = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    own = own.withColumns({"n": F.size("w"), "k": F.least(F.size("w"), F.lit(size))})
    one = reduce(lambda a, k: F.when(F.col("k") == k, shingle_hashes(F.col("w"), k)).otherwise(a), range(1, size), shingle_hashes(F.col("w"), size))
    own = own.select("item_id", "n", "k", one.alias("hashes"))
    weights = F.transform(F.array_distinct("hashes"), lambda h: F.struct(h.alias("h"), F.size(F.filter("hashes", lambda x: x == h)).alias("c")))
    return written(own.withColumns({"weights": weights, "fingerprint": simhash(F.col("hashes"))}), "items")


def _windows(docs: DataFrame, items: DataFrame, k: int, percent: int) -> DataFrame:
    """(row, own, start, n, window): every window of an item's size that can reach the similarity; start counts words from 0."""
    sizes = items.select(F.explode("hashes").alias("h"), "n").distinct()
    hashed = docs.select("row", "own", shingle_hashes(F.col("w"), k).alias("hashes"))
    at = hashed.select("row", "own", "hashes", F.posexplode("hashes").alias("p", "h")).join(F.broadcast(sizes), "h")
    m = F.col("n") - (k - 1)
    ahead = F.floor(m * (100 - percent) / (100 + percent)).cast("int")
    first = F.greatest(F.col("p") - ahead, F.lit(0))
    length = F.size("hashes")
    part = F.when(length < m, F.col("hashes")).otherwise(F.slice("hashes", first + 1, F.col("p") - first + m))
    near = at.where(100 * length >= percent * m).select("row", "own", "n", "p", first.alias("first"), m.alias("m"), length.alias("l"), part.alias("part"))
    around = written(near, "hits")  # so that the texts are read once
    along = W.partitionBy("row", "n").orderBy("p")  # one text's own positions
    every = around.withColumns({"before": F.lag("p").over(along), "j": F.row_number().over(along)})
    hits = every.where("l >= m")
    # a window needs this many of its positions among the hits: the last of them must lie inside
    least = F.ceil(F.col("m") * (2 * percent) / (100 + percent)).cast("int")
    ends = hits.select("row", "n", F.col("p").alias("end"), (F.col("j") - least + 1).alias("j"))
    starts = hits.join(ends, ["row", "n", "j"]).withColumn(
        "lo", F.greatest(F.col("first"), F.coalesce("before", F.lit(-1)) + 1, F.col("end") - F.col("m") + 1)
    ).where("lo <= p")
    each = starts.select("row", "own", "n", "first", "m", "part", F.explode(F.sequence("lo", "p")).alias("start"))
    inside = each.where(F.size("part") >= F.col("start") - F.col("first") + F.col("m")).select(
        "row", "own", "start", "n", F.slice("part", F.col("start") - F.col("first") + 1, F.col("m")).alias("window")
    )
    enough = F.ceil((F.col("l") + F.col("m")) * percent / (100 + percent)).cast("int")
    whole = every.where((F.col("l") < F.col("m")) & (F.col("j") == enough)).select("row", "own", F.lit(0).alias("start"), "n", F.col("part").alias("window"))
    return inside.unionByName(whole)


def matches(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], *, size: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """keep columns of docs, item_id, start (word), n_words, similarity, n_windows: the best window of each contaminated row and item."""
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own"), words(F.col("text")).alias("w"),
    )
    items = items_of(benchmark, size)
    facts = items.agg(F.sum(F.size("hashes")).alias("rows"), F.array_sort(F.collect_set("k")).alias("ks")).first()  # at most `size` values
    slices = max(1, -(-(facts.rows or 0) // broadcast_rows))
    found = []
    for k in facts.ks or [size]:
        for s in range(slices):
            own = items.where((F.col("k") == k) & (F.pmod(F.xxhash64("item_id", "hashes"), F.lit(slices)) == s))
            windows = written(_windows(numbered, own, k, percent).withColumn("f", simhash(F.col("window"))), "windows")
            near = windows.select("*", F.posexplode(blocks(F.col("f"), radius)).alias("block", "bits"))
            wanted = own.select("item_id", "n", "weights", "fingerprint", F.posexplode(blocks(F.col("fingerprint"), radius)).alias("block", "bits"))
            pairs = near.join(F.broadcast(wanted), ["n", "block", "bits"]).where(
                (F.bit_count(F.col("f").bitwiseXOR(F.col("fingerprint"))) <= radius) & (first_common_block(F.col("f"), F.col("fingerprint"), radius) == F.col("block"))
            )
            weighed = F.aggregate("weights", F.lit(0), lambda a, e: a + F.least(e["c"], F.size(F.filter("window", lambda x: x == e["h"]))))
            m, length = F.col("n") - (k - 1), F.size("window")  # shingles of the item and of the window
            single = (F.size("weights") == m) | (F.size(F.array_distinct("window")) == F.size("window"))
            both = F.when(single, F.size(F.array_intersect("window", F.transform("weights", lambda e: e["h"])))).otherwise(weighed)
            judged = pairs.select("row", "own", "item_id", "start", (length + (k - 1)).alias("n"), both.alias("both"), (m + length).alias("sum"))
            found.append(judged.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))))
    every = reduce(DataFrame.unionAll, found).withColumn("similarity", F.col("both") / (F.col("sum") - F.col("both")))
    windows = every.groupBy("row", "item_id", "start", "n").agg(F.max("similarity").alias("similarity"), F.first("own").alias("own"))  # texts of one id may share one
    best = windows.groupBy("row", "item_id").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n")).alias("b"), F.first("own").alias("own"), F.count(F.lit(1)).alias("n_windows")
    )
    return best.select(
        *[F.col("own").getField(c).alias(c) for c in keep], "item_id", (-F.col("b.s")).cast("long").alias("start"), F.col("b.n").cast("long").alias("n_words"),
        F.col("b.similarity").alias("similarity"), "n_windows",
    )


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """docs without contaminated rows.  A verdict depends on the text alone, so rows leave by 96 bits of it."""
    a, b, size = (free_name(docs, c) for c in ("_a", "_b", "_size"))
    marked = docs.withColumns({a: F.xxhash64("text"), b: F.hash("text"), size: F.length("text")})
    bad = matches(marked, benchmark, [a, b, size], **settings).select(a, b, size).distinct()
    return marked.join(bad, [a, b, size], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
