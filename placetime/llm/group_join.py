"""N-gram Jaccard join by grouped prefixes.

A document is its set of distinct word shingles, as 64-bit hashes.  Two sets are linked when
100 * intersection >= percent * union.  All shingles have one global order, frequent ones last; linked sets
then share a shingle among the first |x| - ceil(percent * |x| / 100) + 1 of each.

1. Frequent shingles are counted over all documents; the order puts the MOST_FREQUENT of them last.  They
   only set the order: any order gives the same links.
2. Documents with the same prefix and size are one group, and copies with the same set are one member.
   Only groups are indexed by the shingles of their prefix, and only shingles of two groups or more are kept.
3. Stars: each group meets its leader, the group that is first (or last) among the holders of most of its
   shingles, and each member the first of its group.  So a large group of near copies is linked without all
   its pairs.  Linked sets become one component.
4. Chances: groups that share much of their prefix with other components meet one more holder for each
   shingle, chosen by a hash of shingle and group.  These pairs are as many as the index has rows, and leave
   few near copies unlinked.
5. Crowds: unlinked near copies of one text share most of their prefixes, so their pairs are not formed by
   shingles.  Each set of a crowd is turned into its difference D from one set p of it (what only one of the
   two has).  x and y differ exactly where D(x) and D(y) differ, so a link needs
   2 |D(x) & D(y)| >= |D(x)| + |D(y)| - (n + m)(100 - percent) / (100 + percent), and pairs are those that
   share one of the rarest shingles of their differences (see `_prefixes`): edits in common, not text in common.
6. Rest: all pairs of groups of different crowds (most groups are alone) that share a shingle and are not yet
   in one component are counted, and those whose sizes, positions and number of shared prefix shingles allow a
   link are expanded to members and verified.  Crowds meet as wholes first, so no pairs of one crowd are formed.
   So no link between two components is lost, and pairs inside one are never formed.

Verification compares whole sets (48 bits a shingle).  They are computed for members of pairs only, found by
a bit map of at most MAP_BITS bits; a wrong hit there costs time, never a link.  Hot shingles: minima with
map-side partials name the holders; rows meet them in a join that adaptive execution splits.

Null and blank texts have the empty set and link with nothing.  Repeated rows and repeated doc_ids are
members of the same or of different sets like any others; a null doc_id takes part and gets the smallest
doc_id of its component (null if there is none).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name, only, python_ready, written
from .components import components

SHINGLE, PERCENT = 4, 85
MOST_FREQUENT, LEAST_HERE = 200_000, 3
#: Shingles that a task counts at once, and sets that it remembers to skip copies.
CHUNK, REMEMBERED = 4_000_000, 200_000
MAP_BITS = 1 << 27
#: Share of its prefix that a group has in common with a leader, as 1 / LEADER_SHARE.
LEADER_SHARE = 3
#: Groups that hold one open shingle from which on they are a crowd.
CROWD = 32


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z in lower case."""
    words = (text or "").encode("utf-8").lower().split()
    n = len(words)
    if n < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), n)] if n else [], np.uint64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + word[k : n - size + 1 + k]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(29)
    return np.unique(total)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _digest(values: np.ndarray, seed: int = 0) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes(), seed)).view(np.int64))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        yield [c.to_pylist() for c in batch.columns]


def repeated(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that occur `least` times or more, ascending, and their counts.  Sorts values in place; needs little more memory than they have."""
    values.sort()
    n = len(values) - least + 1
    if n <= 0:
        return values[:0], np.zeros(0, np.int64)
    enough = values[:n] == values[least - 1 :]
    enough[1:] &= values[1:n] != values[: n - 1]
    starts = np.flatnonzero(enough)
    found = values[starts]
    return found, np.searchsorted(values, found, "right") - starts


def frequent(docs: DataFrame, size: int, most: int = MOST_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles and their counts, at most `most`; copies inside a task's chunk count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def counted() -> pa.RecordBatch:
            values = np.concatenate(held)
            held.clear()
            values, counts = repeated(values, LEAST_HERE)
            return pa.RecordBatch.from_arrays([pa.array(_signed(values)), pa.array(counts.astype(np.int64))], names=["token", "n"])

        for (texts,) in _texts(batches):
            for text in texts:
                own = shingles(text, size)
                key = _digest(own)
                if not len(own) or key in seen:
                    continue
                seen.add(key)
                held.append(own)
                n += len(own)
                if n >= CHUNK:
                    yield counted()
                    held, n, seen = [], 0, set()
        if held:
            yield counted()

    counts = written(docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")), "frequent")
    level = F.floor(F.log("n") * 32)
    least, kept = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r.level):  # some hundred levels
        kept += r.c
        if kept > most:
            least = r.level + 1
            break
    top = counts.where(level >= least).toPandas()  # at most `most` rows
    order = np.argsort(top["token"].to_numpy(np.int64).view(np.uint64))
    return top["token"].to_numpy(np.int64).view(np.uint64)[order], top["n"].to_numpy(np.int64)[order]


def signatures(docs: DataFrame, size: int, percent: int, most: int) -> DataFrame:
    """(doc_id, text_hash, set_hash, n, group, last, prefix): prefix once a group and task, else null; last is its end in the order of shingles."""
    python_ready(docs.sparkSession)
    last = docs.sparkSession.sparkContext.broadcast(frequent(docs, size, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, counts = last.value
        place = np.empty(len(late), np.int64)
        by_place = late[np.lexsort((late, counts))]
        place[np.lexsort((late, counts))] = np.arange(len(late))
        seen: set[int] = set()
        for keys, texts, marks in _texts(batches):
            rows = []
            for key, text, mark in zip(keys, texts, marks, strict=True):
                own = shingles(text, size)
                n = len(own)
                if not n:
                    rows.append((key, mark, None, 0, None, None, None))
                    continue
                p = prefix_length(n, percent)
                at = np.searchsorted(late, own)
                at[at == len(late)] = 0
                is_late = late[at] == own if len(late) else np.zeros(n, bool)
                prefix = own[~is_late][:p]
                end = int(prefix[-1] >> np.uint64(2)) if len(prefix) else 0
                if len(prefix) < p:
                    where = np.sort(place[at[is_late]])[: p - len(prefix)]
                    end = (1 << 62) + int(where[-1])
                    prefix = np.concatenate([prefix, by_place[where]])
                group = _digest(prefix, n)
                if len(seen) > REMEMBERED:
                    seen.clear()
                rows.append((key, mark, _digest(own), n, group, end, None if group in seen else _signed(prefix)))
                seen.add(group)
            types = [pa.int64()] * 6 + [pa.list_(pa.int64())]
            names = ["doc_id", "text_hash", "set_hash", "n", "group", "last", "prefix"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h")).mapInArrow(
        run, "doc_id long, text_hash long, set_hash long, n long, group long, last long, prefix array<long>"
    )


def bit_map(keys: DataFrame, key: str) -> tuple[int, bytes]:
    """A bit map of hashes with two bits a key: (bits, map).  At most MAP_BITS bits, whatever the number of keys."""
    bits = 1 << 15
    while bits < min(16 * keys.count(), MAP_BITS):
        bits *= 2
    at = keys.select(F.explode(F.array(*(F.expr(f"shiftright(`{key}`, {s}) & {bits - 1}L") for s in (0, 32)))).alias("at"))
    rows = at.groupBy((F.col("at") / 32768).cast("int").alias("chunk")).agg(F.expr("bitmap_construct_agg(cast(at % 32768 as int))").alias("map")).collect()
    whole = bytearray(bits // 8)
    for r in rows:
        whole[r.chunk * 4096 : r.chunk * 4096 + 4096] = r.map
    return bits, bytes(whole)


def in_map(bits: int, whole: bytes, key: int) -> bool:
    return all(whole[at >> 3] >> (at & 7) & 1 for at in ((key & (bits - 1)), ((key >> 32) & (bits - 1))))


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(set_hash, shingles): 48 bits of each shingle of the wanted text hashes, once a set; a few others may be among them; written."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(written(wanted.select("text_hash"), "wanted"), "text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, whole = shared.value
        seen: set[int] = set()
        for texts, marks in _texts(batches):
            rows = []
            for text, mark in zip(texts, marks, strict=True):
                if mark in seen or not in_map(bits, whole, mark):
                    continue
                if len(seen) > REMEMBERED:
                    seen.clear()
                seen.add(mark)
                own = shingles(text, size)
                if len(own):
                    rows.append((_digest(own), np.ascontiguousarray(own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["set_hash", "shingles"])

    found = docs.select("text", F.xxhash64("text").alias("h")).mapInArrow(run, "set_hash long, shingles binary")
    bodies = written(found.groupBy("set_hash").agg(F.first("shingles").alias("shingles")), "bodies")
    shared.destroy()
    return bodies


def _opened(shingles: bytes) -> np.ndarray:
    whole = np.zeros((len(shingles) // 6, 8), np.uint8)
    whole[:, 2:] = np.frombuffer(shingles, np.uint8).reshape(-1, 6)
    return whole.view("<u8").reshape(-1)


def _alike(n: Column, m: Column, percent: int) -> Column:
    """Sizes that allow a link."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of the pairs of set hashes that are linked, by their whole sets; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = _opened(x), _opened(y)
                both = len(np.intersect1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    rows.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])

    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_hash")).distinct()
    bodies = whole_sets(docs, sets.join(wanted, "set_hash", "left_semi"), size)
    left = bodies.select(F.col("set_hash").alias("a"), F.col("shingles").alias("x"))
    right = bodies.select(F.col("set_hash").alias("b"), F.col("shingles").alias("y"))
    return written(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def _leaders(index: DataFrame, percent: int) -> DataFrame:
    """(group, pivot): of each group, the ones that are first and last among the holders of most of its shingles."""
    holder = F.struct("group", "n", "i")
    pivots = index.groupBy("token").agg(F.array(F.min(holder), F.max(holder)).alias("ends"))
    each = index.join(pivots, "token").select("group", "n", F.posexplode("ends").alias("end", "p"))
    near = each.where((F.col("group") != F.col("p.group")) & _alike(F.col("n"), F.col("p.n"), percent))
    votes = near.groupBy("group", "end", F.col("p.group").alias("pivot")).agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    strong = votes.where(LEADER_SHARE * F.col("c") >= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    return strong.groupBy("group", "end").agg(F.max(F.struct("c", "pivot")).alias("best")).select("group", F.col("best.pivot").alias("pivot"))


def _stars(index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets: members with the first member of their leader's group and of their own."""
    leaders = _leaders(index, percent).distinct()
    first = sets.groupBy("group").agg(F.min("set_hash").alias("a"))
    each = sets.select("group", F.col("set_hash").alias("b"))
    across = leaders.join(each, "group").join(first.withColumnRenamed("group", "pivot"), "pivot").select("a", "b")
    return across.unionAll(each.join(first, "group").select("a", "b")).where("a <> b")


def _open(index: DataFrame, known: DataFrame) -> DataFrame:
    """Index rows of shingles that are shared by different components, with the components of the group (low, high)
    and the position of its first such shingle; written."""
    spans = known.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("last").alias("last"))
    posting = index.join(spans, "group")
    open_ = posting.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l <> h").select("token")
    posting = written(posting.join(open_, "token"), "posting")
    first = posting.groupBy("group").agg(F.min("i").alias("i0"), F.count(F.lit(1)).alias("held"))
    return written(posting.join(first, "group"), "posting")


def _apart(x: str, y: str) -> Column:
    """Groups with members of different components."""
    return (F.col(f"{x}.low") != F.col(f"{y}.low")) | (F.col(f"{x}.high") != F.col(f"{x}.low")) | (F.col(f"{y}.high") != F.col(f"{y}.low"))


def _within_reach(x: str, y: str, percent: int) -> Column:
    """Sizes and first open positions that allow a link: no shingle before the first open one can be shared."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    ahead = F.least(n - F.col(f"{x}.i0"), m - F.col(f"{y}.i0"))
    return _alike(n, m, percent) & ((100 + percent) * ahead >= percent * (n + m))


def _chances(posting: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets: members of groups that hold many open shingles, with the first member of one other such group a shingle."""
    strong = posting.where(LEADER_SHARE * F.col("held") >= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    pick = F.min_by(F.struct("group", "n", "i0", "low", "high"), F.xxhash64("token", "group"))
    x = strong.alias("x").join(strong.groupBy("token").agg(pick.alias("p")).alias("t"), "token")
    x = x.select("x.*", F.col("t.p").alias("p")).where((F.col("group") != F.col("p.group")) & _within_reach("x", "p", percent) & _apart("x", "p"))
    near = x.select("group", F.col("p.group").alias("pivot")).distinct()
    first = known.groupBy("group").agg(F.min(F.struct("set_hash", "root")).alias("f")).select(F.col("group").alias("pivot"), F.col("f.set_hash").alias("a"), F.col("f.root").alias("ra"))
    each = known.select("group", F.col("set_hash").alias("b"), F.col("root").alias("rb"))
    return near.join(each, "group").join(first, "pivot").where("ra <> rb").select("a", "b")


def _crowds(posting: DataFrame, percent: int) -> DataFrame:
    """(group, pivot) of groups with an open shingle that CROWD groups hold: the pivot is the first holder of such
    a shingle, the one that most groups meet; written."""
    hot = posting.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("group", "n")).alias("p")).where(F.col("c") >= CROWD).select("token", "p")
    near = posting.join(hot, "token").where(_alike(F.col("n"), F.col("p.n"), percent)).select("group", F.col("p.group").alias("pivot")).distinct()
    popular = near.groupBy("pivot").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= CROWD)
    return written(near.join(popular, "pivot").groupBy("group").agg(F.max(F.struct("c", "pivot")).alias("best")).select("group", F.col("best.pivot").alias("pivot")), "crowds")


def _prefixes(d: int, n: int, m: int, linked: bool, percent: int) -> tuple[int, int]:
    """How many of the d rarest shingles of a difference must be looked at: in pairs where it is the smaller one, and the larger one.

    n and m are the sizes of the set and of p.  The need 2 |D(x) & D(y)| >= |D(x)| + |D(y)| - (n_x + n_y)(100 - percent) / (100 + percent)
    is least where the other set is as large as may be.  Two sets that are both linked to p are in one component; if x is linked,
    y is not, so |D(y)| > (n_y + m)(100 - percent) / (100 + percent).  If the need is 0 or less, both are linked to p: it is 1 at least.
    """
    far, near = 100 - percent, 100 + percent
    smaller = -(-(2 * percent * d - n * far) // (2 * percent))
    larger = -(-(percent * d - n * far) // percent)
    other = -(-(near * d + far * (m - n)) // (2 * near)) if linked else 1
    return tuple(min(d, d - max(1, need, other) + 1) for need in (smaller, larger))


def _differences(members: DataFrame, docs: DataFrame, sets: DataFrame, known: DataFrame, size: int, percent: int) -> DataFrame:
    """(pivot, p, x, group, n, root, linked, met, d, few, many, tokens): the difference of each set of a crowd from its pivot's first set,
    null where it is larger than the set; linked: x and p are linked; met: they are in one component; few, many: its prefixes; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for pivot, p, x, group, n, root, root_p, own, other in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    m, tokens = len(other) // 6, np.setxor1d(_opened(own), _opened(other))
                    d = len(tokens)
                    linked = (100 + percent) * d <= (100 - percent) * (n + m)
                    few, many = _prefixes(d, n, m, linked, percent)
                    rows.append((pivot, p, x, group, n, root, linked, root == root_p, d, few, many, tokens.view(np.int64) if d <= n else None))
                types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[f"c{i}" for i in range(12)])

    first = known.groupBy(F.col("group").alias("pivot")).agg(F.min(F.struct("set_hash", "root")).alias("f"))
    each = known.join(members, "group").join(first.select("pivot", F.col("f.set_hash").alias("p"), F.col("f.root").alias("root_p")), "pivot")
    each = written(each.select("pivot", "p", F.col("set_hash").alias("x"), "group", "n", "root", "root_p"), "members")
    wanted = each.select(F.col("x").alias("set_hash")).unionAll(each.select("p")).distinct()
    bodies = whole_sets(docs, sets.join(wanted, "set_hash", "left_semi"), size)
    both = each.join(bodies.select(F.col("set_hash").alias("x"), F.col("shingles").alias("own")), "x").join(bodies.select(F.col("set_hash").alias("p"), F.col("shingles").alias("other")), "p")
    columns = ["pivot", "p", "x", "group", "n", "root", "root_p", "own", "other"]
    schema = "pivot long, p long, x long, group long, n long, root long, linked boolean, met boolean, d long, few long, many long, tokens array<long>"
    return written(both.select(*columns).mapInArrow(run, schema), "differences")


def _same_crowd(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of one crowd and different components whose differences may be alike enough."""
    tokens = apart.select("pivot", "x", F.explode("tokens").alias("token"))
    often = tokens.groupBy("pivot", "token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    # rarest first: those of one set alone, then by count and shingle
    order = tokens.join(often, ["pivot", "token"]).groupBy("x", "pivot").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("order"))
    placed = apart.drop("tokens").join(order, ["x", "pivot"]).select("*", F.posexplode("order").alias("at", "o"))
    placed = placed.select("pivot", F.col("o.token").alias("token"), "x", "n", "root", "linked", "d", "few", "many", (F.col("d") - F.size("order") + F.col("at")).alias("i"))
    placed = written(placed.where("i < many OR i < few"), "placed")
    x, y = placed.where("i < few").alias("x"), placed.where("i < many").alias("y")
    n, m, d, e = (F.col(c) for c in ("x.n", "y.n", "x.d", "y.d"))
    need = (100 + percent) * (d + e) - (100 - percent) * (n + m)  # 2 * (100 + percent) times the shingles that must be shared
    met = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.token") == F.col("y.token"))).where(
        (F.struct(d, F.col("x.x")) < F.struct(e, F.col("y.x"))) & (F.col("x.root") != F.col("y.root")) & ~(F.col("x.linked") & F.col("y.linked"))
        & _alike(n, m, percent) & (2 * (100 + percent) * F.least(d - F.col("x.i"), e - F.col("y.i")) >= need)
    )
    return met.select(F.col("x.x").alias("a"), F.col("y.x").alias("b")).unionAll(apart.where("linked AND NOT met").select("x", "p"))


def _rest(posting: DataFrame, known: DataFrame, percent: int, docs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """All pairs (a, b) of sets of different components that share a prefix or may be linked by their shared prefix shingles."""
    crowds = _crowds(posting, percent)
    apart = None if crowds.isEmpty() else _differences(crowds, docs, sets, known, size, percent)
    if apart is None:
        stay, posting = crowds, posting.withColumn("pivot", F.lit(None).cast("long"))
    else:
        stay = written(apart.groupBy("group", "pivot").agg(F.max(F.col("tokens").isNull()).alias("far")).where("NOT far").select("group", "pivot"), "crowds")
        posting = posting.join(stay, "group", "left")
    crowd = F.struct(F.col("pivot").isNotNull().alias("many"), F.coalesce("pivot", "group").alias("id"))
    posting = written(posting.withColumn("crowd", crowd).drop("pivot"), "posting")

    # crowds that share a shingle, by the same tests on the bounds of their groups; then their groups
    each = posting.groupBy("token", "crowd").agg(
        F.min("n").alias("n"), F.max("n").alias("most"), F.max(F.col("n") - F.col("i0")).alias("ahead"), F.min("low").alias("low"), F.max("high").alias("high"),
    )
    v, w = each.alias("v"), each.alias("w")
    n, m = F.col("v.n"), F.col("w.n")
    near = (100 * F.col("v.most") >= percent * m) & (100 * F.col("w.most") >= percent * n)
    reach = (100 + percent) * F.least("v.ahead", "w.ahead") >= percent * (n + m)
    crowds = v.join(w, F.col("v.token") == F.col("w.token")).where((F.col("v.crowd") < F.col("w.crowd")) & _apart("v", "w") & near & reach)
    crowds = crowds.select("v.token", F.col("v.crowd").alias("crowd"), F.col("w.crowd").alias("other"))
    x = crowds.join(posting, ["token", "crowd"]).select("token", "other", F.struct(*[c for c in posting.columns if c not in ("token", "crowd")]).alias("x"))
    y = posting.select("token", F.col("crowd").alias("other"), F.struct(*[c for c in posting.columns if c not in ("token", "crowd")]).alias("y"))
    met = x.join(y, ["token", "other"]).where(_apart("x", "y") & _within_reach("x", "y", percent))
    n, m = F.col("x.n"), F.col("y.n")
    counted = met.groupBy(F.col("x.group").alias("g"), F.col("y.group").alias("h")).agg(
        F.count(F.lit(1)).alias("c"), F.max("x.i").alias("i"), F.max("y.i").alias("j"), F.first(n).alias("n"), F.first(m).alias("m"),
        F.first("x.last").alias("ex"), F.first("y.last").alias("ey"),
    )
    n, m = F.col("n"), F.col("m")
    beyond = lambda k: F.ceil(k * percent / 100) - 1  # noqa: E731  shingles after a prefix
    # what may be shared after the last shared position, and after the prefix that ends first
    rest = F.least(
        n - F.col("i") - 1, m - F.col("j") - 1,
        F.when(F.col("ex") < F.col("ey"), beyond(n)).when(F.col("ey") < F.col("ex"), beyond(m)).otherwise(F.greatest(beyond(n), beyond(m))),
    )
    may = counted.where((100 + percent) * (F.col("c") + rest) >= percent * (n + m)).select("g", "h")
    side = lambda key, c, r: known.select(F.col("group").alias(key), F.col("set_hash").alias(c), F.col("root").alias(r))
    across = may.join(side("g", "a", "ra"), "g").join(side("h", "b", "rb"), "h").where("ra <> rb").select("a", "b")
    mixed = known.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(F.col("group").alias("g")).join(stay.select(F.col("group").alias("g")), "g", "left_anti")
    inside = side("g", "a", "ra").join(mixed, "g", "left_semi").join(side("g", "b", "rb"), "g").where("a < b AND ra <> rb").select("a", "b")
    if apart is None:
        return across.unionAll(inside)
    return across.unionAll(inside).unionAll(_same_crowd(apart.join(stay, ["group", "pivot"], "left_semi"), percent))


def _linked(docs: DataFrame, size: int, percent: int, most_frequent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of all rows, the distinct sets, and (node, root) of the linked sets."""
    signed = written(signatures(docs, size, percent, most_frequent), "signed")
    sets = written(signed.where("n > 0").groupBy("set_hash").agg(*[F.min(c).alias(c) for c in ("doc_id", "text_hash", "n", "group", "last")]), "sets")
    rows = signed.where("prefix IS NOT NULL").select("group", "n", F.posexplode("prefix").alias("i", "token"))
    shared = rows.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("token")
    index = written(rows.join(shared, "token").distinct(), "index")
    links = verified(_stars(index, sets, percent), docs, sets, size, percent)
    roots = components(links)

    def known() -> DataFrame:
        named = sets.join(roots.withColumnRenamed("node", "set_hash"), "set_hash", "left").withColumn("root", F.coalesce("root", "set_hash"))
        return written(named.select("set_hash", "group", "n", "last", "root"), "known")

    met = known()
    posting = _open(index, met)
    more = None if posting.isEmpty() else verified(_chances(posting, met, percent), docs, sets, size, percent)
    if more is not None and not more.isEmpty():
        links = links.unionAll(more)
        roots = components(links)
        met = known()
        posting = _open(index, met)
    more = verified(_rest(posting, met, percent, docs, sets, size), docs, sets, size, percent)
    if not more.isEmpty():
        roots = components(links.unionAll(more))
    return signed, sets, roots


def classes(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    signed, sets, roots = _linked(docs, size, percent, most_frequent)
    named = sets.select("set_hash", "doc_id").join(roots.withColumnRenamed("node", "set_hash"), "set_hash", "left").withColumn("root", F.coalesce("root", "set_hash"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = named.join(smallest, "root").select("set_hash", "component_id")
    joined = signed.select("doc_id", "n", "set_hash").join(of_set, "set_hash", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """docs with one row of each component: the smallest doc_id (null ids last), then the smallest text hash.

    Rows without words stay, as they are linked with nothing.
    """
    signed, sets, roots = _linked(docs, size, percent, most_frequent)
    root_of = sets.select("set_hash").join(roots.withColumnRenamed("node", "set_hash"), "set_hash", "left").select("set_hash", F.coalesce("root", "set_hash").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("f")
    by_set = signed.where("n > 0").groupBy("set_hash").agg(first).join(root_of, "set_hash")
    stay = by_set.groupBy("root").agg(F.min("f").alias("f")).select(F.col("f.doc_id").alias("i"), F.col("f.text_hash").alias("h"))
    mark, worded = free_name(docs, "_hash"), F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    key = F.col("doc_id").cast("long")
    kept = keyed.where(worded).join(stay, (F.col(mark) == F.col("h")) & key.eqNullSafe(F.col("i")), "left_semi").dropDuplicates([mark, "doc_id"])
    return only(kept.unionByName(keyed.where(~worded)), docs.columns)
