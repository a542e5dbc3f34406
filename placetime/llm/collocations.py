"""Phrases of words that occur together, mined by SON partitioning.

Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, pieces into words at blanks and tabs.
f(phrase) counts the contiguous occurrences of 1 to `longest` words inside pieces, a language at a time (null: und).

1. Shards.  Documents are dealt into pieces of about PIECE_BYTES of text, one a task, and every SHARDS-th piece belongs to
   the same shard, so a shard keeps its share of the table, however large that is.  A shard that holds the share w of a
   language's words mines all phrases with at least ceil(support * w) occurrences there.  The shares add up to
   1, so a phrase with `support` occurrences in all reaches the local support in some shard: none is missed.
2. A shard is mined level by level over all of its pieces: a phrase is counted where the phrases without its first and
   without its last word are frequent in the shard.  Pieces keep the numbers of their words; each level is a pass over them
   whose counts meet in Spark, and the frequent phrases reach the next level as a bit map of at most MAP_BITS bits.
   A wrong hit there has a phrase counted that cannot be frequent; the counts themselves are of whole phrases.
3. The union of the locally frequent phrases is a table.  Where a shard did not report a phrase it holds at most its
   local support less one; candidates that cannot reach `support` even with that everywhere are left out.
4. All others are counted in every piece, exactly, in blocks of about BLOCK phrases: a block is a table of
   (phrase of the first k - 1 words, next word) sent to the tasks, so its size is bounded, and each further block
   is one more pass over the pieces.  A task keeps one count a candidate, however much it reads, so the pass
   takes two tasks a core instead of one a file split: partial counts do not grow with tasks times candidates.
   Counts are summed in Spark; those below `support` go.

A cut of a phrase after its first k words has the score floor(1000 * a * n / (l * r)), in integers of any length:
a = f(phrase), l and r = f of the two parts, n = all words of the language.  The lowest cut counts, ties to the
smallest k.  A phrase inside a longer frequent one goes when 100 * f(longer) >= covered * a; a phrase one word longer
decides that, as whatever is in between occurs at least as often as the longer one.

Null and blank texts have no words.  Repeated rows count each time.  Texts of any length are read whole.  An empty
table has no phrases.  Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import python_ready, written
from .group_join import bit_map

#: Characters that end a piece, as one byte each; blanks and tabs end words.
ENDS = b".,;:!?\n\x0b\x0c\r"
TO_LINES = bytes.maketrans(ENDS, b"\n" * len(ENDS))
SUPPORT, LONGEST, COVERED, TOP = 100, 5, 100, 2000
#: Shards, whatever the size of the table: each mines at about that part of the support.  Text that a task takes.
SHARDS, PIECE_BYTES = 4, 12 << 20
BLOCK = 400_000
GAP = -1
#: Numbers of words that are looked at together.
STEP = 200_000


def word_ids(text: str, number: dict[bytes, int]) -> list[int]:
    """Numbers of a text's words, with a gap after each piece."""
    ids: list[int] = []
    for piece in text.encode("utf-8", "surrogatepass").lower().translate(TO_LINES).split(b"\n"):
        if words := piece.split():
            ids += map(number.__getitem__, words)
            ids.append(GAP)
    return ids


def mine(ids: np.ndarray, support: int, longest: int, known: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(first positions, counts, words) of all phrases of each length with at least `support` occurrences.

    known(first positions, words) tells instead which phrases shorter than `longest` are frequent, where ids are only a part.
    """
    mark, m = ids.astype(np.int32), 0                  # mark[i]: the frequent phrase of size - 1 words at i, or GAP
    for size in range(1, longest + 1):
        if size == 1:
            at = np.flatnonzero(mark >= 0).astype(np.int32)
            key = mark[at]
        else:                                          # a phrase is two overlapping frequent ones of a word less
            at = np.flatnonzero((mark[:-1] >= 0) & (mark[1:] >= 0)).astype(np.int32)
            key = mark[at].astype(np.int64) * m + mark[at + 1]
        if not len(at):
            return
        order = np.argsort(key, kind="stable")
        key = key[order]
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        del key
        order = at[order]
        starts = np.flatnonzero(begins)
        n = np.diff(starts, append=len(order))
        frequent = known(order[starts], size) if known and size < longest else n >= support
        if not frequent.any():
            return
        yield order[starts[frequent]], n[frequent], size
        m = int(frequent.sum())
        dense = np.where(frequent, np.cumsum(frequent) - 1, GAP).astype(np.int32)
        mark = np.full(len(mark), GAP, np.int32)
        mark[order] = np.repeat(dense, n)


def texts_of(batch: pa.RecordBatch, rows: int = 500) -> Iterator[tuple]:
    """The rows of a batch as Python values, a few at a time, then None after every few."""
    for at in range(0, batch.num_rows, rows):
        yield from zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True)
        yield None


def with_lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def pieces(texts: DataFrame, shard_bytes: int) -> DataFrame:
    """(shard, lang, n, words, ids) of each piece and language: number of words, the distinct ones joined by line feeds, and
    their numbers in the order of the text with a gap after each piece of a text, both compressed; written."""
    python_ready(texts.sparkSession)
    tasks = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % SHARDS
        numbers: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(count().__next__))
        parts: dict[str, list[np.ndarray]] = defaultdict(list)
        shrink = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            gathered: dict[str, list[int]] = defaultdict(list)
            for row in texts_of(batch):
                if row:
                    lang, text = row
                    gathered[lang] += word_ids(text, numbers[lang])
                else:
                    for lang, ids in gathered.items():
                        parts[lang].append(np.array(ids, np.int32))
                    gathered.clear()
        for lang in list(parts):
            ids = np.concatenate(parts.pop(lang))
            values = [shard], [lang], [int((ids >= 0).sum())], [shrink(b"\n".join(numbers.pop(lang)))], [shrink(ids.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "lang", "n", "words", "ids"])

    return written(texts.repartition(int(tasks)).mapInArrow(run, "shard int, lang string, n long, words binary, ids binary").where("n > 0"), "phrases-pieces")


def opened(words: pa.BinaryScalar, ids: pa.BinaryScalar) -> tuple[list[bytes], np.ndarray]:
    grow = zstandard.ZstdDecompressor().decompress
    return grow(words.as_py()).split(b"\n"), np.frombuffer(grow(ids.as_py()), np.int32)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _keys(shard: int, lang: str, hashes: np.ndarray) -> np.ndarray:
    """64 bits of each phrase in a shard and language, from the hashes of its words (a column each)."""
    key = np.full(len(hashes), xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), shard), np.uint64)
    for column in hashes.T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def level_counts(parts: DataFrame, size: int, shared) -> DataFrame:
    """(shard, lang, phrase, n, least) of the phrases of `size` words in each piece whose shorter phrases may be frequent in
    its shard by the bit map; least: the local support."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, whole = shared.value if shared else (1, b"")
        flat, last = np.frombuffer(whole, np.uint8), np.uint64(bits - 1)
        for batch in batches:
            for at in range(batch.num_rows):
                shard, lang, least = (c[at].as_py() for c in batch.columns[:3])
                own, ids = opened(batch.column(3)[at], batch.column(4)[at])
                hashes = _hashes(own) if size > 1 else None
                words = pa.array(own, pa.binary()).cast(pa.string())

                def known(first: np.ndarray, k: int) -> np.ndarray:
                    key = _keys(shard, lang, hashes[ids[first[:, None] + np.arange(k)]])
                    low, high = key & last, (key >> np.uint64(32)) & last
                    return ((flat[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & (flat[high >> np.uint64(3)] >> (high & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)

                for first, n, k in mine(ids, 1, size, known):
                    for at_ in range(0, len(first) if k == size else 0, 50_000):
                        some = first[at_ : at_ + 50_000]
                        phrases = pc.binary_join_element_wise(*(words.take(pa.array(ids[some + j])) for j in range(k)), " ")
                        fixed = [pa.repeat(pa.scalar(v, t), len(some)) for v, t in ((shard, pa.int32()), (lang, pa.string()), (least, pa.int64()))]
                        yield pa.RecordBatch.from_arrays([fixed[0], fixed[1], phrases, pa.array(n[at_ : at_ + 50_000], pa.int64()), fixed[2]], names=["shard", "lang", "phrase", "n", "least"])

    return parts.mapInArrow(run, "shard int, lang string, phrase string, n long, least long")


def keyed(frequent: DataFrame) -> DataFrame:
    """(key) of the phrases of a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_keys(shard, lang, _hashes(phrase.encode("utf-8", "surrogatepass").split(b" "))[None])[0].view(np.int64) for shard, lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])

    return frequent.select("shard", "lang", "phrase").mapInArrow(run, "key long")


def locally_frequent(parts: DataFrame, support: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(shard, lang, phrase, n, least) of every shard's own frequent phrases, and (shard, lang, least): its local support."""
    spark = parts.sparkSession
    own = parts.groupBy("shard", "lang").agg(F.sum("n").alias("own"))
    total = parts.groupBy("lang").agg(F.sum("n").alias("total"))
    # the ceiling of support * own / total, in integers
    shares = written(own.join(total, "lang").select("shard", "lang", F.expr(f"({support}L * own + total - 1) div total").alias("least")), "phrases-shares")
    ready = parts.join(F.broadcast(shares), ["shard", "lang"]).select("shard", "lang", "least", "words", "ids")
    found = keys = shared = None
    for size in range(1, longest + 1):
        # pieces name a phrase once: counts meet after the shuffle, there is nothing to sum up before it
        counts = level_counts(ready, size, shared).repartition("shard", "lang", "phrase").groupBy("shard", "lang", "phrase")
        level = written(counts.agg(F.sum("n").alias("n"), F.max("least").alias("least")).where("n >= least"), "phrases-local")
        found = level if found is None else found.unionByName(level)
        if size == longest or level.isEmpty():
            break
        own = written(keyed(level), "phrases-keys")
        keys = own if keys is None else keys.unionAll(own)
        shared = spark.sparkContext.broadcast(bit_map(keys, "key"))
    return found, shares


COUNTS = "lang string, phrase string, n long"


def phrase_rows(langs, phrases, n) -> pa.RecordBatch:
    columns = [pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])


class Block:
    """Candidates as steps from phrase to phrase by one more word, exact: sorted (phrase, word) pairs."""

    def __init__(self, words: list[bytes], rows: np.ndarray):
        """rows: the words of each candidate, by position in `words`, then -1."""
        self.words, self.rows = words, rows
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []      # per length: sorted pairs, candidate or -1
        node, longest = np.zeros(len(rows), np.int64), rows.shape[1]
        for k in range(longest):
            going = rows[:, k] >= 0
            pairs, node[going] = np.unique(node[going] * len(words) + rows[going, k], return_inverse=True)
            ends = going & (rows[:, k + 1] < 0) if k + 1 < longest else going
            chosen = np.full(len(pairs), -1)
            chosen[node[ends]] = np.flatnonzero(ends)
            self.steps.append((pairs, chosen))

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add the occurrences of every candidate in ids (positions in self.words, or GAP)."""
        at = np.flatnonzero(ids >= 0)
        node = np.zeros(len(at), np.int64)
        for k, (pairs, chosen) in enumerate(self.steps):
            if not len(pairs):
                return
            inside = at + k < len(ids)
            at, node = at[inside], node[inside]
            word = ids[at + k]
            pair = node * len(self.words) + word
            found = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            hit = (word >= 0) & (pairs[found] == pair)
            at, node = at[hit], found[hit]
            met = chosen[node]
            counts += np.bincount(met[met >= 0], minlength=len(counts))

    def phrases(self, candidates: np.ndarray) -> list[str]:
        return [b" ".join([self.words[w] for w in row if w >= 0]).decode("utf-8", "surrogatepass") for row in self.rows[candidates].tolist()]


def as_rows(phrases: list[str], longest: int) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of phrases, and each phrase as positions in them."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    rows = np.full((len(phrases), longest), -1, np.int32)
    for k, phrase in enumerate(phrases):
        own = [number[w] for w in phrase.encode("utf-8", "surrogatepass").split(b" ")]
        rows[k, : len(own)] = own
    return list(number), rows


def counted(parts: DataFrame, candidates: DataFrame, longest: int, block: int) -> DataFrame:
    """(lang, phrase, f) of every candidate, over all pieces."""
    blocks = 1 + candidates.count() // block
    parts = parts.select("lang", "words", "ids").coalesce(2 * parts.sparkSession.sparkContext.defaultParallelism)
    out = None
    for k in range(blocks):
        own: dict[str, list[str]] = defaultdict(list)
        for row in candidates.where(F.pmod(F.xxhash64("lang", "phrase"), F.lit(blocks)) == k).toArrow().to_batches():
            for lang, phrase in zip(row.column(0).to_pylist(), row.column(1).to_pylist(), strict=True):
                own[lang].append(phrase)
        wanted = {lang: as_rows(phrases, longest) for lang, phrases in own.items()}

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            made: dict[str, tuple[Block, dict[bytes, int], np.ndarray]] = {}
            for batch in batches:
                for at in range(batch.num_rows):
                    lang = batch.column(0)[at].as_py()
                    if lang not in wanted:
                        continue
                    if lang not in made:
                        words, rows = wanted[lang]
                        made[lang] = Block(words, rows), {w: n for n, w in enumerate(words)}, np.zeros(len(rows), np.int64)
                    own, number, counts = made[lang]
                    # words that no candidate has are gaps; the last place is that of the gaps
                    text, ids = opened(batch.column(1)[at], batch.column(2)[at])
                    there = np.array([*(number.get(w, GAP) for w in text), GAP], np.int64)
                    ends = np.flatnonzero(ids == GAP) + 1
                    for some in np.split(ids, np.unique(ends[np.searchsorted(ends, np.arange(STEP, len(ids), STEP))])):
                        own.add(there[some], counts)
            for lang, (own, _, counts) in made.items():
                hit = np.flatnonzero(counts)
                for at in range(0, len(hit), 50_000):
                    some = hit[at : at + 50_000]
                    yield phrase_rows([lang] * len(some), own.phrases(some), counts[some])

        one = parts.mapInArrow(run, COUNTS)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shard_bytes: int = PIECE_BYTES, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to `longest` words with f >= support, and (lang, n) of all languages."""
    parts = pieces(with_lang(docs), shard_bytes)
    words = parts.groupBy("lang").agg(F.sum("n").alias("n"))
    local, shares = locally_frequent(parts, support, longest)
    slack = shares.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("most"))  # how often a phrase may occur that no shard reports
    excess = local.groupBy("lang", "phrase").agg(F.sum(F.col("n") - F.col("least") + 1).alias("excess"))
    candidates = written(excess.join(slack, "lang").where(F.col("excess") + F.col("most") >= support).select("lang", "phrase"), "phrases-candidates")
    return written(counted(parts, candidates, longest, block).where(F.col("f") >= support), "phrases-frequent"), words


def scored(frequent: DataFrame, words: DataFrame, covered: int = COVERED) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of 2 words and more that no longer one covers."""
    split = frequent.withColumn("w", F.split("phrase", " ")).withColumn("size", F.size("w"))
    phrases = split.where("size > 1").withColumnRenamed("f", "a")
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    joined = lambda w: F.array_join(w, " ")
    cuts = cuts.select(
        "lang", "phrase", "a", "k", joined(F.expr("slice(w, 1, k)")).alias("head"), joined(F.expr("slice(w, k + 1, size(w) - k)")).alias("tail"),
    )
    part = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    met = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(words, "lang")
    # products pass 64 bits: decimals of 38 digits, quotients cut to integers
    score = F.expr("(cast(1000 * cast(a as decimal(16, 0)) as decimal(19, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    best = met.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n")).alias("b"))
    inside = phrases.where("size > 2").select("lang", "a", F.explode(F.array(joined(F.expr("slice(w, 1, size - 1)")), joined(F.expr("slice(w, 2, size - 1)")))).alias("phrase"))
    longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return (
        best.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {covered} * b.a")
        .select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    )


def best_phrases(docs: DataFrame, top: int = TOP, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` by score, then a, then phrase."""
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = scored(*frequent_phrases(docs, **how)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT lang, [w FOR w IN string_split_regex(p, '[ \t]+') IF w <> ''] AS words
    FROM (SELECT coalesce(lang, 'und') AS lang,
                 unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS p FROM documents)
  ) WHERE len(words) > 0
), grams AS (
  SELECT lang, array_to_string(words[i : i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces), (SELECT unnest([1, 2, 3, 4, 5]) AS k)
  WHERE i + k - 1 <= len(words) GROUP BY ALL
), totals AS (SELECT lang, sum(f)::bigint AS n FROM grams WHERE k = 1 GROUP BY lang),
frequent AS (SELECT * FROM grams WHERE f >= 100),
cuts AS (
  SELECT lang, phrase, f AS a, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') AS head, array_to_string(string_split(phrase, ' ')[j + 1 : k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS j FROM frequent WHERE k > 1)
), cut_scores AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, n, ((1000::hugeint * c.a * n) // (x.f::hugeint * y.f))::bigint AS score
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.head JOIN frequent y ON y.lang = c.lang AND y.phrase = c.tail JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM frequent c WHERE c.k > 2 AND c.lang = b.lang AND c.f >= b.a AND c.phrase <> b.phrase AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept
) WHERE rank <= 2000
"""
