"""Packing into windows by non-negative least squares.

Documents are cut into full windows and one remainder.  The histogram of remainder lengths (at most WINDOW
numbers, whatever the size of the corpus) goes to the driver, which enumerates pairs and triples of lengths
that fill a window, solves min |A x - h| with x >= 0 for their repeat counts, rounds them down and trims
them to what is there.  The remaining pieces are packed greedily: one after the other, cut where a window
ends, and the last window is cut into powers of two.  So every sequence has WINDOW tokens or a power of two.

A document finds its place by arithmetic: its rank among remainders of its length names the repeat of the
combination that it fills, or its place in the run of left-over pieces.  Ranks come from counters of the
writing tasks, kept in a table in the shared folder, so nothing is sorted and a repeated task changes nothing.

Null texts are empty texts (one id, the end id).  Null or repeated doc_ids and repeated rows are packed like
any others; an empty table gives no pieces.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import python_ready, written
from .tokens import encoder, in_groups

WINDOW = 2048
#: Lengths, the most frequent ones, from which the two longer parts of a triple are taken.
TRIPLE_LENGTHS = 64
SWEEPS = 60
ROWS = "part int, doc_id long, n long, bin int, bin_rank long, full_rank long, blob binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def combinations(histogram: np.ndarray, window: int, triple_lengths: int = TRIPLE_LENGTHS) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that add up to the window."""
    found = [(a, window - a) for a in range(1, window // 2 + 1) if histogram[a] and histogram[window - a]]
    heavy = sorted(sorted(np.flatnonzero(histogram).tolist(), key=lambda a: (-histogram[a], a))[:triple_lengths])
    for i, a in enumerate(heavy):
        for b in heavy[i:]:
            c = window - a - b
            if 0 < c <= a and histogram[c]:
                found.append((c, a, b))
    return found


def least_squares(columns: list[dict[int, int]], target: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, by coordinate descent; a column maps rows to its few entries."""
    x, rest = [0.0] * len(columns), [float(v) for v in target]
    norms = [sum(v * v for v in c.values()) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for j, c in enumerate(columns):
            step = max(sum(v * rest[i] for i, v in c.items()) / norms[j], -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for i, v in c.items():
                    rest[i] -= v * step
        if moved < 0.01:
            break
    return np.array(x)


def solve(histogram: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations with whole repeat counts that the histogram can meet."""
    combos = combinations(histogram, window)
    counts = least_squares([dict(Counter(c)) for c in combos], histogram)
    left, found = histogram.astype(np.int64).copy(), []
    for j in sorted(range(len(combos)), key=lambda j: (-counts[j], combos[j])):
        times = min([int(counts[j] + 1e-6), *(int(left[a]) // m for a, m in Counter(combos[j]).items())])
        if times > 0:
            found.append((combos[j], times))
            for a in combos[j]:
                left[a] -= times
    return found


class Layout:
    """Places of remainders: by combinations, then in the run of left-over pieces, then full windows."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window = window
        repeats = solve(histogram, window) if histogram.any() else []
        slots: dict[int, list[tuple[int, int, int]]] = {}  # length -> (repeats, first sequence, offset)
        sequence = 0
        for combo, times in repeats:
            offset = 0
            for a in combo:
                slots.setdefault(a, []).append((times, sequence, offset))
                offset += a
            sequence += times
        self.slots = {a: (np.cumsum([0] + [s[0] for s in v]), v) for a, v in slots.items()}
        used = np.zeros(window, np.int64)
        for a, (ends, _) in self.slots.items():
            used[a] = ends[-1]
        self.used, self.run_first = used, sequence
        left = (histogram - used) * np.arange(window)
        self.run_start = np.concatenate([[0], np.cumsum(left)[:-1]])
        total = int(left.sum())
        self.run_whole = total // window * window  # ids of the run in full windows
        self.tail = []  # (start in the run, length): powers of two
        start, size = self.run_whole, window // 2
        while start < total:
            while size > total - start:
                size //= 2
            self.tail.append((start, size))
            start += size
        self.full_first = sequence + total // window + len(self.tail)

    def remainder(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of the pieces of a remainder."""
        if rank < self.used[length]:
            ends, slots = self.slots[length]
            k = int(np.searchsorted(ends, rank, "right")) - 1
            return [(length, slots[k][1] + rank - int(ends[k]), slots[k][2])]
        at = int(self.run_start[length]) + (rank - int(self.used[length])) * length
        pieces = []
        while length:
            if at < self.run_whole:
                sequence, offset, end = self.run_first + at // self.window, at % self.window, (at // self.window + 1) * self.window
            else:
                k = max(i for i, (start, _) in enumerate(self.tail) if start <= at)
                start, size = self.tail[k]
                sequence, offset, end = self.run_first + self.run_whole // self.window + k, at - start, start + size
            take = min(length, end - at)
            pieces.append((take, sequence, offset))
            at, length = at + take, length - take
        return pieces


def encoded(docs: DataFrame, tokenizer: str, window: int, end: int) -> DataFrame:
    """ROWS of all documents: ids, and the counters of the writing task."""
    python_ready(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, full, bins = TaskContext.get().partitionId(), 0, Counter()
        shrink = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_groups(texts):
                rows = []
                for key, ids in zip(keys[a:b], encoder(tokenizer).encode(texts[a:b]), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    rest = n % window
                    planes = np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(-1, 4).T).tobytes()
                    rows.append((part, key, n, rest, bins[rest], full, shrink.compress(planes)))
                    bins[rest] += 1
                    full += n // window
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in ROWS.split(", ")])
        encoder(tokenizer).forget_fresh()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ROWS)


def pack(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end: int = 1) -> DataFrame:
    """PIECES of all documents."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    table = written(encoded(docs, tokenizer, window, end), "ids")
    counts = table.groupBy("part", "bin").agg(F.count(F.lit(1)).alias("c"), F.sum(F.floor(F.col("n") / window)).alias("full"))
    histogram = np.zeros(window, np.int64)
    for r in counts.where("bin > 0").groupBy("bin").agg(F.sum("c").alias("c")).collect():  # at most `window` rows
        histogram[r.bin] = r.c
    layout = Layout(histogram, window)

    ahead = lambda *by: W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    fulls = counts.groupBy("part").agg(F.sum("full").alias("full"))  # one row a task of the writer
    fulls = fulls.select("part", F.coalesce(F.sum("full").over(ahead(F.lit(0))), F.lit(0)).alias("full_base"))
    bases = counts.select("part", "bin", F.coalesce(F.sum("c").over(ahead("bin")), F.lit(0)).alias("bin_base")).join(fulls, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for key, n, rest, rank, full, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = memoryview(np.ascontiguousarray(np.frombuffer(grow.decompress(blob), np.uint8).reshape(4, -1).T).tobytes())
                places = [(window, layout.full_first + full + k, 0) for k in range(n // window)] + (layout.remainder(rest, rank) if rest else [])
                start = 0
                for length, sequence, offset in places:
                    rows.append((key, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, sequence, offset))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], names=[x.split()[0] for x in PIECES.split(", ")])

    placed = table.join(bases, ["part", "bin"]).select(
        "doc_id", "n", "bin", (F.col("bin_rank") + F.col("bin_base")).alias("rank"), (F.col("full_rank") + F.col("full_base")).alias("full"), "blob"
    )
    return placed.mapInArrow(run, PIECES)
