"""Token ids in bit-plane or byte-plane files.

Documents are range-partitioned and sorted by doc_id.  Each partition cuts its ids into segments that end
with a document; a segment is cut into blocks of BLOCK ids, a block is transposed into 32 bit planes or 4
byte planes, and each plane is compressed with zstandard.  A segment's header holds the index of its planes
(compressed length of each plane of each block), so a block can be read alone.

Segment, little endian: magic `PLN1`, u8 planes (32 or 4), u32 block size, u64 ids, u32 blocks, then u32
length of each plane, block by block, then the planes.

Segments are rows of a Parquet table without further compression (part, segment, first id in the part,
blob, doc_ids, doc_tokens), which Spark commits as a whole, so a lost executor leaves no half file.

Null texts are empty texts and hold only the end id.  Order: null doc_ids first, then ascending; equal doc_ids by a hash of
the text.  An empty table gives an empty file and result.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import python_ready, shared_folder
from .tokens import encoder, in_groups

MAGIC = b"PLN1"
BLOCK, SEGMENT = 16_384, 1 << 20
HEAD = struct.Struct("<4sBIQI")
FILE = "part int, segment int, first long, blob binary, doc_ids array<long>, doc_tokens array<long>"


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """Planes of a block, lowest first; the last byte of a bit plane is padded with zeros."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [x.tobytes() for x in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if len(planes) == 4:
        return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


def pack(ids: np.ndarray, planes: int = 4, block: int = BLOCK, level: int = 3) -> bytes:
    """A segment."""
    if planes not in (4, 32):
        raise ValueError("planes: 4 for byte planes or 32 for bit planes")
    zip_ = zstandard.ZstdCompressor(level=level, write_content_size=True)
    parts = [zip_.compress(p) for i in range(0, len(ids), block) for p in to_planes(ids[i : i + block], planes)]
    index = np.array([len(p) for p in parts], "<u4").tobytes()
    return b"".join([HEAD.pack(MAGIC, planes, block, len(ids), len(parts) // planes), index, *parts])


def unpack(blob: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of a segment; only the blocks that hold them are read."""
    magic, planes, block, n, blocks = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a plane segment")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, "<u4")
    lengths = np.frombuffer(blob, "<u4", blocks * planes, HEAD.size)
    places = HEAD.size + lengths.nbytes + np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    unzip, found = zstandard.ZstdDecompressor(), []
    for b in range(start // block, (stop - 1) // block + 1):
        rows = [unzip.decompress(blob[places[k] : places[k + 1]]) for k in range(b * planes, (b + 1) * planes)]
        found.append(from_planes(rows, min(block, n - b * block)))
    return np.concatenate(found)[start % block :][: stop - start]


def write_planes(
    docs: DataFrame, path: str, tokenizer: str, *, end: int | None = 1, planes: int = 4, block: int = BLOCK, segment: int = SEGMENT,
) -> None:
    """Encodes `text` of all documents and writes the segments to path."""
    python_ready(docs.sparkSession)
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        keys: list[int | None] = []
        sizes: list[int] = []

        def row() -> pa.RecordBatch:
            values = [[part], [number], [first], [pack(np.frombuffer(b"".join(ids), "<u4"), planes, block)], [keys], [sizes]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["part", "segment", "first", "blob", "doc_ids", "doc_tokens"])

        held = 0
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_groups(texts):
                for key, own in zip(doc_ids[a:b], encoder(tokenizer).encode(texts[a:b]), strict=True):
                    own += tail
                    ids.append(own), keys.append(key), sizes.append(len(own) // 4)
                    held += len(own) // 4
                    if held >= segment:
                        yield row()
                        number, first, held = number + 1, first + held, 0
                        ids, keys, sizes = [], [], []
        encoder(tokenizer).forget_fresh()
        if keys:
            yield row()

    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), tie)
    ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie).mapInArrow(run, FILE).write.option("compression", "none").parquet(path)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document in the files."""
    python_ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, blob, keys, sizes in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                data = memoryview(unpack(blob).tobytes())
                ends = np.cumsum(sizes)
                starts = ends - np.array(sizes, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(first + starts, pa.int64()), pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    names=["part", "doc_id", "first", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(FILE).parquet(path)
    sizes = files.select("part", (F.expr("aggregate(doc_tokens, 0L, (a, x) -> a + x)")).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition of the writer
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = files.select("part", "first", "blob", "doc_ids", "doc_tokens").mapInArrow(run, "part int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, **settings) -> DataFrame:
    """Writes all documents to the shared folder and reads them back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/llm-planes-{uuid.uuid4().hex}"
    write_planes(docs, path, tokenizer, **settings)
    return read_planes(spark, path)
