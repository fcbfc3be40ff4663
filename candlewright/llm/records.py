"""Operator 1: token ids as length-delimited binary records, with a separate offset index.

File format.  A shard is a sequence of records in ascending document order.  A record is

    uint64  n        length of the payload, little-endian, as all numbers here
    uint32  masked crc32 of those eight bytes
    n bytes payload: int64 doc_id, uint8 bytes per id (2 or 4), the ids
    uint32  masked crc32 of the payload
    byte    0x0A, the separator that Spark's text writer puts after each value

A shard ends after the record with which it passes ``shard_bytes``, so its size follows from that bound
and the longest document.  Shards lie in folders chunk=K; in a partition of the writer, documents go
on from one chunk to the next.

A masked checksum is the crc rotated right by 15 bits plus a constant, so that a checksum stored
inside checked data does not look like one.  The shards go through Spark's text writer and come
back through its binaryFile reader, so any store that Spark reaches will do.

The index is a Parquet table built by reading the shards back and verifying every checksum: one
row per record with its shard, byte offset, length, document, ids, and the number of ids before
it in the shard.  ``shuffled_read`` uses it to read records in a seeded random order.

Cases: null and empty texts give a record with the end id alone; repeated texts and repeated ids
give one record each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.llm.common import batch, keyed, rows_of, Scratch
from candlewright.llm.encoding import encoder

#: Fixed value of the masked checksum (as in the public TFRecord format).
MASK_DELTA = 0xA282EAD8
_HEAD, _OWN, _CRC = struct.Struct("<QI"), struct.Struct("<qB"), struct.Struct("<I")
_FRAMES = pa.schema([("chunk", pa.int32()), ("doc_id", pa.int64()), ("frame", pa.binary())])
SHARD_BYTES = 32 << 20
_INDEX = pa.schema([("shard", pa.string()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("ids_crc32", pa.int64())])
INDEX_SCHEMA = "shard string, doc_id long, offset long, n_bytes long, n_tokens long, before long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray) -> bytes:
    payload = _OWN.pack(doc_id, ids.dtype.itemsize) + ids.tobytes()
    size = struct.pack("<Q", len(payload))
    return size + _CRC.pack(masked_crc(size)) + payload + _CRC.pack(masked_crc(payload))


def parse(content: bytes, at: int) -> tuple[int, np.ndarray, int]:
    """The document and ids of the record at a byte offset, and the offset after it.

    Raises ValueError where a checksum does not match."""
    size, crc = _HEAD.unpack_from(content, at)
    if crc != masked_crc(content[at : at + 8]):
        raise ValueError(f"length checksum mismatch at byte {at}")
    payload = content[at + 12 : at + 12 + size]
    if _CRC.unpack_from(content, at + 12 + size)[0] != masked_crc(payload):
        raise ValueError(f"data checksum mismatch at byte {at}")
    doc_id, width = _OWN.unpack_from(payload)
    return doc_id, np.frombuffer(payload, f"<u{width}", offset=_OWN.size), at + 12 + size + 4 + 1


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, kind: str = "word", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode whole texts and write them as shards below ``path``, in ascending doc_id order."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, written = encoder(tokenizer, kind), 0
        chunk = 0
        for part in rows_of(batches):
            out = []
            ids = encode.encode(part.column(1).to_pylist())
            for doc_id, x in zip(part.column(0).to_pylist(), ids, strict=True):
                out.append((chunk, doc_id, frame(doc_id, np.append(x, encode.dtype.type(end_id)))))
                written += len(out[-1][2]) + 1
                if written >= shard_bytes:
                    chunk, written = chunk + 1, 0
            yield batch(_FRAMES, *(list(c) for c in zip(*out, strict=True)))

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    framed = ordered.mapInArrow(frames, "chunk int, doc_id long, frame binary").sortWithinPartitions("chunk", "doc_id")
    framed.select(F.col("frame").cast("string").alias("value"), "chunk").write.mode("overwrite").partitionBy("chunk").text(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def shard_name(path: str) -> str:
    """Folder and file of a shard."""
    return "/".join(path.split("/")[-2:])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the shards below ``path``, verified; the rows of the index."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows_of(batches, rows=1):
            shard, content = shard_name(part.column(0)[0].as_py()), part.column(1)[0].as_py()
            rows, at, before = [], 0, 0
            while at < len(content):
                doc_id, ids, after = parse(content, at)
                rows.append((shard, doc_id, at, after - at, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                at, before = after, before + len(ids)
            if rows:
                yield batch(_INDEX, *(list(c) for c in zip(*rows, strict=True)))

    return _shards(spark, path).mapInArrow(records, INDEX_SCHEMA)


def build_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Read the shards back and write the offset index as a Parquet table."""
    read_records(spark, path).write.mode("overwrite").parquet(index)
    return spark.read.schema(INDEX_SCHEMA).parquet(index)


def with_starts(index: DataFrame) -> DataFrame:
    """Adds ``start``, the number of ids in all records before each record.

    Running sums go over shards in blocks of 256 and over blocks, never over all documents."""
    number = F.regexp_extract("shard", r"part-(\d+)", 1).cast("long")
    chunk = F.regexp_extract("shard", r"chunk=(\d+)", 1).cast("long")
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    shards = shards.withColumn("block", F.floor(number / 256))
    blocks = shards.groupBy("block").agg(F.sum("total").alias("block_total"))
    blocks = blocks.select("block", (F.sum("block_total").over(Window.orderBy("block")) - F.col("block_total")).alias("block_start"))
    inside = Window.partitionBy("block").orderBy(number, chunk)
    shards = shards.join(blocks, "block").select("shard", (F.col("block_start") + F.sum("total").over(inside) - F.col("total")).alias("shard_start"))
    return index.join(shards, "shard").withColumn("start", F.col("shard_start") + F.col("before"))


def shuffled_read(spark: SparkSession, path: str, index: DataFrame, seed: int, partitions: int) -> DataFrame:
    """Documents and ids in a random order that the seed fixes.

    The offsets of a shard (a bounded number) travel to its content; records are then dealt and
    sorted by a seeded hash."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for part in rows_of(batches, rows=1):
            content = part.column(0)[0].as_py()
            got = [parse(content, at)[:2] for at in part.column(1)[0].as_py()]
            yield batch(schema, [d for d, _ in got], [x.astype(np.int32) for _, x in got])

    offsets = index.groupBy("shard").agg(F.collect_list("offset").alias("offsets"))
    shards = _shards(spark, path).withColumn("shard", F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")).join(offsets, "shard")
    key = F.xxhash64("doc_id", F.lit(seed))
    return (shards.select("content", "offsets").mapInArrow(decode, "doc_id long, ids array<int>")
            .repartition(partitions, key).sortWithinPartitions(key, "doc_id"))


def token_records(docs: DataFrame, tokenizer: str, end_id: int = 1, kind: str = "word") -> DataFrame:
    """Write, index and read back; one row per document: doc_id, start, n_tokens, ids_crc32, and
    where the record lies (shard, offset, n_bytes)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "op1")
    write_records(docs, scratch.path("shards"), tokenizer, end_id, kind)
    index = build_index(spark, scratch.path("shards"), scratch.path("index"))
    return with_starts(index).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", "n_bytes")
