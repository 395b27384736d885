"""Token-id files by plane shuffling.

A segment holds the ids of whole documents. Its ids are cut into blocks of a fixed size;
each block is transposed into byte planes (or bit planes), each plane is compressed by
zstandard, and a chunk index says how many ids and how many compressed bytes each plane
of each block has, so that any block can be read alone. Segments are rows of a Parquet
dataset whose narrow columns are the index over segments: Spark commits them, so they
can lie in any store, and a lost task writes its segments again.

Segment, little-endian: magic "QSPL", u8 version, u8 planes, u16 zero, u32 ids a block,
u32 blocks, u64 ids; for each block u32 ids and u32 compressed length per plane; planes.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import bpe
from quillstone.llm.common import id_texts, light, partitions, shared_dir, small_batches

MAGIC, VERSION, HEAD = b"QSPL", 1, struct.Struct("<4sBBHIIQ")
BLOCK_IDS, SEGMENT_IDS = 16_384, 1 << 18


def _planes(ids: np.ndarray, planes: int) -> list[bytes]:
    if planes == 4:
        return [p.tobytes() for p in ids.view(np.uint8).reshape(-1, 4).T]
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in bits.T]


def _joined(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], 1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], 1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def encode_segment(ids: np.ndarray, planes: int = 4, block_ids: int = BLOCK_IDS, level: int = 3) -> bytes:
    """ids as unsigned 32-bit; planes: 4 (byte planes) or 32 (bit planes)."""
    import zstandard

    if planes not in (4, 32):
        raise ValueError("planes must be 4 or 32")
    ids = np.ascontiguousarray(ids, "<u4")
    pack = zstandard.ZstdCompressor(level=level).compress
    index, body = [], []
    for lo in range(0, len(ids), block_ids):
        block = ids[lo : lo + block_ids]
        got = [pack(p) for p in _planes(block, planes)]
        index.append(struct.pack(f"<{1 + planes}I", len(block), *map(len, got)))
        body += got
    return b"".join([HEAD.pack(MAGIC, VERSION, planes, 0, block_ids, len(index), len(ids)), *index, *body])


def chunk_index(data: bytes) -> tuple[int, int, np.ndarray]:
    """(planes, ids a block, index): a row per block of ids, and compressed bytes of each plane."""
    magic, version, planes, _, block_ids, blocks, _ = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token segment")
    return planes, block_ids, np.frombuffer(data, "<u4", blocks * (1 + planes), HEAD.size).reshape(blocks, 1 + planes)


def decode_segment(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start..stop; only the blocks that hold them are read."""
    import zstandard

    planes, block_ids, index = chunk_index(data)
    total = int(index[:, 0].sum())
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return np.zeros(0, "<u4")
    sizes = index[:, 1:].astype(np.int64)
    at = HEAD.size + index.nbytes + np.r_[0, np.cumsum(sizes.ravel())]
    unpack = zstandard.ZstdDecompressor().decompress
    first, last = start // block_ids, (stop - 1) // block_ids
    view = memoryview(data)
    got = [_joined([unpack(view[at[k * planes + p] : at[k * planes + p + 1]]) for p in range(planes)], int(index[k, 0])) for k in range(first, last + 1)]
    return np.concatenate(got)[start - first * block_ids : stop - first * block_ids]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, planes: int = 4, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each text, appends end_id and writes segments in ascending id order to path.

    Null ids come first, equal ids in order of a hash of their texts, null texts count as empty;
    repeated rows are written each; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def write(batches):
        enc, end, shard = bpe.encoder(tokenizer_path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        ids, parts, at, seq = [], [], 0, 0
        for batch in light(batches, keeping=True):
            kind = batch.schema.field(0).type

            def segment():
                n = [len(p) // 4 for p in parts]
                data = encode_segment(np.frombuffer(b"".join(parts), "<u4"), planes)
                return pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([at], pa.int64()), pa.array([sum(n)], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([n], pa.list_(pa.int64())), pa.array([data], pa.binary())],
                    names=["shard", "seq", "shard_start", "n_ids", "doc_ids", "doc_n_ids", "segment"],
                )

            size = sum(map(len, parts)) // 4
            for i, t in zip(*id_texts(batch)):
                ids.append(i)
                parts.append(enc.encode(t) + end)
                size += len(parts[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield segment()
                    at, seq, size, ids, parts = at + size, seq + 1, 0, [], []
        if parts:
            yield segment()

    small_batches(docs.sparkSession)
    n = shards or partitions(docs.sparkSession)
    # rows of one id are split as well, by a hash of their texts; rows that repeat both, by any number
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("any"))
    rows = rows.repartitionByRange(n, "id", "h", "any").sortWithinPartitions("id", "h", "text").select("id", "text")
    out = rows.mapInArrow(write, f"shard int, seq int, shard_start long, n_ids long, doc_ids array<{kind}>, doc_n_ids array<long>, segment binary")
    out.write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, decoded from the files: id, start (ids of all documents before it), n_tokens, ids_crc32.

    The shards' totals, one row per shard, give each segment its place; segments are decoded alone.
    """
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    # as many rows as there are shards, whatever the number of documents
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = totals.select("shard", (F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))

    def decode(batches):
        for batch in light(batches):
            for base, ids, n, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                got = decode_segment(data).tobytes()
                ends = np.cumsum(np.array(n, np.int64))
                starts, view = ends - n, memoryview(got)
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field(1).type.value_type), pa.array(starts + base), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"]
                )

    rows = files.join(F.broadcast(before), "shard").select((F.coalesce("base", F.lit(0)) + F.col("shard_start")).alias("base"), "doc_ids", "doc_n_ids", "segment")
    return rows.mapInArrow(decode, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path, **options)
    return read_token_files(spark, path, options.get("id_col", "doc_id"))
