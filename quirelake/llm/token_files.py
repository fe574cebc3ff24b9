"""Token ids as bit-packed blocks.

File format. The output is a Parquet table with a row for each block; a block
holds whole documents in ascending doc_id order and ends once it has BLOCK_IDS
ids or more (a longer document ends its block). Columns:

- shard, block: order of the blocks; shards are ranges of doc_id in order
- first_doc, last_doc: its least and largest doc_id that is not null; Parquet keeps their bounds for each group of rows,
  so a search for a document skips files and groups (ids_of)
- doc_ids: the documents of the block; ends: for each, the ids in the block up to its end
- bits: the width of an id, the least that holds the vocabulary
- payload: the ids, ``bits`` bits each, least significant bit first, without gaps

``ends`` and ``bits`` give any document's place: its ids are bits
``ends[i - 1] * bits`` to ``ends[i] * bits`` of the payload, which numpy
unpacks at once.

A null text counts as empty: it has the end id alone. Repeated doc_ids are
documents of their own, side by side in no fixed order, and may go over several
shards; a null doc_id comes first. Columns other than doc_id and text are not
read. An empty table makes an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import narrow, shuffle_partitions, table, vocabulary, written
from .wordcache import encoder

BLOCK_IDS = 1 << 16
SCHEMA = "shard int, block int, first_doc bigint, last_doc bigint, doc_ids array<bigint>, ends array<bigint>, bits int, payload binary"
SLICE = 1 << 15


def width(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids (unsigned 32-bit) in ``bits`` bits each; a multiple of 8 ids at a time, so that slices end at bytes."""
    parts = []
    for i in range(0, len(ids), SLICE):
        part = np.ascontiguousarray(ids[i : i + SLICE], dtype="<u4")
        each = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
        parts.append(np.packbits(each.ravel(), bitorder="little").tobytes())
    return b"".join(parts)


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a payload: only their bytes are touched."""
    parts = [np.zeros(0, "<u4")]
    raw = np.frombuffer(payload, np.uint8)
    for i in range(start, stop, SLICE):
        n = min(SLICE, stop - i)
        first = i * bits
        some = np.unpackbits(raw[first // 8 : -(-(first + n * bits) // 8)], bitorder="little")[first % 8 :][: n * bits].reshape(n, bits)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :bits] = some
        parts.append(np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(parts)


def write_ids(docs: DataFrame, path: str, end_id: int | None, name: str = "token-file") -> DataFrame:
    """Encodes docs (doc_id, text) and writes the table of blocks; returns it as read back."""
    docs = narrow(docs)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        e = encoder(path)
        bits = width(max(e.size, (end_id or 0) + 1))
        tail = b"" if end_id is None else end_id.to_bytes(4, "little")
        ids, ends, held, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            known = [i for i in ids if i is not None]
            row = [[shard], [block], known[:1] or [None], known[-1:] or [None], [ids], [ends], [bits], [pack(np.frombuffer(b"".join(held), "<u4"), bits)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()), strict=True)], ["shard", "block", "first_doc", "last_doc", "doc_ids", "ends", "bits", "payload"])

        for batch in batches:
            texts = batch.column("text")
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                got = e.encode(text := texts[i].as_py())
                if not i:
                    e.check(text)
                held.append(got + tail)
                n += len(held[-1]) // 4
                ids.append(doc_id)
                ends.append(n)
                if n >= BLOCK_IDS:
                    yield close()
                    block, ids, ends, held, n = block + 1, [], [], [], 0
        if ids:
            yield close()

    # A number for each row: an id that many rows have is cut into several ranges too.
    dealt = docs.withColumn("row", F.monotonically_increasing_id())
    ordered = dealt.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "row").sortWithinPartitions("doc_id", "row").drop("row")
    return written(ordered.mapInArrow(blocks, SCHEMA), name)


def read_ids(blocks: DataFrame) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), shard, block, first (ids of the block before it)."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts = [0, *row["ends"][:-1]]
                raw = unpack(row["payload"], row["bits"], 0, row["ends"][-1])
                ids = [raw[a:b].tobytes() for a, b in zip(starts, row["ends"], strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": pa.array(ids, pa.binary()), "shard": pa.array([row["shard"]] * n, pa.int32()), "block": pa.array([row["block"]] * n, pa.int32()), "first": pa.array(starts, pa.int64())})

    return blocks.mapInArrow(documents, "doc_id bigint, ids binary, shard int, block int, first bigint")


def ids_of(blocks: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the documents named, by random access: only blocks that can hold one are read, and of these only the bits of those documents.

    doc_ids is a list that a person asks for (each is a condition on the scan); join read_ids with a table of many.
    """
    asked = sorted(set(doc_ids))
    if not asked:
        return blocks.where("false").select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("ids"))
    inside = F.lit(False)
    for i in asked:
        inside |= (F.col("first_doc") <= i) & (F.col("last_doc") >= i)
    wanted = set(asked)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = [(i, a, b) for i, a, b in zip(row["doc_ids"], [0, *row["ends"][:-1]], row["ends"], strict=True) if i in wanted]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _, _ in at], pa.int64()), "ids": pa.array([unpack(row["payload"], row["bits"], a, b).tobytes() for _, a, b in at], pa.binary())})

    return blocks.where(inside).mapInArrow(documents, "doc_id bigint, ids binary")


def block_starts(blocks: DataFrame) -> DataFrame:
    """shard, block, before: the ids of all blocks before it. One sum for each shard goes through a single task, no row of a document."""
    sizes = blocks.select("shard", "block", F.element_at("ends", -1).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_before"))
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    return sizes.withColumn("inside", inside).join(shards, "shard").select("shard", "block", (F.col("shard_before") + F.col("inside")).alias("before"))


def op4_token_ids(spark: SparkSession, sf_dir: str, path: str | None = None, end_id: int = 2) -> DataFrame:
    blocks = write_ids(table(spark, sf_dir, "documents"), path or vocabulary("word_bpe_49k.json"), end_id)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.as_py() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("block"), batch.column("first"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "shard", "block", "first", "n_tokens", "ids_crc32"])

    found = read_ids(blocks).mapInArrow(digests, "doc_id bigint, shard int, block int, first bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(block_starts(blocks), ["shard", "block"]).select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
