"""Token-id files: ids packed in the fewest bits the vocabulary needs, in blocks that can be opened anywhere.

A file set is a Parquet folder with one row per block. Documents are dealt by
ranges of their id, so part k holds smaller ids than part k + 1, and inside a
part blocks are numbered in order. A block holds whole documents:

====================  =========================================================
part, block           place of the block
first                 ids of the part before the block
n_ids, bits           ids in the block, and bits of each
doc_id, n_tokens      its documents in order, and how many ids each has
payload               the ids, each ``bits`` wide, lowest bit first, without gaps
====================  =========================================================

Id i of a block starts at bit ``i * bits`` of the payload, so any range is read
without the rest (``unpack``). The ids of all documents before a part are the
sum of the parts before it, which the block rows give without their payload.

Rules: null text is empty and holds the end id alone; null document ids come
first, rows of one id in the order of a hash of their text; an empty table gives
no block; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corridor_spark.llm.bpe import ChunkEncoder, kept
from corridor_spark.llm.common import parts, slices, texts

#: Distinct chunks whose ids a worker keeps, about 200 bytes each.
KEEP = 600_000
BLOCK = ("part int, block int, first long, n_ids long, bits int, doc_id array<long>, n_tokens array<long>, payload binary")


def width(vocabulary: int) -> int:
    """Fewest bits that hold the ids below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def vocabulary_size(tokenizer: str) -> int:
    """Ids that a tokenizer file can give: one more than its largest."""
    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) + 1


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids fill ``bits`` bytes; byte j of such a group is made of the ids whose bits it holds. Wider ids are refused."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit {bits} bits")
    group = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    group.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(group), bits), np.uint8)
    for j in range(bits):
        for k in range(8 * j // bits, min(7, (8 * j + 7) // bits) + 1):
            shift = 8 * j - k * bits
            part = group[:, k] >> np.uint64(shift) if shift >= 0 else group[:, k] << np.uint64(-shift)
            out[:, j] |= part.astype(np.uint8)
    return out.tobytes()


def unpack(payload: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """Ids ``first`` … ``first + count`` of a block; reads only the groups that hold them."""
    low, high = first // 8, -(-(first + count) // 8)
    group = np.frombuffer(payload, np.uint8, (high - low) * bits, low * bits).reshape(-1, bits)
    out = np.zeros((len(group), 8), np.uint64)
    for k in range(8):
        for j in range(k * bits // 8, (k * bits + bits - 1) // 8 + 1):
            shift = 8 * j - k * bits
            part = group[:, j].astype(np.uint64)
            out[:, k] |= part << np.uint64(shift) if shift >= 0 else part >> np.uint64(-shift)
    out &= np.uint64((1 << bits) - 1)
    return out.reshape(-1)[first - 8 * low :][:count].astype(np.uint32)


def write(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int | None, end_id: int, block_ids: int = 1 << 18,
          words: bool = True) -> None:
    """Encode every document, append ``end_id`` and write the blocks; a block is closed at ``block_ids`` ids.

    ``vocabulary`` is the tokenizer's own size where it is None; ids are below it.
    """
    bits = width(max(vocabulary_size(tokenizer) if vocabulary is None else vocabulary, end_id + 1))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept((tokenizer, "chunks"), lambda: ChunkEncoder(tokenizer, words, KEEP))
        part, block, first, held = TaskContext.get().partitionId(), 0, 0, []

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x[2] for x in held])
            row = [part, block, first, len(ids), bits, [d for x in held for d in x[0]], [n for x in held for n in x[1]], pack(ids, bits)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)],
                                              [c.split()[0] for c in BLOCK.split(", ")])

        for batch in slices(batches, 1_000_000):
            flat, size = encoder.encode(batch.column("text").to_pylist())
            ids = np.insert(flat, np.cumsum(size), end_id)
            held.append((batch.column("doc_id").to_pylist(), (size + 1).tolist(), ids))
            if (count := sum(len(x[2]) for x in held)) >= block_ids:
                yield close()
                block, first, held = block + 1, first + count, []
        if held:
            yield close()

    own = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_hash")]
    (own.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
        .mapInArrow(blocks, BLOCK).write.option("compression", "zstd").parquet(folder))


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with ``start``: the ids of all documents before the block."""
    blocks = spark.read.schema(BLOCK).parquet(folder)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (blocks.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # one row per written part, as many as shuffle partitions
               .select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset")))
    return blocks.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("first")).drop("offset")


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                size = np.array(block["n_tokens"], np.int64)
                ends = np.cumsum(size)
                ids = unpack(block["payload"], block["bits"], 0, block["n_ids"]).astype("<u4")
                raw = memoryview(ids.tobytes())
                spans = list(zip((ends - size).tolist(), ends.tolist()))
                columns = [pa.array(block["doc_id"], pa.int64()), pa.array(block["start"] + ends - size, pa.int64()),
                           pa.array(size, pa.int64()), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return read_blocks(spark, folder).select("start", "n_ids", "bits", "doc_id", "n_tokens", "payload").mapInArrow(
        rows, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def read_ids(spark: SparkSession, folder: str, first: int, count: int) -> DataFrame:
    """``position, id`` of the ids ``first`` … ``first + count`` of the whole set; opens only the blocks that hold them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                low = max(0, first - block["start"])
                high = min(block["n_ids"], first + count - block["start"])
                ids = unpack(block["payload"], block["bits"], low, high - low)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(low, high) + block["start"]), pa.array(ids.astype(np.int64))],
                                                 ["position", "id"])

    blocks = read_blocks(spark, folder).where((F.col("start") < first + count) & (F.col("start") + F.col("n_ids") > first))
    return blocks.select("start", "n_ids", "bits", "payload").mapInArrow(rows, "position long, id long")
