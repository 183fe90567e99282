"""Token-id files: texts to ids in ascending doc_id order, in coded blocks, and back.

A set of files is a Parquet table in which each row is one block: the shard (an interval of doc_ids, in order), the
block's number in it, the doc_ids and lengths of the documents it holds whole, and the coded ids (rangecoder). Blocks
are reset and checksummed one by one, so any of them can be read alone and a lost task is a few blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import modest_batches, scratch
from .rangecoder import decode_block, encode_block
from .textbytes import slices
from .tokens import encoder, vocabulary

END = 2
BLOCK_TOKENS = 1 << 20
BLOCKS = "shard int, block int, doc_ids array<long>, lengths array<long>, n_tokens long, ids binary"


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str | None = None, end_id: int = END, block_tokens: int = BLOCK_TOKENS, spaces_matter: bool = True, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every row's whole text (null: empty), appends end_id and writes the files at path.

    Documents are in ascending doc_id order, null ids first, equal ids by text. Texts are shuffled once, by ranges of doc_id.
    Other columns are ignored; an empty table gives files without blocks.
    """
    spark = docs.sparkSession
    vocab = vocabulary_path or vocabulary("byte_bpe_50k.json")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, block = encoder(vocab, spaces_matter), TaskContext.get().partitionId(), 0
        names: list = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([encode_block(ids)], pa.binary())],
                names=["shard", "block", "doc_ids", "lengths", "n_tokens", "ids"],
            )

        for batch in batches:
            for part in slices(batch, 1, 400_000):
                flat, n = enc.encode(part.column(1))
                for name, ids in zip(part.column(0).to_pylist(), np.split(flat, np.cumsum(n)[:-1]), strict=True):
                    names.append(name)
                    sizes.append(len(ids) + 1)
                    held += [ids, np.array([end_id], np.uint32)]
                    total += len(ids) + 1
                    if total >= block_tokens:
                        yield flush()
                        names, sizes, held, total, block = [], [], [], 0, block + 1
        if names:
            yield flush()

    rows = modest_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(coded, BLOCKS).write.parquet(path)


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document of the files: doc_id, shard, block, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids = decode_block(batch.column("ids")[k].as_py()).astype("<u4")
                n = np.array(batch.column("lengths")[k].as_py(), np.int64)
                to = np.cumsum(n)
                crc = [zlib.crc32(ids[b - m : b].tobytes()) for b, m in zip(to.tolist(), n.tolist(), strict=True)]
                same = lambda c, m=len(n), k=k, batch=batch: pa.array(np.full(m, batch.column(c)[k].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[k].values, same("shard"), same("block"), pa.array(to - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "shard", "block", "before", "n_tokens", "ids_crc32"])

    docs = blocks.mapInArrow(decoded, "doc_id long, shard int, block int, before long, n_tokens long, ids_crc32 long")
    heads = blocks.select("shard", "block", "n_tokens")
    shards = heads.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row per shard, as many as there were tasks
    ahead = shards.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("ahead"))
    own = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = heads.join(ahead, "shard").select("shard", "block", (F.col("ahead") + F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("first"))
    return docs.join(starts, ["shard", "block"]).select("doc_id", "shard", "block", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op2_tokenfiles(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
