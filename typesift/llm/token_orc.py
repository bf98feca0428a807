"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters.

``write_token_orc`` puts one row per document into ORC files that Spark's own
writer commits: ids as an integer list (ORC's run-length encoding), rows in
ascending doc_id order within and across files, a row index every
``index_stride`` rows and a Bloom filter on doc_id.  Readers split files by
stripe, and a filter on doc_id skips stripes and row groups by the statistics
and the filters.  The ids of all documents before each file are written beside
them, so neither ``read_token_orc``, which gives the rows with their global
start, nor ``lookup`` has to read other files for it.

Definite results: null text is empty (end id only); rows with equal doc_id are
ordered by a hash of the text, then by the text; null doc_ids come first; an
empty table gives no rows; columns other than doc_id and text are ignored.
The range shuffle deals on (doc_id, text hash), so repeats of one id are split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typesift.llm import textbatch as tb
from typesift.llm.session import partitions, scratch_dir, shipped
from typesift.llm.tokens import encoder, vocabulary

END_ID = 0
INDEX_STRIDE = 1000
STRIPE_BYTES = 16 << 20

FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"
#: Folder beside the files (readers of the files pass over it): ids before each part.
BASES = "_bases"
BASES_SCHEMA = "part int, base long"


def _encode(path: str, keep_space: bool, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keep_space)
        part, before = TaskContext.get().partitionId(), 0
        for b in batches:
            doc_ids = b.column("doc_id")
            for lo, hi, _, block in tb.blocks(b.column("text")):
                ids, n = enc.encode(block)
                ids = np.insert(ids, np.cumsum(n), end_id) if len(n) else ids
                n = n + 1
                ends = np.concatenate(([0], np.cumsum(n)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(lo, hi - lo).cast(pa.int64()), pa.array(np.full(hi - lo, part, dtype=np.int32)),
                     pa.array(before + ends[:-1]), pa.array(n), lists],
                    names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
                before += int(ends[-1])

    return encode


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, keep_space: bool = True, end_id: int = END_ID,
                    n_files: int | None = None, index_stride: int = INDEX_STRIDE, stripe_bytes: int = STRIPE_BYTES) -> None:
    """Encode every whole text and write the files to the shared folder ``path``."""
    spark = shipped(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = (rows.repartitionByRange(n_files or partitions(spark), "doc_id", "h")
            .sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text"))
    (rows.mapInArrow(_encode(tokenizer_path, keep_space, end_id), FILE_SCHEMA)
     .write.format("orc").mode("overwrite")
     .option("compression", "zstd")
     .option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", "0.01")
     .option("orc.row.index.stride", str(index_stride))
     .option("orc.stripe.size", str(stripe_bytes))
     .save(path))
    # One small row per file written, so its size is bounded by n_files.
    totals = spark.read.schema(FILE_SCHEMA).orc(path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    bases.coalesce(1).write.mode("overwrite").orc(f"{path}/{BASES}")


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    bases = spark.read.schema(BASES_SCHEMA).orc(f"{path}/{BASES}")  # one small row per file
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; statistics and Bloom filters skip other row groups."""
    return read_token_orc(spark, path).where(F.col("doc_id").isin(list(doc_ids)))


def crc32_of_ids(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Replace column ids by ids_crc32: CRC-32 of the ids as little-endian uint32."""
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            flat = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            at = lists.offsets.to_numpy().tolist()
            sums = [zlib.crc32(flat[4 * s:4 * e]) for s, e in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sums, pa.int64())],
                                             names=[*keep, "ids_crc32"])

    shipped(rows.sparkSession)
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", ids_crc32 bigint"
    return rows.select(*keep, "ids").mapInArrow(crc, schema)


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = scratch_dir(spark, "token-orc")
    write_token_orc(docs, path, vocabulary("byte_bpe_50k.json"))
    return crc32_of_ids(read_token_orc(spark, path), ["doc_id", "start", "n_tokens"])
