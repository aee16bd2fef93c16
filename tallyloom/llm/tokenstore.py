"""Token ids in ORC files, in the order of document ids.

Ids are a list column with ORC's integer run-length encoding. Files hold ranges of document ids, stripes are read
in parallel, and each file has row indexes and Bloom filters on doc_id, so a look-up reads few stripes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .library import library_coder
from .runtime import ids_and_text, materialize

STORED = "part int, doc_id long, at long, ids array<int>"
STRIPE_BYTES, INDEX_ROWS, FALSE_POSITIVES = 16 << 20, 1000, 0.01


def id_lists(chunks: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit ids of several documents as one Arrow column."""
    ends = np.cumsum([0, *(len(c) // 4 for c in chunks)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(chunks), "<i4")))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode every text, append end_id, and write ORC files in ascending doc_id order (equal ids by a hash of the text).

    Null texts count as empty; a null doc_id comes first. Each row has `part`, the number of its file's range, and `at`, the ids
    of the same part before it. The range shuffle moves texts, which are smaller than their ids.
    """
    rows = ids_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        coder, part, at = library_coder(tokenizer_path), TaskContext.get().partitionId(), 0
        for b in batches:
            chunks = [coder.ids(t or "") + end for t in b.column(1).to_pylist()]
            sizes = np.array([len(c) // 4 for c in chunks], np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(chunks), part, np.int32)), b.column(0), pa.array(starts), id_lists(chunks)], names=["part", "doc_id", "at", "ids"]
            )

    options = {
        "compression": "none",  # run-length encoding has packed the ids; a codec on top costs time and gains little
        "orc.stripe.size": STRIPE_BYTES,
        "orc.create.index": "true",
        "orc.row.index.stride": INDEX_ROWS,
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": FALSE_POSITIVES,
    }
    rows.mapInArrow(run, STORED).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """part, doc_id, at, ids; with doc_ids only those documents, found by statistics, indexes and Bloom filters."""
    stored = spark.read.schema(STORED).orc(path)
    return stored if doc_ids is None else stored.where(F.col("doc_id").isin(doc_ids))


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every stored document, from the files.

    An empty store gives an empty table.
    """

    def run(batches):
        for b in batches:
            ids = b.column(3)
            ends, data = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"]
            )

    rows = materialize(read_tokens(spark, path).mapInArrow(run, "part int, doc_id long, at long, n_tokens long, ids_crc32 long"), "stored")
    # one row for each file: few, whatever the number of documents
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(parts, "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
