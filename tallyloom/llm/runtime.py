"""What the operators of this subpackage share: shared storage, batch sizes and whole-table reads."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of all contracts: runs of anything but the six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch: texts of 100 KB are common, so rows alone do not bound a worker.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for workers of a few hundred MB, let workers import this package, and let them give freed memory back."""
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (home, env.get("PYTHONPATH"))))
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_ARENA_MAX", "2")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local one is made if all runs on this machine; else it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = getattr(spark, "_tallyloom_dir", None) or "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark._tallyloom_dir = path
    return path.rstrip("/")


#: Tables written since the outermost scratch() began, if one did.
_WRITTEN: list[DataFrame] = []
_DEPTH = 0


def materialize(df: DataFrame, name: str, keep: bool = False, codec: str = "snappy") -> DataFrame:
    """Write a table into the shared folder and read it back: the lineage ends there and lost executors cost nothing.

    It stays until discard(), or until the scratch() around ends unless `keep` is set. Spark deletes the shuffle files of the
    write once the driver's collector has found that nothing refers to them, so that one is asked to run.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyloom_path = path
    if _DEPTH and not keep:
        _WRITTEN.append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Delete, at the end, the tables that materialize() wrote within; results that read them must be written by then."""
    global _DEPTH
    _DEPTH += 1
    mark = len(_WRITTEN)
    try:
        yield
    finally:
        _DEPTH -= 1
        for table in _WRITTEN[mark:]:
            discard(table)
        del _WRITTEN[mark:]


def discard(df: DataFrame) -> None:
    """Delete a table of materialize() that no later plan reads."""
    path = getattr(df, "_tallyloom_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


_RESIDENT: dict[Hashable, Any] = {}


def release() -> None:
    """Drop what a worker process keeps from task to task, and give its memory back."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def resident(key: Hashable, make: Callable[[], Any]) -> Any:
    """A vocabulary with its memos, kept by a worker process until the next task of another kind: one at a time."""
    if key not in _RESIDENT:
        release()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The whole table, with the named columns only."""
    bounded_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def ids_and_text(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id as long and text as string, whatever other columns a table has."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
