"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size of a table that is broadcast; above it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Text that a Python task turns into strings, and rows that it returns, at once.
SLICE_BYTES = 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named in ``spark.checkpoint.dir``; only where that is unset
    and driver and executors are one process (``local`` master, as in tests) a
    temporary folder is made and recorded there.  Elsewhere it must be set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for one run of an operator."""
    return f"{shared_folder(spark)}/gridloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path in the shared folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` and reads it back, which cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner find what finished steps no longer need, above all their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def tidy() -> None:
    """At the end of a Python task: gives memory that is free back to the system, as workers live on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], where: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in order, in slices of about ``most`` bytes of text in column ``where``; a longer text is one whole.

    A batch may be tens of MB; its strings and its results would be as much again,
    here and in the buffers of Spark that receive the results.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(where)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(ends)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield b.slice(low, high - low)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcasts ``df`` only when its counted size is within ``BROADCAST_BYTES``."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that ``decisions`` (id, kept: a row for each of ``docs``) keeps, with all columns.

    Rows that share an id, null included, are decided together: if one is kept,
    their distinct texts stay, once each.
    """
    spark = docs.sparkSession
    per_id = stored(decisions.groupBy(F.col(id_col).alias("wanted")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1"), scratch(spark, "decisions"))
    counts = per_id.groupBy("kept").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r.kept: r.n for r in counts}
    same = F.col(id_col).eqNullSafe(F.col("wanted"))
    out = docs.join(maybe_broadcast(per_id.select("wanted"), sum(n.values()), 48), same, "left_anti")
    if n.get(True):
        repeated = docs.join(maybe_broadcast(per_id.where("kept").select("wanted"), n[True], 48), same, "left_semi")
        out = out.unionByName(repeated.dropDuplicates([id_col, "text"]))
    return out


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``docs`` has already."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
