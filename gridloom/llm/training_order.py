"""Token ids in training order, as binary shards.

Each task reads its documents as one stream of ids and cuts it into sequences.
Sequences are numbered without gaps, a keyed Feistel permutation with cycle
walking gives each number its slot, and every range of slots is one shard: a
file of records of equal length, so slot s of a shard is at s times the stride,
and reading can begin anywhere.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import byte_bpe
from .common import release, remove, scratch, tidy

MANIFEST = "shard long, file string, first_slot long, sequences long, bytes long, sha256 string"
#: Least number of shards in a wave, so that each has work for several executors.
WAVE_SHARDS = 4


class Feistel:
    """A keyed permutation of 0 .. n-1."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n, self.half = n, max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little")) for r in range(rounds)]

    def once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in self.keys:
            h = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((h >> np.uint64(29)) & self.mask)
        return left << np.uint64(self.half) | right

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        """Slots of sequence numbers; what falls outside walks on along its cycle."""
        out = self.once(numbers.astype(np.uint64))
        while len(far := np.flatnonzero(out >= np.uint64(self.n))):
            out[far] = self.once(out[far])
        return out.astype(np.int64)


def write(docs: DataFrame, vocabulary: str, folder: str, sequence: int = 1024, key: int = 1, end_id: int = 0, shard_bytes: int = 64 << 20, waves: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards and their index into ``folder``; returns the manifest.

    A document is its ids and then ``end_id``; null and empty texts are that id
    alone.  The last sequence of a task's stream is filled with ``end_id``.  Rows
    that repeat an id are separate documents; ids of any type, null included, and
    no other column are kept in the index.  Token ids are little-endian, 16 bits wide if the vocabulary allows it.  An empty table
    has no shard.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(byte_bpe.file_bytes(vocabulary))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType
    id_lists = pa.list_(to_arrow_type(id_type))

    def cut(batches):
        bpe = byte_bpe.load(vocabulary, shared.value)
        task = TaskContext.get().partitionId()
        width = "<u2" if len(bpe.token) <= 1 << 16 else "<u4"
        made, held, parts, spans = 0, 0, [], []
        rows = []

        def close(n):
            nonlocal made, held, parts, spans
            ids = b"".join(parts)
            if n < sequence:
                ids += np.full(sequence - n, end_id, width).tobytes()
            rows.append((made, n, ids, [s[0] for s in spans], [s[1] for s in spans], [s[2] for s in spans]))
            made, held, parts, spans = made + 1, 0, [], []

        def out():
            columns = list(zip(*rows, strict=True))
            rows.clear()
            tasks = pa.array([task] * len(columns[0]), pa.int64())
            return pa.RecordBatch.from_arrays([tasks, *(pa.array(c, pa.int64()) for c in columns[:2]), pa.array(columns[2], pa.binary()), pa.array(columns[3], id_lists), *(pa.array(c, pa.list_(pa.int64())) for c in columns[4:])], ["task", "number", "n_tokens", "ids", "doc_ids", "offsets", "starts"])

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), bpe.encode(t or "" for t in b.column(1).to_pylist()), strict=True):
                ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)).astype(width)
                at = 0
                while at < len(ids):
                    n = min(len(ids) - at, sequence - held)
                    parts.append(ids[at : at + n].tobytes())
                    spans.append((doc, held, at))
                    at, held = at + n, held + n
                    if held == sequence:
                        close(sequence)
            if rows:
                yield out()
        if held:
            close(held)
            yield out()
        tidy()

    # Encoded once: the numbers of sequences are known only when all tasks are done, and their slots depend on them.
    kept = f"{folder}/_sequences"
    sequences = rows.mapInArrow(cut, f"task long, number long, n_tokens long, ids binary, doc_ids array<{id_type.simpleString()}>, offsets array<long>, starts array<long>")
    sequences.write.mode("overwrite").option("compression", "zstd").parquet(kept)
    sequences = spark.read.schema(sequences.schema).parquet(kept)
    sizes = sequences.groupBy("task").agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect()  # a number for each task
    tasks, counts = np.array([r.task for r in sizes], np.int64), np.array([r.n for r in sizes], np.int64)
    total, firsts = int(counts.sum()), np.cumsum(counts) - counts
    per_shard = max(1, shard_bytes // (4 * sequence))
    shards = max(1, -(-total // per_shard))
    order = Feistel(total, key)
    plan = spark.sparkContext.broadcast((tasks, firsts))

    @F.pandas_udf("long")
    def slot(task: pd.Series, number: pd.Series) -> pd.Series:
        known, first = plan.value
        return pd.Series(order.slots(first[np.searchsorted(known, task.to_numpy())] + number.to_numpy()))

    # Shards are written in waves of ranges, so only one wave's shuffle files take up disk; a wave's sequences go when its shards are there.
    waves = max(1, min(waves, shards // WAVE_SHARDS))
    bounds = [shards * k // waves for k in range(waves + 1)]
    placed = sequences.withColumn("slot", slot("task", "number")).drop("task", "number")
    placed = placed.withColumn("shard", F.floor(F.col("slot") / per_shard))
    placed = placed.withColumn("wave", sum((F.col("shard") >= b).cast("int") for b in bounds[1:-1]) if waves > 1 else F.lit(0))
    placed.write.mode("overwrite").option("compression", "zstd").partitionBy("wave").parquet(f"{folder}/_placed")
    remove(spark, kept)
    columns = placed.drop("wave").schema

    def save(batches):
        attempt = TaskContext.get().taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(f"{root}/_temporary/{attempt}", recursive=True)
        now, out = None, []

        def close():
            data.close()
            index.close()
            for end in ("bin", "index.parquet"):
                fs.move(f"{temp}.{end}", f"{root}/shard-{now:07d}.{end}")
            out.append((now, f"shard-{now:07d}", now * per_shard, count, size, sha.hexdigest()))

        for b in batches:
            ids, shard = b.column("ids").to_pylist(), b.column("shard").to_numpy()
            side = pa.Table.from_batches([b]).select(["slot", "n_tokens", "doc_ids", "offsets", "starts"])
            for s in np.unique(shard).tolist():
                where = np.flatnonzero(shard == s)
                if s != now:
                    if now is not None:
                        close()
                    now, count, size, sha, temp = s, 0, 0, hashlib.sha256(), f"{root}/_temporary/{attempt}/{s}"
                    data = fs.open_output_stream(f"{temp}.bin")
                    index = pq.ParquetWriter(fs.open_output_stream(f"{temp}.index.parquet"), side.schema)
                block = b"".join(ids[where[0] : where[-1] + 1])
                data.write(block)
                sha.update(block)
                index.write_table(side.slice(where[0], len(where)))
                count, size = count + len(where), size + len(block)
        if now is not None:
            close()
        fs.delete_dir(f"{root}/_temporary/{attempt}")
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    for k in range(waves if total else 0):
        lo, hi = bounds[k], bounds[k + 1]
        wave = spark.read.schema(columns).parquet(f"{folder}/_placed/wave={k}")
        wave = wave.repartitionById(hi - lo, (F.col("shard") - lo).cast("int")).sortWithinPartitions("shard", "slot")
        wave.mapInArrow(save, MANIFEST).write.mode("append" if k else "overwrite").parquet(f"{folder}/_manifest")
        del wave
        remove(spark, f"{folder}/_placed/wave={k}")
        release(spark)
    remove(spark, f"{folder}/_placed")
    if not total:
        spark.createDataFrame([], MANIFEST).write.mode("overwrite").parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read(folder: str, manifest: DataFrame, sequence: int = 1024, first_slot: int = 0, end_slot: int | None = None, id_type: str = "long") -> DataFrame:
    """Sequences of a range of slots: slot, shard, n_tokens, ids (with padding), doc_ids (of ``id_type``), offsets, starts.

    A shard is entered at the stride of the first slot that is wanted.  A shard
    whose size isn't that of its records is an error.
    """
    wanted = manifest.where((F.col("first_slot") + F.col("sequences") > first_slot) & (F.lit(True) if end_slot is None else F.col("first_slot") < end_slot))

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for shard, name, first, count, size in zip(*(b.column(c).to_pylist() for c in ("shard", "file", "first_slot", "sequences", "bytes")), strict=True):
                stride = size // count
                a, z = max(0, first_slot - first), count if end_slot is None else min(count, end_slot - first)
                with fs.open_input_file(f"{root}/{name}.bin") as f:
                    if f.size() != stride * count or stride % sequence:
                        raise OSError(f"{name} has {f.size()} bytes")
                    with fs.open_input_file(f"{root}/{name}.index.parquet") as g:
                        index = pq.read_table(g).slice(a, z - a)
                    for at in range(0, z - a, 4096):
                        part = index.slice(at, 4096)
                        f.seek((a + at) * stride)
                        data = f.read(len(part) * stride)
                        ids = [data[k * stride : (k + 1) * stride] for k in range(len(part))]
                        yield pa.RecordBatch.from_arrays([part.column("slot").combine_chunks(), pa.array([shard] * len(part), pa.int64()), part.column("n_tokens").combine_chunks(), pa.array(ids, pa.binary()), *(part.column(c).combine_chunks() for c in ("doc_ids", "offsets", "starts"))], ["slot", "shard", "n_tokens", "ids", "doc_ids", "offsets", "starts"])

    tasks = max(1, manifest.count())  # a shard each
    return wanted.repartition(tasks).mapInArrow(run, f"slot long, shard long, n_tokens long, ids binary, doc_ids array<{id_type}>, offsets array<long>, starts array<long>")


def digest(sequences: DataFrame, sequence: int = 1024) -> DataFrame:
    """slot, shard, n_tokens, doc_ids, offsets, starts and ids_crc32 (of the real ids, as stored)."""

    def run(batches):
        for b in batches:
            crc = [zlib.crc32(x[: len(x) // sequence * n]) for x, n in zip(b.column("ids").to_pylist(), b.column("n_tokens").to_pylist(), strict=True)]
            keep = ["slot", "shard", "n_tokens", "doc_ids", "offsets", "starts"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(crc, pa.int64())], [*keep, "ids_crc32"])

    kind = sequences.schema["doc_ids"].dataType.simpleString()
    return sequences.mapInArrow(run, f"slot long, shard long, n_tokens long, doc_ids {kind}, offsets array<long>, starts array<long>, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, sequence: int = 1024, key: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Writes shards into the shared folder and reads them all back as ``digest`` gives them."""
    folder = scratch(docs.sparkSession, "training-order")
    manifest = write(docs, vocabulary, folder, sequence, key, id_col=id_col)
    return digest(read(folder, manifest, sequence, id_type=docs.schema[id_col].dataType.simpleString()), sequence)
