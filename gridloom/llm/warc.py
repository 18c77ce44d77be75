"""Deterministic sharded WARC files.

Records are sorted by (id, digest, url) over ranges of equal payload bytes; where a
range ends follows from running sums over all records, not from a sample.  A task
writes ranges, compresses each record as a gzip member of its own, rolls to the
next file when the compressed size passes the limit, writes under a temporary name
and renames at the end; names and contents depend on the records and parameters
alone, whatever the partitions, so a repeated task or run writes the same files.
Only files named in the manifest belong to the archive.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import maybe_broadcast, remove, scratch, stored

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = T.StructType([T.StructField("file", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType()), T.StructField("sha256", T.StringType())])


def record_id(page_id: int | None) -> str:
    """A version-8 UUID that holds the id, so that it can be read back."""
    n = 0 if page_id is None else page_id & (1 << 64) - 1
    bits = (n >> 16) << 80 | 8 << 76 | (page_id is None) << 64 | 2 << 62 | (n & 0xFFFF)
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def page_of(record: str) -> int | None:
    bits = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if bits >> 64 & 1:
        return None
    n = (bits >> 80) << 16 | bits & 0xFFFF
    return n - (1 << 64) if n >> 63 else n


def clean(url: str | None) -> str:
    """A header value cannot hold line ends."""
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url or "about:blank")


def record(page_id: int | None, url: str | None, payload: bytes, revisit_of: tuple[int | None] | None, digest: str) -> bytes:
    """One record with its headers; a revisit has the headers of the response and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit_of else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit_of else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit_of:
        lines[-2:-2] = [f"WARC-Refers-To: {record_id(revisit_of[0])}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def range_starts(keyed: DataFrame, range_bytes: int, folder: str, part_rows: int = 500_000) -> list[tuple]:
    """The least (has id, id, digest, url) of each range of about ``range_bytes`` of payload, one tuple for each range.

    Distinct keys are sorted, and bytes are summed up along the order: within
    the sorted partitions, and over the partitions by their sums.  Only sums, one
    a partition, and the starts reach the driver.
    """
    key = [F.col("page_id").isNotNull().alias("has"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "digest", F.coalesce("url", F.lit("")).alias("url")]
    keys = stored(keyed.select(*key, "size").groupBy("has", "page_id", "digest", "url").agg(F.sum(F.col("size") + 1).alias("size")), f"{folder}/_keys")
    n, total = keys.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n or total <= range_bytes:
        return []
    order = ["has", "page_id", "digest", "url"]
    placed = keys.repartitionByRange(-(-n // part_rows), *order).withColumn("part", F.spark_partition_id())
    placed = stored(placed, f"{folder}/_sorted")
    sums = sorted((r.part, r.size) for r in placed.groupBy("part").agg(F.sum("size").alias("size")).collect())
    before = dict(zip((p for p, _ in sums), np.cumsum([0, *(s for _, s in sums)]).tolist(), strict=False))
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("part")]
    along = F.sum("size").over(Window.partitionBy("part").orderBy(*order)) - F.col("size") + offset
    starts = placed.withColumn("range", F.floor(along / range_bytes)).groupBy("range").agg(F.min(F.struct(*order)).alias("start")).collect()
    return sorted(tuple(r.start) for r in starts)


def write(pages: DataFrame, folder: str, roll_bytes: int = 256 << 20, range_bytes: int = 64 << 20, min_payload: int = 100, level: int = 6) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC files into ``folder``; returns the manifest.

    Of rows with equal payloads of ``min_payload`` bytes or more the one with the
    smallest page_id is a response, the others are revisits of it; all smaller
    ones are responses.  A null html is an empty payload, a null url is
    about:blank, a null page_id sorts first and counts as the largest when a
    response is chosen.  Rows that repeat a page_id are all written; rows that
    are equal throughout are in one range.  Other columns are not read.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    keyed = rows.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size"))
    groups = keyed.where(F.col("size") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    groups = stored(groups, f"{folder}/_groups")
    shared = groups.where("n > 1").select("digest", "first")
    shared = maybe_broadcast(shared, shared.count(), 160)
    keyed = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), "payload").join(shared, "digest", "left")
    own = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")) | (F.octet_length("payload") < min_payload)
    # copies of a repeated page_id that holds the first payload: all are written as responses
    records = keyed.select("page_id", "url", "payload", "digest", F.when(~own, F.col("first")).alias("refers_to"))
    url = F.coalesce("url", F.lit(""))
    starts = range_starts(rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size")), range_bytes, folder)
    sent = spark.sparkContext.broadcast(starts)  # a short tuple for each range

    @F.pandas_udf("int")
    def range_of(page: pd.Series, has: pd.Series, digest: pd.Series, url: pd.Series) -> pd.Series:
        starts = sent.value
        ids = np.array([x[1] if x[0] else np.iinfo(np.int64).min for x in starts], np.int64)
        own = np.where(has.to_numpy(bool), page.to_numpy(np.int64), np.iinfo(np.int64).min)
        first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        out = first - 1
        for k in np.flatnonzero(first < last).tolist():  # a range begins within this id
            out[k] = bisect.bisect_right(starts, (bool(has[k]), int(page[k]), digest[k], url[k])) - 1
        return pd.Series(np.maximum(out, 0).astype(np.int32))

    if starts:
        place = range_of(F.coalesce("page_id", F.lit(0)), F.col("page_id").isNotNull(), "digest", url)
        records = records.withColumn("range", place).repartitionById(len(starts), F.col("range"))
    else:
        records = records.withColumn("range", F.lit(0)).coalesce(1)
    records = records.sortWithinPartitions("range", F.col("page_id").isNotNull(), "page_id", "digest", url)

    def run(batches):
        attempt = TaskContext.get().taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(f"{root}/_temporary/{attempt}", recursive=True)
        out, sink, number, now = [], None, 0, None

        def close():
            nonlocal sink, number
            sink.close()
            name = f"part-{now:06d}-{number:04d}.warc.gz"
            fs.move(temp, f"{root}/{name}")
            out.append((name, size, count, sha.hexdigest()))
            sink, number = None, number + 1

        for b in batches:
            for page, url, payload, digest, first, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != now:
                    if sink is not None:
                        close()
                    now, number = part, 0
                if sink is None:
                    temp, size, count, sha = f"{root}/_temporary/{attempt}/{number:04d}", 0, 0, hashlib.sha256()
                    sink = fs.open_output_stream(temp)
                member = gzip.compress(record(page, url, payload, None if first is None else (first,), digest), level, mtime=0)
                sink.write(member)
                sha.update(member)
                size, count = size + len(member), count + 1
                if size >= roll_bytes:
                    close()
        if sink is not None:
            close()
        fs.delete_dir(f"{root}/_temporary/{attempt}")
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], MANIFEST.names)

    manifest = stored(records.mapInArrow(run, MANIFEST), f"{folder}/_manifest")
    for done in ("_groups", "_keys", "_sorted", "_temporary"):
        remove(spark, f"{folder}/{done}")
    return manifest


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def members(stream, chunk: int = 1 << 20):
    """The gzip members of a stream, decompressed one at a time."""
    data = stream.read(chunk)
    while data:
        unzip, parts = zlib.decompressobj(31), []
        while True:
            parts.append(unzip.decompress(data))
            if unzip.eof:
                data = unzip.unused_data or stream.read(chunk)
                break
            data = stream.read(chunk)
            if not data:
                raise OSError("a WARC file ends within a record")
        yield b"".join(parts)


def parse(data: bytes) -> tuple:
    """Columns of READ from one record; wrong digests and lengths are errors."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise OSError(f"record {fields['WARC-Record-ID']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise OSError(f"the payload of record {fields['WARC-Record-ID']} is damaged")
    first = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], length, digest, kind, first, payload if kind == "response" else None


def read(folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the files in the manifest; a file whose number of records differs is an error."""
    names = [x.split()[0] for x in READ.split(", ")][: None if payloads else -1]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    count, rows, held = 0, [], 0
                    for data in members(stream):
                        rows.append(parse(data)[: len(names)])
                        count, held = count + 1, held + (len(data) if payloads else 0)
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    if count != expected:
                        raise OSError(f"{name} has {count} records, its manifest {expected}")

    files = manifest.select("file", "records")
    tasks = max(1, files.count())  # a file each
    return files.repartition(tasks).mapInArrow(run, ", ".join(READ.split(", ")[: len(names)]))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archive and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = folder or scratch(pages.sparkSession, "warc")
    manifest = write(pages, folder)
    return read(folder, manifest, payloads=False).drop("url")
