"""Similarity join on word n-grams: MinHash banding, then exact Jaccard.

Documents with the same words are one class and take part once.  Bands and rows
are the ones with the most rows whose recall at the threshold reaches the
target.  Classes that meet in a band are candidates; the candidates' components
bound where links can be, and inside them the full n-gram sets are compared with
matrix products, block against block, so no row per pair is ever made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, scratch, stored, tidy
from .components import components

WORDS_KEPT = 500_000
#: Members, and n-grams, of a block; larger components are compared block against block.
BLOCK_MEMBERS, BLOCK_GRAMS = 512, 1_500_000
COLUMNS = 2048
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def bands_and_rows(similarity: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """The most rows per band, and the bands they need, such that a pair of the given similarity shares a band with probability ``recall``."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def grams(text: str | None, words: Words, n: int) -> tuple[bytes, np.ndarray]:
    """Digest of the words, and hashes of their n-grams with repeats; a text of fewer words is one n-gram, an empty text none."""
    own = (text or "").encode().lower().split()
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    digest = xxhash.xxh3_128_digest(h.tobytes())
    if not len(h):
        return digest, h
    width = min(n, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total = mix(total * MULTIPLIERS[k % 5] + h[k : len(h) - width + 1 + k])
    return digest, total


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64)[:, None]

    def band_hashes(self, h: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, 2**64 - 1, np.uint64)
        for at in range(0, len(h), 1024):
            least = np.minimum(least, (h[None, at : at + 1024] * self.a + self.b).min(1))
        own = np.zeros(self.bands, np.uint64)
        for column in least.reshape(self.bands, self.rows).T:
            own = mix(own * np.uint64(0x9E3779B97F4A7C15) + column)
        return own.view(np.int64)


def links_in_block(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """Whether left[i] and right[j] (positions in sets) are different and have that Jaccard similarity."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts > 1
    column = np.cumsum(common) - 1
    owner = np.repeat(np.arange(len(sets)), size)
    keep = common[number]
    owner, number = owner[keep], column[number[keep]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    cuts = np.searchsorted(number, np.arange(0, (number[-1] if len(number) else -1) + 1 + COLUMNS, COLUMNS))
    for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[owner[a:b], number[a:b] - c * COLUMNS] = 1
        used = grid[left]
        shared += used @ (used.T if left is right else grid[right].T)
    either = size[left][:, None] + size[right][None, :] - shared
    linked = shared >= similarity * either - 1e-6
    linked &= left[:, None] != right[None, :]
    return linked


def near_duplicates(docs: DataFrame, similarity: float = 0.8, n: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, class_id, n_links, copies, kept.

    Words are runs of anything but ASCII white space, A-Z in lower case; texts
    with the same words are ``copies`` (their number, this row included) and are
    similar by definition, also null and empty ones.  ``n_links`` counts the
    other rows whose sets of n-grams have at least the given Jaccard similarity,
    copies included.  ``class_id`` is the least id of the rows that are
    connected by links, null only if all are null; ``kept`` marks one row of
    each class, the one with that id.  Rows with equal ids are separate rows.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "ngram")
    bands, rows = bands_and_rows(similarity, recall)
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def sign(batches):
        words, minhash = Words(), MinHash(bands, rows)
        for b in batches:
            digests, own = [], []
            for t in b.column(1).to_pylist():
                d, h = grams(t, words, n)
                digests.append(d)
                own.append(minhash.band_hashes(h) if len(h) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(own, pa.list_(pa.int64()))], ["id", "digest", "bands"])
        words.clear()
        tidy()

    signed = base.mapInArrow(sign, f"id {kind.simpleString()}, digest binary, bands array<long>")
    signed = stored(signed.withColumn("rid", F.monotonically_increasing_id()), f"{folder}/signed")

    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))).alias("best")
    classes = stored(signed.groupBy("digest").agg(best, F.count(F.lit(1)).alias("copies")).select("digest", "best.id", "best.rid", "copies"), f"{folder}/classes")
    banded = signed.join(classes.select("rid"), "rid", "left_semi").select("rid", F.posexplode("bands").alias("band", "hash"))
    buckets = banded.groupBy("band", "hash").agg(F.min("rid").alias("root"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hash", "root")
    # an edge from each class to the least of the first classes of its buckets, and from the other first ones to that
    met = banded.join(buckets, ["band", "hash"]).groupBy(F.col("rid").alias("a")).agg(F.min("root").alias("b"), F.collect_set("root").alias("roots"))
    candidates = met.select("b", F.explode(F.array_union(F.array("a"), "roots")).alias("a")).where("a <> b")
    clusters = components(candidates, f"{folder}/candidates").withColumnsRenamed({"node": "rid", "root": "cluster"})
    members = stored(clusters.join(classes, "rid"), f"{folder}/members")

    def collect_sets(batches):
        words = Words()
        for b in batches:
            both = [(d, np.unique(h)) for d, h in (grams(t, words, n) for t in b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in both], pa.binary()), pa.array([len(x[1]) for x in both], pa.int64()), pa.array([x[1].tobytes() for x in both], pa.binary())], ["digest", "grams", "set"])
        words.clear()
        tidy()

    ids = members.select(F.col("id").alias("wanted")).distinct()
    ids = maybe_broadcast(ids, members.count(), 64)
    texts = base.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    sets = texts.mapInArrow(collect_sets, "digest binary, grams long, set binary")
    sets = stored(members.select("digest", "rid", "cluster", "copies").join(sets, "digest").dropDuplicates(["rid"]).drop("digest"), f"{folder}/sets")

    sizes = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("grams").alias("grams"))
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_MEMBERS, F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks")
    sizes = stored(sizes.where("m > 1").select("cluster", blocks), f"{folder}/sizes")
    several = not sizes.where("blocks > 1").isEmpty()
    placed = sets.join(maybe_broadcast(sizes, sizes.count(), 32), "cluster").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rid", "copies", "set")

    def compare(key, group):
        _, i, j = (x.as_py() for x in key)
        rid, copies = group.column("rid").to_numpy(), group.column("copies").to_numpy()
        own = group.column("own").to_numpy()
        members_ = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        if not len(left) or not len(right):
            return pa.table({"rid": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        linked = links_in_block(members_, left, right, similarity)
        links = np.zeros(len(rid), np.int64)
        links[left] = linked @ copies[right]
        if i != j:
            links[right] = copies[left] @ linked
        label = rid.copy()
        while True:  # least id that links lead to, within this block
            most = np.iinfo(np.int64).max
            before = label.copy()
            label[left] = np.minimum(label[left], np.where(linked, label[right][None, :], most).min(1))
            label[right] = np.minimum(label[right], np.where(linked, label[left][:, None], most).min(0))
            if (label == before).all():
                break
        has = links > 0
        return pa.table({"rid": pa.array(rid[has]), "root": pa.array(label[has]), "links": pa.array(links[has])})

    found = stored(placed.groupBy("cluster", "i", "j").applyInArrow(compare, "rid long, root long, links long"), f"{folder}/found")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")), f"{folder}/linked").withColumnRenamed("node", "rid") if several else found.select("rid", "root").distinct()
    joined = classes.join(links.join(roots, "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    joined = stored(joined.select("digest", "id", "rid", "copies", F.coalesce("links", F.lit(0)).alias("links"), "root"), f"{folder}/joined")
    heads = joined.groupBy("root").agg(best).select("root", F.col("best.id").alias("class_id"), F.col("best.rid").alias("keep_rid"))
    per_class = joined.join(heads, "root").select("digest", "class_id", "keep_rid", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = signed.select("id", "digest", "rid").join(per_class, "digest")
    return out.select(F.col("id").alias(id_col), "class_id", "n_links", "copies", (F.col("rid") == F.col("keep_rid")).alias("kept"))
