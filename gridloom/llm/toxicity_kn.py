"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over bytes, one of toxic and one of ordinary
documents, share the backoff distribution of the low orders, so an expression
that is rare in one class falls back to the same counts in both.  A document's
evidence are differences of the two log-likelihoods and nothing else: that of the
whole text over its length, and those of its two most telling words, as a few
toxic words in a long text hardly move the former.  A logistic calibration on
rows that the models have not seen, with the true shares of the classes as prior,
turns them into a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, tidy
from .ecoc_langid import FOLD

SHARED, ORDER, DISCOUNT = 3, 6, 0.75
MIX = np.uint64(0x9E3779B97F4A7C15)
PAD = b"\0" * ORDER
BATCH_BYTES = 100_000


def prepared(text: str | None) -> bytes:
    """Letters in lower case between single spaces; the rest of ASCII only separates."""
    words = (text or "").encode().translate(FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b""


def grams(b: np.ndarray, order: int) -> np.ndarray:
    """Packed bytes of the n-gram that ends at each position from order - 1 on."""
    n = len(b) - order + 1
    key = np.zeros(max(n, 0), np.uint64)
    for k in range(order if n > 0 else 0):
        key = key << np.uint64(8) | b[k : k + n].astype(np.uint64)
    return key


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


class Table:
    """All n-grams of one order with two values each, in open addressing: a key is in its slot or in one of the next."""

    def __init__(self, keys: np.ndarray, value: np.ndarray, over: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.key = np.zeros((1 << self.bits) + 256, np.uint64)  # 0 is no n-gram
        self.value, self.over = (np.zeros(len(self.key), np.float32) for _ in range(2))
        slot, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            _, first = np.unique(slot[left], return_index=True)
            first = left[first]
            first = first[self.key[slot[first]] == 0]
            self.key[slot[first]], self.value[slot[first]], self.over[slot[first]] = keys[first], value[first], over[first]
            left = left[self.key[slot[left]] != keys[left]]
            slot[left] += 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        slot = self.slots(keys)
        there = self.key.take(slot)
        on = np.flatnonzero((there != keys) & (there != 0))
        slot[(there != keys) & (there == 0)] = -1
        while len(on):
            slot[on] += 1
            there = self.key.take(slot[on])
            hit, none = there == keys[on], there == 0
            slot[on[none & ~hit]] = -1
            on = on[~hit & ~none]
        return slot


class Counts:
    """Kneser-Ney counts of one text stream: raw for the highest order, continuations below."""

    def __init__(self, text: bytes):
        b = np.frombuffer(text, np.uint8)
        self.keys, self.count, self.context, self.total, self.kinds = {}, {}, {}, {}, {}
        above = None
        for n in range(ORDER, 0, -1):
            if above is None:
                keys, count = np.unique(grams(b, n), return_counts=True)
            else:  # in how many ways is each n-gram continued to the left
                keys, count = np.unique(above & np.uint64((1 << 8 * n) - 1), return_counts=True)
            real = (keys & np.uint64(255)) != 0  # nothing predicts the padding
            keys, count = keys[real], count[real]
            self.keys[n], self.count[n] = keys, count.astype(float)
            context = keys >> np.uint64(8)
            self.context[n], first, kinds = np.unique(context, return_index=True, return_counts=True)
            self.kinds[n] = kinds.astype(float)
            self.total[n] = np.add.reduceat(self.count[n], first) if len(first) else np.zeros(0)
            above = keys

    def probability(self, n: int, keys: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Interpolated probability of n-grams, given that of their endings."""
        at, own = find(self.context[n], keys >> np.uint64(8)), find(self.keys[n], keys)
        seen = np.where(own >= 0, np.maximum(self.count[n][own] - DISCOUNT, 0), 0) if len(self.count[n]) else np.zeros(len(keys))
        total, kinds = (self.total[n][at], self.kinds[n][at]) if len(self.total[n]) else (np.ones(len(keys)), np.ones(len(keys)))
        return np.where(at >= 0, (seen + DISCOUNT * kinds * lower) / total, lower)

    def left_over(self, n: int, contexts: np.ndarray) -> np.ndarray:
        """Weight that contexts of order n leave to the lower order."""
        at = find(self.context[n], contexts)
        return np.where(at >= 0, DISCOUNT * self.kinds[n][at] / self.total[n][at], 1.0) if len(self.total[n]) else np.ones(len(contexts))


@dataclass
class Model:
    """For each order from SHARED on: n-grams, their log ratio, and the log ratio of what they leave over as contexts; then the calibration."""

    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    scale: np.ndarray
    weights: np.ndarray

    def tables(self) -> dict[int, Table]:
        """The n-grams for look-up, made once in a process."""
        if not hasattr(self, "_tables"):
            self._tables = {n: Table(*x) for n, x in self.grams.items()}
        return self._tables

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def ratios(self, b: np.ndarray) -> np.ndarray:
        """log10 P(toxic) / P(ordinary) of every byte, given those before."""
        out = np.zeros(len(b), np.float32)
        left = None
        for n, table in sorted(self.tables().items()):
            slot = table.find(grams(b, n))
            hit = np.flatnonzero(slot >= 0)
            at = out[n - 1 :]
            if left is not None:
                at += left[:-1]
            at[hit] = table.value[slot[hit]]
            left = np.zeros(len(slot), np.float32)
            left[hit] = table.over[slot[hit]]
        out[b == 0] = 0
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: log-likelihood ratio of the first and of the second most telling word, and of the whole text per byte."""
        out = np.zeros((len(texts), 3))
        group, size = [], 0
        for k, t in enumerate(texts):
            if p := prepared(t):
                group.append((k, p))
                size += len(p)
            if size >= BATCH_BYTES or k == len(texts) - 1 and group:
                out[[g[0] for g in group]] = self._features([g[1] for g in group])
                group, size = [], 0
        return out

    def _features(self, texts: list[bytes]) -> np.ndarray:
        b = np.frombuffer(PAD + PAD.join(texts) + PAD, np.uint8)
        r = self.ratios(b)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(size + ORDER) - size
        starts = np.flatnonzero((b[:-1] == 32) & (b[1:] != 0)) + 1  # words; each ends with its space
        word = np.add.reduceat(r, starts)
        doc_first = np.searchsorted(starts, first)
        n_words = np.diff(np.append(doc_first, len(starts)))
        mean = np.add.reduceat(r, first) / size
        top = np.maximum.reduceat(word, doc_first)
        doc_of = np.repeat(np.arange(len(texts)), n_words)
        is_top = word == top[doc_of]
        where = np.flatnonzero(is_top)
        _, one = np.unique(doc_of[where], return_index=True)
        word[where[one]] = -np.inf
        second = np.maximum(np.maximum.reduceat(word, doc_first), 0)
        return np.stack([np.maximum(top, 0), second, mean], 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = self.features(texts) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.weights, -50, 50)))


def likelihood_tables(toxic: list[bytes], ordinary: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    streams = [PAD + PAD.join(x) + PAD for x in (toxic, ordinary)]
    both = Counts(streams[0] + streams[1])
    classes = [Counts(s) for s in streams]
    shared, p = {}, np.full(256, 1 / 256)
    for n in range(1, SHARED + 1):
        keys = both.keys[n] if n > 1 else np.arange(256, dtype=np.uint64)
        low = p if n == 1 else p[find(shared_keys, keys & np.uint64((1 << 8 * (n - 1)) - 1))]
        p, shared_keys = both.probability(n, keys, low), keys
        shared[n] = keys, p
    over = [np.log10(c.left_over(SHARED + 1, shared_keys)) for c in classes]
    tables, lower = {SHARED: (shared_keys, np.zeros(len(shared_keys), np.float32), (over[0] - over[1]).astype(np.float32))}, [p, p]
    lower_keys = shared_keys
    for n in range(SHARED + 1, ORDER + 1):
        keys = np.union1d(classes[0].keys[n], classes[1].keys[n])
        below = find(lower_keys, keys & np.uint64((1 << 8 * (n - 1)) - 1))
        lower = [c.probability(n, keys, low[below]) for c, low in zip(classes, lower, strict=True)]
        over = [np.log10(c.left_over(n + 1, keys)) if n < ORDER else np.zeros(len(keys)) for c in classes]
        tables[n] = keys, np.log10(lower[0] / lower[1]).astype(np.float32), (over[0] - over[1]).astype(np.float32)
        lower_keys = keys
    return tables


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01, rounds: int = 40) -> np.ndarray:
    x, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step * min(1, 5 / max(np.abs(step).max(), 1e-9))
    return w


def fit(docs: DataFrame, labels: DataFrame, train: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 2000, sample_bytes: int = 64 << 20) -> Model | None:
    """Fits on documents whose label is 0 or 1 and for whose id ``train`` holds.

    About ``per_class`` rows of each class and at most ``sample_bytes`` of text are
    used, chosen by a hash of the id; three quarters train the likelihoods, the
    rest the calibration, weighted by the true shares of the classes.  Of several
    labels of an id the highest counts, of several texts the least; null labels,
    ids and texts don't take part.  None if a class is missing.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & train).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    chosen = known.where(F.when(F.col("y") == 1, chance <= per_class / sizes[1]).otherwise(chance <= per_class / sizes[0]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(chosen), "id")  # at most about 2 * per_class ids
    rows = rows.groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = rows.select("id", "y", "text", F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("id"), "id")).alias("so_far")).where(F.col("so_far") <= sample_bytes)
    sample = sorted((r.id, r.y, r.text) for r in rows.collect())
    sides = {y: [r for r in sample if r[1] == y] for y in (0, 1)}
    if not all(len(x) >= 2 for x in sides.values()):
        return None
    fitted = {y: [prepared(r[2]) for k, r in enumerate(x) if k % 4] for y, x in sides.items()}
    held = [r for x in sides.values() for k, r in enumerate(x) if not k % 4]
    model = Model(likelihood_tables(*([t for t in fitted[y] if t] for y in (1, 0))), np.ones(3), np.zeros(4))
    x, y = model.features([r[2] for r in held]), np.array([r[1] for r in held])
    model.scale = np.maximum(x.std(0), 1e-6)
    share = np.where(y == 1, sizes[1] / max(y.sum(), 1), sizes[0] / max((1 - y).sum(), 1))
    model.weights = logistic(x / model.scale, y, share / share.sum() * len(y))
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """Adds ``out_col`` (0 to 1, higher: toxic likelier) to ``docs``, from whole texts alone; without a model it is 0.

    Null and empty texts get the score of a text without evidence.  Rows keep
    their order and repeats; a column of that name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != out_col]
    docs = docs.select(*(f"`{c}`" for c in names))
    where = names.index(text_col)

    def run(batches):
        m = sent.value
        for b in slices(batches, where):
            texts = b.column(where).to_pylist()
            out = m.score(texts) if m and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*names, out_col])
        tidy()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{out_col}` double")
