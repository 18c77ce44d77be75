"""Hierarchical Pitman-Yor language model over all documents.

The customers of a word in the restaurant of its preceding word sit at tables,
and every table is a customer of one shared parent restaurant, whose base is
uniform.  A Gibbs sweep draws the number of tables of every (context, word) pair
from its conditional, given all others: generalised Stirling numbers times the
weights of one more table in the context and of one more customer in the parent,
each without the pair's own tables.  Texts are scored with the predictive
probabilities averaged over the sweeps after the burn-in.

Distribution: the corpus is cut into chunks of some million tokens.

1. Chunks send their distinct words to homes (ranges of word hashes), which give
   every word a number and send the numbers back.
2. Chunks send their distinct pairs with counts to buckets of contexts; a
   context with very many tokens is spread over buckets by its words.
3. A sweep runs in all buckets side by side.  Between sweeps buckets tell the
   homes how many tables each word has; homes seat the parent restaurant and
   answer with its customers and tables.  Pieces of a spread context learn the
   tables of the whole context the same way.
4. Buckets answer the chunks' pairs, homes their words, and chunks add up.

So shuffles move distinct words and pairs of a chunk or bucket, packed as arrays,
never one row per token, and no table is a function of the vocabulary's size on
the driver or in a broadcast.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import release, remove, scratch, tidy

CHUNK_TOKENS, CHUNK_ROWS = 3_000_000, 100_000
#: Bytes of text for each bucket and home.
BUCKET_BYTES = 20 << 20
#: Tokens of a context for each piece that it is spread over.
HOT_TOKENS = 1 << 20
THETA = 1.0
END_HASH = 0x5851F42D4C957F2D
#: Up to that many customers the conditional is computed with exact Stirling numbers, above with their saddle-point values.
EXACT = 256
#: Parts of the pairs of a bucket that a sweep seats one after another.
SUBSWEEPS = 2
ROWS = "dst long, kind int, src long, a binary, b binary, c binary, d binary, e binary, x double, y double, z double"
KINDS = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5, *[pa.float64()] * 3]
NAMES = [x.split()[0] for x in ROWS.split(", ")]
LOW = np.uint64(2**32 - 1)


# -- arrays in rows


def squeeze(x: np.ndarray) -> bytes:
    """An array, integers as narrow as they fit, compressed byte plane by byte plane."""
    x = np.ascontiguousarray(x)
    kind = x.dtype.kind
    if kind in "bui":
        most = int(x.max()) if len(x) else 0
        x = x.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * np.dtype(t).itemsize))
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    head = (b"f" if kind == "f" else b"u") + bytes([x.itemsize]) + len(raw).to_bytes(8, "little")
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def loose(data: bytes, kind: str = "<u8") -> np.ndarray:
    width, size = data[1], int.from_bytes(data[2:10], "little")
    raw = np.frombuffer(pa.decompress(data[10:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    flat = np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1) if size else raw
    return flat.view(f"<{data[:1].decode()}{width}").astype(kind, copy=False)


def bundled(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unbundled(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of rising numbers, the first as it is."""
    return np.diff(x, prepend=x.dtype.type(0))


def steps_in_runs(x: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Differences within runs of rising numbers; the first of each run as it is."""
    out = steps(x)
    first = np.cumsum(runs) - runs
    out[first] = x[first]
    return out


def from_steps_in_runs(d: np.ndarray, runs: np.ndarray) -> np.ndarray:
    total = np.cumsum(d)
    first = np.cumsum(runs) - runs
    return total - np.repeat(total[first] - d[first], runs)


def row(dst: int, kind: int, src: int, *arrays: bytes | None, x: float = 0.0, y: float = 0.0, z: float = 0.0) -> tuple:
    return (dst, kind, src, *arrays, *[None] * (5 - len(arrays)), x, y, z)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], NAMES)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def range_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges a hash is in."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


# -- seating


@cache
def stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers of c customers at t tables, c and t up to n."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, n):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], out[c, 1 : c + 2] + np.log(np.maximum(c - discount * t, 1e-300)))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers."""
    shift = np.zeros_like(x)
    for _ in range(7):
        small = x < 7
        shift -= np.where(small, np.log(np.where(small, x, 1)), 0)
        x = np.where(small, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


@cache
def saddle_error(discount: float) -> np.ndarray:
    """What the saddle-point values lack at EXACT customers and few tables; it hardly changes with more customers."""
    t = np.arange(1.0, EXACT // 2)
    return stirling(discount)[EXACT, 1 : EXACT // 2] - saddle_point(np.full(len(t), float(EXACT)), t, discount)


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Logarithm of a generalised Stirling number of more than EXACT customers, 1 <= t < c."""
    error = saddle_error(round(discount, 6))
    return saddle_point(c, t, discount) + np.interp(t, np.arange(1, len(error) + 1), error)


def saddle_point(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Saddle-point value of the logarithm of a generalised Stirling number, 1 <= t < c.

    Its generating function is ((1 - (1 - z)^d) / d)^t / t!, and u = 1 - z solves t d (1 - u) u^(d - 1) = c (1 - u^d).
    """
    lo, hi = np.full(np.broadcast(c, t).shape, -700.0), np.zeros(np.broadcast(c, t).shape)
    want = np.log(c) - np.log(t)
    for _ in range(44):
        mid = (lo + hi) / 2
        high = np.log(discount) + np.log(-np.expm1(mid)) + (discount - 1) * mid - np.log(-np.expm1(discount * mid)) > want
        lo, hi = np.where(high, mid, lo), np.where(high, hi, mid)
    mid = np.minimum((lo + hi) / 2, -1e-13)
    z = -np.expm1(mid)
    spread = c * (1 + (1 - discount) * z / np.exp(mid) - c / t)
    return log_gamma(c + 1.0) - log_gamma(t + 1.0) - t * np.log(discount) + t * np.log(-np.expm1(discount * mid)) - c * np.log(z) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-12))


def draw(rng: np.random.Generator, log_weight: np.ndarray) -> np.ndarray:
    """Of each row of logarithms of weights, one position."""
    w = np.exp(log_weight - log_weight.max(1, keepdims=True)).cumsum(1)
    return (rng.random(len(w))[:, None] * w[:, -1:] > w).sum(1)


def seat(rng: np.random.Generator, customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, grow: np.ndarray | float = 0.0, drop: np.ndarray | float = 0.0) -> np.ndarray:
    """Tables of dishes, each drawn from its conditional.

    customers: of each dish; others: tables of other dishes in its restaurant;
    parent: probability of the dish in the parent without this dish's tables
    here.  The k-th further table raises it by ``grow`` times (k - ``drop``).
    """
    customers = customers.astype(np.int64)
    others, parent, grow, drop = (np.broadcast_to(np.asarray(v, float), customers.shape) for v in (others, parent, grow, drop))
    tables = np.minimum(customers, 1)
    order = np.argsort(customers, kind="stable")
    sizes, first = np.unique(customers[order], return_index=True)
    known = stirling(round(discount, 6))
    for c, a, b in zip(sizes.tolist(), first.tolist(), [*first.tolist()[1:], len(order)], strict=True):
        if c < 2:
            continue
        if c > EXACT:
            own = order[a:]
            tables[own] = seat_many(rng, customers[own].astype(float), others[own], parent[own], discount, grow[own], drop[own])
            break
        k = np.arange(c)
        for at in range(a, b, max(1, 2_000_000 // c)):
            own = order[at : min(b, at + max(1, 2_000_000 // c))]
            weight = (THETA + discount * (others[own, None] + k)) * (parent[own, None] + grow[own, None] * np.maximum(k - drop[own, None], 0))
            tables[own] = 1 + draw(rng, np.log(weight).cumsum(1) + known[c, 1 : c + 1])
    return tables


def seat_many(rng: np.random.Generator, c: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, grow: np.ndarray, drop: np.ndarray) -> np.ndarray:
    """The same for many customers: the conditional on a coarse grid of numbers of tables, then on a grid where its mass is."""
    out = np.empty(len(c), np.int64)
    for at in range(0, len(c), 2000):
        own = slice(at, at + 2000)
        n, o, p, g, e = (v[own, None] for v in (c, others, parent, grow, drop))

        def log_target(t, n=n, o=o, p=p, g=g, e=e):
            start = THETA / discount + o
            weight = t * np.log(discount) + log_gamma(start + t) - log_gamma(start + 0 * t)
            has = np.where(g > 0, g, 1.0)
            shifted = np.maximum(p / has - e, 1e-9)
            weight += np.where(g > 0, np.log(p) + (t - 1) * np.log(has) + log_gamma(shifted + t) - log_gamma(shifted + 1 + 0 * t), t * np.log(p))
            return weight + log_stirling(n + 0 * t, np.minimum(t, n - 1), discount)

        coarse = np.exp(np.linspace(0, 1, 64) * np.log(n - 1))
        value = log_target(coarse)
        near = value > value.max(1, keepdims=True) - 25
        rows = np.arange(len(n))
        lo = coarse[rows, np.maximum(near.argmax(1) - 1, 0)]
        hi = coarse[rows, np.minimum(64 - near[:, ::-1].argmax(1), 63)]
        lo, hi = np.floor(lo)[:, None], np.ceil(hi)[:, None]
        step = np.maximum(1, np.ceil((hi - lo + 1) / 160))
        fine = lo + step * np.arange(161)
        inside = np.minimum(fine, n - 1)
        value = np.where(fine <= hi, log_target(inside), -np.inf)
        which = draw(rng, value)
        t = inside[rows, which] + np.floor(rng.random(len(rows)) * step[:, 0])
        out[own] = np.clip(t, 1, c[own]).astype(np.int64)
    return out


def discount(ones: float, twos: float) -> float:
    """The usual estimate from what occurs once and twice, kept away from 0 and 1."""
    return min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))


def parent_probability(state: dict, customers: np.ndarray, tables: np.ndarray, less: np.ndarray | float = 0.0) -> np.ndarray:
    """P of words in the shared restaurant; ``less`` customers are left out of its total."""
    new = (THETA + state["d0"] * state["tables"]) / state["base"]
    return (customers - state["d0"] * tables + new) / (THETA + state["customers"] - less)


# -- chunks


def tokens_of(text: str | None) -> list[bytes]:
    """A-Z in lower case; runs of anything but ASCII white space."""
    return (text or "").encode().lower().split()


class Chunk:
    """Documents whose tokens are numbered together, by first occurrence; 0 is the end."""

    def __init__(self):
        self.words: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
        self.ids, self.sizes, self.train, self.streams, self.total = [], [], [], [], 0

    def add(self, doc, text: str | None, train: bool) -> None:
        words = tokens_of(text)
        stream = np.zeros(len(words) + 1, np.uint32)
        stream[:-1] = np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words))
        self.ids.append(doc)
        self.sizes.append(len(stream))
        self.train.append(train)
        self.streams.append(stream)
        self.total += len(stream)

    def rows(self, number: int, homes: int) -> list[tuple]:
        """A row of words for each home (kind 1: hashes, tokens of training, tokens) and the row of tokens (kind 0)."""
        hashes = np.fromiter(itertools.chain((END_HASH,), map(xxhash.xxh3_64_intdigest, self.words)), np.uint64, len(self.words) + 1)
        order = np.argsort(hashes)
        stream, sizes = np.concatenate(self.streams), np.array(self.sizes, np.int64)
        train = np.repeat(np.array(self.train, bool), sizes)
        learnt = np.bincount(stream[train], minlength=len(hashes))[order]
        tokens = np.bincount(stream, minlength=len(hashes))[order]
        hashes = hashes[order]
        bounds = np.searchsorted(range_of(hashes, homes), np.arange(homes + 1))
        out = []
        for h in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[h], bounds[h + 1])
            out.append(row(h, 1, number, hashes[own].tobytes(), squeeze(learnt[own]), squeeze(tokens[own])))
        out.append(row(number, 0, 0, squeeze(stream), squeeze(sizes), squeeze(np.array(self.train, np.uint8)), squeeze(order)))
        return out


class Pairs:
    """The distinct pairs of a chunk, dealt to buckets."""

    def __init__(self, stream: np.ndarray, ids: np.ndarray, pieces: np.ndarray, buckets: int):
        """ids, pieces: the numbers of the chunk's words, and over how many pieces they are spread as contexts."""
        order = np.argsort(ids)
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        own = rank[stream]
        self.keys, self.where = np.unique(np.append(rank[:1], own[:-1]) << np.uint64(32) | own, return_inverse=True)
        context, word = (self.keys >> np.uint64(32)).astype(np.int64), (self.keys & LOW).astype(np.int64)
        self.spread = pieces[order][context]
        self.local_word, context_id, self.word = order[word], ids[order][context], ids[order][word]
        piece = np.where(self.spread > 1, mix(self.word) % self.spread, 0).astype(np.uint64)
        bucket = range_of(mix(context_id * np.uint64(0x9E3779B97F4A7C15) + piece), buckets)
        self.by = np.argsort(bucket, kind="stable")
        self.context = context_id
        self.bounds = np.searchsorted(bucket[self.by], np.arange(buckets + 1))

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of bucket k: its pairs, the first of each context, pairs per context."""
        own = self.by[self.bounds[k] : self.bounds[k + 1]]
        context = self.context[own]
        first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
        return own, first, np.diff(np.append(first, len(own)))

    def filled(self) -> list[int]:
        return np.flatnonzero(np.diff(self.bounds)).tolist()

    def requests(self, number: int, counts: np.ndarray):
        """Kind 2: contexts, pairs per context, words, counts, whether the context is spread."""
        for k in self.filled():
            own, first, runs = self.runs(k)
            yield row(k, 2, number, squeeze(steps(self.context[own][first])), squeeze(runs), squeeze(steps_in_runs(self.word[own], runs)), squeeze(counts[own]), squeeze(self.spread[own][first] > 1))


# -- buckets


def merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, pairs per context, distinct words, the word of each pair, counts, and spread contexts of several (contexts, runs, words, counts, spread)."""
    contexts = np.unique(np.concatenate([p[0] for p in parts]))
    words = np.unique(np.concatenate([p[2] for p in parts]))
    spread = np.unique(np.concatenate([p[0][p[4] > 0] for p in parts]))
    keys = np.concatenate([np.repeat(np.searchsorted(contexts, p[0]).astype(np.uint64), p[1]) << np.uint64(32) | np.searchsorted(words, p[2]).astype(np.uint64) for p in parts])
    counts = np.concatenate([p[3] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    counts = np.add.reduceat(counts, first) if len(first) else counts
    keys = keys[first]
    runs = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(contexts))
    return contexts, runs, words, (keys & LOW).astype(np.int64), counts, spread


class Bucket:
    """Restaurants of some contexts: their pairs, tables of the pairs, sums of tables and tables of contexts in the sweeps that count."""

    fixed: list[bytes] | None = None

    def __init__(self, data: tuple):
        contexts, runs, words, self.word, counts, self.spread, tables, self.summed, self.past = data
        self.contexts, self.runs, self.words, self.counts, self.tables = contexts, runs.astype(np.int64), words, counts.astype(np.int64), tables.astype(np.int64)
        self.context = np.repeat(np.arange(len(self.contexts)), self.runs)

    @classmethod
    def new(cls, parts: list[tuple]) -> Bucket:
        contexts, runs, words, word, counts, spread = merged(parts)
        return cls((contexts, runs, words, word, counts, spread, np.ones(len(word), np.int64), np.zeros(len(word), np.int64), []))

    @classmethod
    def read(cls, r: tuple) -> Bucket:
        parts = unbundled(r[3])
        contexts, runs, words, word, counts, spread, tables, summed, *past = map(loose, parts)
        bucket = cls((np.cumsum(contexts, dtype=np.uint64), runs, np.cumsum(words, dtype=np.uint64), word.astype(np.int64), counts, spread, tables, summed.astype(np.int64), past))
        bucket.fixed = parts[:6]  # what no sweep changes stays compressed
        return bucket

    def row_of(self, number: int) -> tuple:
        if self.fixed is None:
            self.fixed = [squeeze(x) for x in (steps(self.contexts), self.runs, steps(self.words), self.word, self.counts, self.spread)]
        ones, twos = float((self.counts == 1).sum()), float((self.counts == 2).sum())
        return row(number, 0, 0, bundled([*self.fixed, *(squeeze(x) for x in (self.tables, self.summed, *self.past))]), x=ones, y=twos, z=float(self.counts.sum()))

    def per_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, weights=values, minlength=len(self.contexts)).astype(np.int64)

    def messages(self, number: int, homes: int) -> list[tuple]:
        """Kind 3, to homes: words and their tables; spread contexts, their tables and customers."""
        tables = np.bincount(self.word, weights=self.tables, minlength=len(self.words)).astype(np.int64)
        home = (self.words % np.uint64(homes)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        bounds = np.searchsorted(home[order], np.arange(homes + 1))
        at = np.searchsorted(self.contexts, self.spread)
        t, c = self.per_context(self.tables)[at], self.per_context(self.counts)[at]
        of_spread = (self.spread % np.uint64(homes)).astype(np.int64)
        out = []
        for h in range(homes):
            own, hot = order[bounds[h] : bounds[h + 1]], np.flatnonzero(of_spread == h)
            if len(own) or len(hot):
                out.append(row(h, 3, number, squeeze(steps(self.words[own] // np.uint64(homes))), squeeze(tables[own]), squeeze(self.spread[hot]), squeeze(t[hot]), squeeze(c[hot])))
        return out

    def hear(self, answers: list[tuple], homes: int) -> None:
        """Takes what the homes answer: customers and tables of words, tables and customers of spread contexts."""
        home = (self.words % np.uint64(homes)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        self.above, self.above_tables = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        customers = [loose(r[3], "<i8") for r in answers]
        if customers:
            self.above[order], self.above_tables[order] = np.concatenate(customers), np.concatenate([loose(r[4], "<i8") for r in answers])
        self.of_context, self.visits = self.per_context(self.tables), self.per_context(self.counts)
        self.elsewhere = np.zeros(len(self.contexts), np.int64)
        of_spread = (self.spread % np.uint64(homes)).astype(np.int64)
        for r in answers:
            if len(hot := np.flatnonzero(of_spread == r[2])):
                at = np.searchsorted(self.contexts, self.spread[hot])
                t = loose(r[5], "<i8")
                self.elsewhere[at] = t - self.of_context[at]
                self.of_context[at], self.visits[at] = t, loose(r[6], "<i8")

    def keep(self) -> None:
        """Adds the present seating to those that count."""
        self.summed = self.summed + self.tables
        self.past = [*self.past, self.of_context]

    def sweep(self, rng: np.random.Generator, state: dict) -> None:
        """Draws the tables of all pairs; of a context the parts of SUBSWEEPS one after another."""
        part = np.arange(len(self.word)) % SUBSWEEPS
        for k in range(SUBSWEEPS):
            own = np.flatnonzero((part == k) & (self.counts > 1))
            if not len(own):
                continue
            total = self.per_context(self.tables) + self.elsewhere
            word, mine = self.word[own], self.tables[own]
            rest = np.maximum(self.above[word] - mine, 0)
            tables = np.where(rest > 0, np.maximum(1, self.above_tables[word] * rest / np.maximum(self.above[word], 1)), 0)
            p = parent_probability(state, rest, tables, mine)
            grow = 1 / (THETA + state["customers"] - mine)
            self.tables[own] = seat(rng, self.counts[own], total[self.context[own]] - mine, p, state["d1"], grow, np.where(rest > 0, 0.0, state["d0"]))

    def find(self, contexts: np.ndarray, runs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of contexts, and of pairs; -1 for what isn't there."""
        if not hasattr(self, "keys"):
            self.keys = self.context.astype(np.uint64) << np.uint64(32) | self.word.astype(np.uint64)
        at, word = position(self.contexts, contexts), position(self.words, words)
        context = np.repeat(at, runs)
        pair = position(self.keys, np.maximum(context, 0).astype(np.uint64) << np.uint64(32) | np.maximum(word, 0).astype(np.uint64))
        return at, np.where((context >= 0) & (word >= 0), pair, -1)


def position(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted number in sorted ones, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def grouped(batches):
    """(dst, rows of it) of rows that are sorted by dst; rows are handed out one by one."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return itertools.groupby(rows, key=lambda r: r[0])


def request(r: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, pairs per context, words, counts, spread of a row of kind 2."""
    runs = loose(r[4], "<i8")
    return np.cumsum(loose(r[3]), dtype=np.uint64), runs, from_steps_in_runs(loose(r[5]), runs), loose(r[6]), loose(r[7])


def training(r: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The part of a request that training tokens have."""
    contexts, runs, words, counts, spread = request(r)
    own = counts > 0
    runs = np.bincount(np.repeat(np.arange(len(contexts)), runs)[own], minlength=len(contexts))
    has = runs > 0
    return contexts[has], runs[has], words[own], counts[own], spread[has]


def by_word(parts: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Rows of values of a chunk's words, from the order of their hashes to that of their local numbers."""
    parts = np.concatenate(parts, 1)
    out = np.empty_like(parts)
    out[:, order] = parts
    return out


def score(docs: DataFrame, train: Column, sweeps: int = 5, burn_in: int = 2, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows where ``train`` holds (null: it doesn't).  Null texts are
    empty, and an empty text is its end alone.  Words that training rows don't
    have share one outcome of the base.  Rows that repeat an id are scored each.
    Without training rows every probability is that of the base and nothing is
    known.  Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "pitman-yor")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    if not size[1]:
        return docs.select(F.col(id_col), *(F.lit(0).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")), *(F.lit(0.0).alias(c) for c in ("base_score", "score")))
    buckets = homes = int(max(8, (size[0] or 0) // BUCKET_BYTES + 1))

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/{name}")
        release(spark)
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    def dealt(df: DataFrame, n: int) -> DataFrame:
        return df.select(NAMES).repartitionById(n, F.col("dst").cast("int")).sortWithinPartitions("dst", "kind", "src")

    def by_chunk(df: DataFrame) -> DataFrame:
        return df.repartitionById(chunk_parts, F.shiftright("dst", 32).cast("int")).sortWithinPartitions("dst", "kind", "src")

    # 1. words
    def tokenise(batches):
        task, number, chunk = TaskContext.get().partitionId(), 0, Chunk()

        def flush():
            made = chunk.rows(task << 32 | number, homes)
            out = batch(made)
            return pa.RecordBatch.from_arrays([*out.columns, pa.array([None] * (len(made) - 1) + [chunk.ids], pa.list_(kind_of))], [*NAMES, "ids"])

        for b in batches:
            kind_of = b.column(0).type
            for doc, text, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                chunk.add(doc, text, own)
                if chunk.total >= CHUNK_TOKENS or len(chunk.ids) >= CHUNK_ROWS:
                    yield flush()
                    number, chunk = number + 1, Chunk()
        if chunk.ids:
            yield flush()
        del chunk
        tidy()

    chunks = saved(rows.mapInArrow(tokenise, f"{ROWS}, ids array<{kind}>"), "chunks")

    def number_words(batches):
        """A home's words in the order of their tokens (kind 0) and what each chunk needs of them (kind 1: numbers, training tokens, pieces)."""
        for home, own in grouped(batches):
            own = [(r[2], np.frombuffer(r[3], "<u8"), loose(r[4], "<i8"), loose(r[5], "<i8")) for r in own]
            words, which = np.unique(np.concatenate([o[1] for o in own]), return_inverse=True)
            learnt = np.bincount(which, weights=np.concatenate([o[2] for o in own])).astype(np.int64)
            tokens = np.bincount(which, weights=np.concatenate([o[3] for o in own])).astype(np.int64)
            order = np.argsort(-tokens, kind="stable")
            rank = np.empty(len(order), np.uint64)
            rank[order] = np.arange(len(order), dtype=np.uint64)
            numbers, pieces, at = rank * np.uint64(homes) + np.uint64(home), -(-tokens // HOT_TOKENS), 0
            yield batch([row(home, 0, home, x=float(learnt.sum()), y=float((learnt > 0).sum()), z=float(len(words)))])
            for chunk, hashes, _, _ in own:
                its = which[at : at + len(hashes)]
                at += len(hashes)
                yield batch([row(chunk, 1, home, squeeze(numbers[its]), squeeze(learnt[its]), squeeze(pieces[its]))])
        tidy()

    numbered = saved(dealt(chunks.where("kind = 1").select(NAMES), homes).mapInArrow(number_words, ROWS), "numbered")
    totals = numbered.where("kind = 0").agg(F.sum("x"), F.sum("y")).first()
    n_train, vocabulary = int(totals[0] or 0), int(totals[1] or 0)
    tokens = chunks.where("kind = 0")
    chunk_parts = tokens.agg(F.max(F.shiftright("dst", 32))).first()[0] + 1  # the chunks of a task stay together
    remove(spark, f"{folder}/chunks/kind=1")

    # 2. pairs
    def pair_up(batches):
        for number, own in grouped(batches):
            first, *words = own
            order = loose(first[6], "<i8")
            ids, pieces = (by_word([loose(r[c]).reshape(1, -1) for r in words], order)[0] for c in (3, 5))
            pairs = Pairs(loose(first[3], "<i8"), ids, pieces, buckets)
            train = np.repeat(loose(first[5]) > 0, loose(first[4], "<i8"))
            counts = np.bincount(pairs.where[train], minlength=len(pairs.keys))
            for r in pairs.requests(number, counts):
                yield batch([r])
            del pairs
        tidy()

    answered = numbered.where("kind = 1").select(NAMES)
    requests = saved(by_chunk(tokens.select(NAMES).unionByName(answered)).mapInArrow(pair_up, ROWS), "requests")

    def gather(batches):
        """The pairs of each bucket with one table each (kind 0), and its messages (kind 3)."""
        for number, own in grouped(batches):
            held, pending = [], 0
            for r in own:
                held.append(training(r))
                pending += len(held[-1][2])
                if pending > 6_000_000:
                    contexts, runs, words, word, counts, spread = merged(held)
                    held, pending = [(contexts, runs, words[word], counts, np.isin(contexts, spread))], 0
            bucket = Bucket.new(held)
            yield batch([bucket.row_of(number), *bucket.messages(number, homes)])
            del bucket, held
        tidy()

    now = saved(dealt(requests, buckets).mapInArrow(gather, ROWS), "0")
    pairs = now.where("kind = 0").agg(F.sum("x"), F.sum("y")).first()

    # 3. sweeps
    def seat_parents(state: dict | None, k: int):
        def run(batches):
            """A home's customers and tables in the shared restaurant (kind 0), and what each bucket needs of them (kind 1)."""
            for home, own in grouped(batches):
                own, before = list(own), None
                if own[0][1] == 0:
                    before = loose(own.pop(0)[4], "<i8")
                ranks = [np.cumsum(loose(r[3]), dtype=np.uint64).astype(np.int64) for r in own]
                customers = np.zeros(max((int(x[-1]) + 1 for x in ranks if len(x)), default=0), np.int64)
                for r, x in zip(own, ranks, strict=True):
                    customers[x] += loose(r[4], "<i8")
                if before is None:
                    tables = np.minimum(customers, 1)
                    sums = {"x": float((customers == 1).sum()), "z": float((customers == 2).sum())}
                else:
                    tables = seat(np.random.default_rng((seed, k, home, 1)), customers, state["tables"] - before, 1 / state["base"], state["d0"])
                    sums = {"x": float(tables.sum())}
                out = [row(home, 0, k, squeeze(customers), squeeze(tables), y=float(customers.sum()), **sums)]
                spread = [loose(r[5]) for r in own]
                _, which = np.unique(np.concatenate(spread), return_inverse=True)
                total = [np.bincount(which, weights=np.concatenate([loose(r[c], "<f8") for r in own])).astype(np.int64) for c in (6, 7)]
                at = 0
                for r, x, hot in zip(own, ranks, spread, strict=True):
                    its = which[at : at + len(hot)]
                    at += len(hot)
                    out.append(row(r[2], 1, home, squeeze(customers[x]), squeeze(tables[x]), *(squeeze(t[its]) for t in total)))
                yield batch(out)
            tidy()

        return run

    fixed = {"base": vocabulary + 1.0, "d0": 0.5, "d1": discount(*(v or 0.0 for v in pairs))}
    states: list[dict] = []
    counted = list(range(burn_in + 1, sweeps + 1))
    above = None
    for k in range(sweeps + 1):
        sent = now.where("kind = 3")
        if above is not None:
            sent = sent.unionByName(above.where("kind = 0").select(NAMES))
        above = saved(dealt(sent.select(NAMES), homes).mapInArrow(seat_parents(states[-1] if states else None, k), ROWS), f"above-{k}")
        sums = [v or 0.0 for v in above.where("kind = 0").agg(F.sum("x"), F.sum("y"), F.sum("z")).first()]
        if not states:
            fixed["d0"] = discount(sums[0], sums[2])
        states.append(fixed | {"tables": sums[0] if states else float(vocabulary), "customers": sums[1]})
        if k == sweeps:
            break

        def resit(batches, k=k, state=states[-1]):
            for number, own in grouped(batches):
                first = next(own)
                bucket = Bucket.read(first)
                bucket.hear(list(own), homes)
                if k in counted:
                    bucket.keep()
                bucket.sweep(np.random.default_rng((seed, k, number)), state)
                yield batch([bucket.row_of(number), *bucket.messages(number, homes)])
                del bucket
            tidy()

        joined = now.where("kind = 0").select(NAMES).unionByName(above.where("kind = 1").select(NAMES))
        now = saved(dealt(joined, buckets).mapInArrow(resit, ROWS), str(k + 1))
        remove(spark, f"{folder}/{k}")
        if k and k - 1 not in counted:
            remove(spark, f"{folder}/above-{k - 1}")

    # 4. answers
    def answer(batches):
        """To chunks, kind 2: customers of pairs and the sum of their tables over the sweeps that count; tables of contexts in those sweeps, one after another; customers of contexts."""
        for number, own in grouped(batches):
            bucket, heard = Bucket.read(next(own)), []
            past = None
            for r in own:
                if r[1] == 1:
                    heard.append(r)
                    continue
                if past is None:
                    bucket.hear(heard, homes)
                    bucket.keep()
                    past = np.array([*bucket.past, bucket.visits]).reshape(len(counted) + 1, -1)
                contexts, runs, words, _, _ = request(r)
                at, pair = bucket.find(contexts, runs, words)
                found = [np.where(pair >= 0, x[pair], 0) if len(x) else np.zeros(len(words), np.int64) for x in (bucket.counts, bucket.summed)]
                of_contexts = np.where(at >= 0, past[:, at], 0) if past.shape[1] else np.zeros((len(past), len(at)), np.int64)
                yield batch([row(r[2], 2, number, *map(squeeze, (*found, of_contexts[:-1].ravel(), of_contexts[-1])))])
            del bucket
        tidy()

    asked = now.where("kind = 0").select(NAMES).unionByName(above.where("kind = 1").select(NAMES)).unionByName(requests.select(NAMES))
    answers = dealt(asked, buckets).mapInArrow(answer, ROWS)

    used = [states[k] for k in counted]

    def word_values(batches):
        """To chunks, kind 1: numbers, training tokens, pieces, and the probabilities in the shared restaurant of the sweeps that count, one after another."""
        for home, own in grouped(batches):
            seen: list[np.ndarray] = []
            for r in own:
                if r[1] == 0:
                    seen.append(parent_probability(used[len(seen)], loose(r[3], "<i8"), loose(r[4], "<i8")))
                    continue
                rank = (loose(r[3]) // np.uint64(homes)).astype(np.int64)
                values = []
                for j, s in enumerate(used):
                    p = seen[j] if seen else np.empty(0)  # a home may have no word of training
                    values.append(np.append(p, parent_probability(s, np.zeros(1), np.zeros(1)))[np.minimum(rank, len(p))])
                yield batch([row(r[2], 1, home, *r[3:6], squeeze(np.concatenate(values).astype(np.float32)))])
        tidy()

    kept = None
    for k in counted:
        own = spark.read.schema(ROWS).parquet(f"{folder}/above-{k}").where("kind = 0").select(NAMES)
        kept = own if kept is None else kept.unionByName(own)
    back = answered.withColumns({"dst": F.col("src"), "src": F.col("dst")})
    values = dealt(kept.unionByName(back.select(NAMES)), homes).mapInArrow(word_values, ROWS)

    def finish(batches):
        base = np.log10(n_train + 0.5 * (vocabulary + 1))
        for _, own in grouped(batches):
            own = list(own)
            first = next(r for r in own if r[1] == 0)
            words = [r for r in own if r[1] == 1]
            order = loose(first[6], "<i8")

            ids, learnt, pieces, p = (by_word([loose(r[c], kind).reshape(width, -1) for r in words], order) for c, kind, width in ((3, "<u8", 1), (4, "<u8", 1), (5, "<u8", 1), (6, "<f8", len(counted))))
            ids, learnt, pieces = ids[0], learnt[0], pieces[0]
            stream, sizes = loose(first[3], "<i8"), loose(first[4], "<i8")
            pairs = Pairs(stream, ids, pieces, buckets)
            probability = np.empty(len(pairs.keys))
            for r in own:
                if r[1] != 2:
                    continue
                which, _, runs = pairs.runs(r[2])
                past, visits = loose(r[5], "<f8").reshape(len(counted), -1), THETA + loose(r[6], "<f8")
                below = np.repeat((THETA + fixed["d1"] * past) / visits, runs, axis=1) * p[:, pairs.local_word[which]]
                probability[which] = (loose(r[3], "<f8") - fixed["d1"] * loose(r[4], "<f8") / len(counted)) / np.repeat(visits, runs) + below.mean(0)
            first_of = np.cumsum(sizes) - sizes
            counts = learnt.astype(float)[stream]
            score_ = np.add.reduceat(np.log10(probability)[pairs.where], first_of)
            simple = np.add.reduceat(np.log10(counts + 0.5) - base, first_of)
            hits = np.add.reduceat((counts > 0).astype(np.int64), first_of)
            ids_of = first[len(NAMES)]
            yield pa.RecordBatch.from_arrays([pa.array(ids_of, kind_of), pa.array(sizes), pa.array(hits), pa.array(np.full(len(sizes), n_train, np.int64)), pa.array(simple), pa.array(score_)], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            del pairs, probability, own
        tidy()

    kind_of = to_arrow_type(docs.schema[id_col].dataType)
    ready = tokens.select(*NAMES, "ids").unionByName(answers.unionByName(values), allowMissingColumns=True)
    out = by_chunk(ready).mapInArrow(finish, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
