"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation works on arrays: every code point is looked up in a class
table, one character of look-ahead is folded into the class, and the class is a
transition function of a small automaton.  Composition of such functions is
associative, so the text is cut into equal blocks, the functions of each block
are composed for all blocks side by side, the block results are chained, and a
second sweep writes the state before each character.  A table of (class, state)
says where a piece begins.  Pieces are cut as slices, looked up in a bounded
cache by hash and compared in full, and missing ones are merged together in
numpy, a batch at a time.  Long texts are scanned window by window.  Every id
keeps the byte at which it begins, so any span of a text is decoded from its
ids alone.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

# Letters and numbers of Unicode versions that unicodedata may not know yet.
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEWER_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
WHITE_SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Classes of characters; those from LAST_SPACE on exist only after look-ahead.
OTHER, LETTER, NUMBER, SPACE, LEAD_SPACE, LAST_SPACE, END, QUOTE1, QUOTE2 = range(9)
# States: nothing open, in letters, in numbers, in others, in white space, after a leading space, two or one letters of a contraction to come.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, AFTER_LEAD, TWO_TO_COME, ONE_TO_COME = range(8)
NONE = np.int32(2**31 - 1)
#: Characters that are scanned together, and pieces that a worker remembers.
BATCH_CHARS, CACHE_PIECES, CACHE_POINTS, BLOCK = 500_000, 400_000, 8_000_000, 512
#: Of the polynomial hash of pieces; a match is compared character by character.
BASE = np.uint64(0xA24BAED4963EE407)


def class_table() -> np.ndarray:
    """Class of each code point, before look-ahead."""
    letter, number = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            letter[cp] = True
        elif kind == "N":
            number[cp] = True
    for lo, hi in NEWER_LETTERS:
        letter[lo : hi + 1] = True
    for lo, hi in NEWER_NUMBERS:
        number[lo : hi + 1] = True
    table = np.zeros(0x110000, np.uint8)
    table[letter], table[number] = LETTER, NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by class and state."""
    step, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for kind, own in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        step[kind] = own
        begins[kind, [own, AFTER_LEAD]] = False
    step[SPACE] = IN_SPACE
    begins[SPACE, IN_SPACE] = False
    step[LEAD_SPACE] = AFTER_LEAD
    step[LAST_SPACE] = FREE
    step[END] = FREE
    for kind, opened in ((QUOTE1, ONE_TO_COME), (QUOTE2, TWO_TO_COME)):
        step[kind] = opened
        for held in (IN_OTHERS, AFTER_LEAD):  # the quote belongs to a run of other characters
            step[kind, held], begins[kind, held] = IN_OTHERS, False
    for kind in range(9):
        if kind != END:
            step[kind, TWO_TO_COME], step[kind, ONE_TO_COME] = ONE_TO_COME, FREE
            begins[kind, [TWO_TO_COME, ONE_TO_COME]] = False
    return step, begins


def states_before(kinds: np.ndarray, step: np.ndarray, block: int = BLOCK, tail: int = 48) -> np.ndarray:
    """State before each character, by a scan over composed transition functions.

    Most functions are constant, so the composition over the end of a block
    usually is too; only blocks where it isn't are composed as a whole.
    """
    n, states = len(kinds), step.shape[1]
    rows = -(-n // block)
    grid = np.full(rows * block, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, block).T).astype(np.int32) * states
    flat = step.ravel().astype(np.int32)

    def compose(columns: np.ndarray) -> np.ndarray:
        function = np.tile(np.arange(states, dtype=np.int32), (columns.shape[1], 1))
        for column in columns:
            function = flat.take(column[:, None] + function)
        return function

    composed = compose(grid[-tail:])
    if len(varied := np.flatnonzero((composed != composed[:, :1]).any(1))):
        composed[varied] = compose(grid[:, varied])
    entry, state = np.zeros(rows, np.int32), 0
    for r, function in enumerate(composed.tolist()):
        entry[r], state = state, function[state]
    out = np.empty((block, rows), np.uint8)
    for j, column in enumerate(grid):
        out[j] = entry
        entry = flat.take(column + entry)
    return out.T.ravel()[:n]


class ByteBPE:
    """Encoder and decoder of one vocabulary.

    vocab: bytes of each token -> id; merges: (left id, right id) -> (priority, id);
    added: strings that are cut out of texts before anything else -> id.
    """

    def __init__(self, vocab: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]], whole_first: bool, added: dict[str, int] | None = None):
        self.vocab, self.whole_first, self.added = vocab, whole_first, added or {}
        self.at_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.token = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for b, i in (*vocab.items(), *((t.encode(), i) for t, i in self.added.items())):
            self.token[i] = b
        self.of_byte = np.array([vocab[bytes([b])] for b in range(256)], np.int32)
        pairs = sorted((a << 32 | b, p, i) for (a, b), (p, i) in merges.items())
        self.keys = np.array([x[0] for x in pairs], np.int64)
        self.priority = np.array([x[1] for x in pairs], np.int32)
        self.merged = np.array([x[2] for x in pairs], np.int32)
        self.id_of_priority = np.zeros(int(self.priority.max(initial=0)) + 1, np.int32)
        self.id_of_priority[self.priority] = self.merged
        # an open-addressed table of the merges: the key in its slot or, if that is taken, in one of the next
        self.bits = max(4, (4 * len(self.keys)).bit_length())
        self.slot_key, self.slot_priority = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, NONE, np.int32)
        for key, priority, slot in zip(self.keys.tolist(), self.priority.tolist(), self.slot_of(self.keys).tolist(), strict=True):
            while self.slot_key[slot] >= 0:
                slot += 1
            self.slot_key[slot], self.slot_priority[slot] = key, priority
        lengths = np.fromiter(map(len, self.token), np.int64, len(self.token))
        self.token_bytes, self.token_size = np.frombuffer(b"".join(self.token), np.uint8), lengths
        self.token_at = np.cumsum(lengths) - lengths
        self.kinds = class_table()
        self.step, self.begins = automaton()
        self.forget()

    @classmethod
    def from_ranks(cls, data: bytes) -> ByteBPE:
        """From the content of a rank file: a line has a token in base64 and its rank, which is its id."""
        vocab = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        merges = {}
        for t, i in vocab.items():
            for k in range(1, len(t)):
                if (a := vocab.get(t[:k])) is not None and (b := vocab.get(t[k:])) is not None:
                    merges[a, b] = i, i
        return cls(vocab, merges, True)

    @classmethod
    def from_json(cls, data: bytes) -> ByteBPE:
        """From the content of a tokenizer file with a byte-level BPE model: its vocabulary, its list of merges and its added tokens."""
        whole = json.loads(data)
        model, added = whole["model"], {}
        for t in whole.get("added_tokens") or ():
            if t.get("single_word") or t.get("lstrip") or t.get("rstrip"):
                raise ValueError(f"added token {t['content']!r}: single_word, lstrip and rstrip aren't supported")
            added[t["content"]] = t["id"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        ids = model["vocab"]
        as_bytes = lambda s: bytes(back[c] for c in s)
        vocab = {as_bytes(s): i for s, i in ids.items() if all(c in back for c in s)}
        single = set(range(256))
        merges = {}
        for p, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            merges.setdefault((ids[a], ids[b]), (p, ids[a + b]))
        made = {i for _, i in merges.values()} | {vocab[bytes([b])] for b in single}
        return cls({t: i for t, i in vocab.items() if i in made}, merges, False, added)

    # -- pre-tokenisation

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts, their code points, begin and end of each piece there, and the number of the first piece of each text and of the end."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.kinds.take(points)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        kinds[ends] = END
        spaces = np.flatnonzero(kinds == SPACE)
        after = kinds[spaces + 1]  # a space is never last
        spaces = spaces[(after != SPACE) & (after != END)]
        kinds[spaces] = np.where(points[spaces] == 32, LEAD_SPACE, LAST_SPACE)
        quotes = np.flatnonzero(points == 39)
        quotes = quotes[kinds[quotes] == OTHER]
        if len(quotes):
            a, b = points[quotes + 1], points[np.minimum(quotes + 2, len(points) - 1)]
            one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
            two = (((a == 114) | (a == 118)) & (b == 101)) | ((a == 108) & (b == 108))
            kinds[quotes[one]], kinds[quotes[two]] = QUOTE1, QUOTE2
        begins = np.flatnonzero(self.begins.ravel().take(kinds.astype(np.int32) * 8 + states_before(kinds, self.step)))
        stops = np.append(begins[1:], len(points))
        real = kinds[begins] != END
        begins, stops = begins[real], stops[real]
        return joined, points, begins, stops, np.append(np.searchsorted(begins, np.append(0, ends[:-1])), len(begins))

    # -- merging

    def slot_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Priorities of merges of ids; NONE where there is none or an id is below zero."""
        key = left.astype(np.int64) << 32 | right
        slot = self.slot_of(key)
        there = self.slot_key.take(slot)
        out = np.where((there == key) & (right >= 0) & (left >= 0), self.slot_priority.take(slot), NONE)
        on = np.flatnonzero((there != key) & (there >= 0) & (right >= 0) & (left >= 0))
        while len(on):
            slot[on] += 1
            there = self.slot_key.take(slot[on])
            hit = there == key[on]
            out[on[hit]] = self.slot_priority.take(slot[on[hit]])
            on = on[~hit & (there >= 0)]
        return out

    def pair(self, left: int, right: int) -> tuple[int, int] | None:
        """Priority and id of one merge."""
        key = left << 32 | right
        at = int(np.searchsorted(self.keys, key))
        return (int(self.priority[at]), int(self.merged[at])) if at < len(self.keys) and self.keys[at] == key else None

    def merge_long(self, piece: bytes) -> list[int]:
        """One piece of any length, with a heap of pairs."""
        ids, n = self.of_byte[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive, heap, met = [True] * n, [], {}

        def offer(i: int, j: int) -> None:
            p = ids[i], ids[j]
            if p not in met:
                met[p] = self.pair(*p)
            if met[p]:
                heapq.heappush(heap, (met[p][0], i, *p))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = met[a, b][1], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [t for t, x in zip(ids, alive, strict=True) if x]

    def merge_together(self, data: np.ndarray, begins: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all ids, for pieces (bytes of data) of similar length; each round merges the first best pair of every piece."""
        width, pieces = int(size.max()), len(size)
        column = np.arange(width)
        ids = np.where(column < size[:, None], self.of_byte.take(data.take(begins[:, None] + column, mode="clip")), np.int32(-1))
        counts, ended = np.zeros(pieces, np.int64), []
        who = np.arange(pieces)
        pair = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(pieces, width - 1)
        while len(who):
            if width > 1:
                best = pair.argmin(1)
                low = pair[np.arange(len(who)), best]
                keep = low != NONE
            else:
                keep = np.zeros(len(who), bool)
            if not keep.all():
                done = ids[~keep]
                counts[who[~keep]] = (done >= 0).sum(1)
                ended.append((who[~keep], done[done >= 0]))
                if not keep.any():
                    break
                who, ids, pair, best, low = who[keep], ids[keep], pair[keep], best[keep], low[keep]
            row = np.arange(len(who))
            ids[row, best] = self.id_of_priority.take(low)
            stay = np.ones(ids.shape, bool)
            stay[row, best + 1] = False
            ids = ids[stay].reshape(len(who), width - 1)
            stay = np.ones(pair.shape, bool)
            stay[row, best] = False
            pair = pair[stay].reshape(len(who), width - 2)
            width -= 1
            has = np.flatnonzero(best > 0)
            pair[has, best[has] - 1] = self.ranks(ids[has, best[has] - 1], ids[has, best[has]])
            has = np.flatnonzero(best < width - 1)
            pair[has, best[has]] = self.ranks(ids[has, best[has]], ids[has, best[has] + 1])
        out, first = np.empty(counts.sum(), np.uint32), np.cumsum(counts) - counts
        for own, flat in ended:
            n = counts[own]
            out[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(len(flat))] = flat
        return counts, out

    def encode_pieces(self, data: bytes, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece (a slice of data) has, and all ids in a row."""
        raw, size = np.frombuffer(data, np.uint8), stops - begins
        whole = np.full(len(size), -1, np.int64)
        if self.whole_first:
            whole[:] = [self.vocab.get(data[i:j], -1) for i, j in zip(begins.tolist(), stops.tolist(), strict=True)]
        else:
            single = np.flatnonzero(size == 1)
            whole[single] = self.of_byte[raw[begins[single]]]
        counts, parts = np.zeros(len(size), np.int64), []
        one = np.flatnonzero(whole >= 0)
        counts[one] = 1
        parts.append((one, whole[one]))
        rest = np.flatnonzero(whole < 0)
        n = size[rest]
        group = np.where(n < 5, 4, np.where(n < 16, n & ~1, np.where(n <= 64, n & ~7, -1)))
        for k in np.flatnonzero(group < 0).tolist():
            own = rest[k : k + 1]
            ids = self.merge_long(data[begins[own[0]] : stops[own[0]]])
            counts[own] = len(ids)
            parts.append((own, np.array(ids)))
        order = np.argsort(group, kind="stable")
        for g in np.unique(group[group > 0]).tolist():
            which = rest[order[np.searchsorted(group[order], g) : np.searchsorted(group[order], g, "right")]]
            for at in range(0, len(which), 20_000):
                own = which[at : at + 20_000]
                counts[own], ids = self.merge_together(raw, begins[own], size[own])
                parts.append((own, ids))
        out, first = np.empty(counts.sum(), np.uint32), np.cumsum(counts) - counts
        for own, ids in parts:
            out[spans(first[own], counts[own])] = ids
        return counts, out

    # -- the cache: sorted hashes of pieces, where the characters of each are, and where its ids are

    def forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.known_at, self.known_n, self.known_text, self.known_size = (np.empty(0, np.int64) for _ in range(4))
        self.store, self.stored = np.empty(1 << 16, np.uint32), 0
        self.text, self.texted = np.empty(1 << 16, np.uint32), 0

    def add(self, hashes: np.ndarray, sizes: np.ndarray, points: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Puts pieces with their characters and ids into the cache; hashes must be sorted and new."""
        while self.stored + len(ids) > len(self.store):
            self.store = np.append(self.store, np.empty_like(self.store))
        while self.texted + len(points) > len(self.text):
            self.text = np.append(self.text, np.empty_like(self.text))
        self.store[self.stored : self.stored + len(ids)] = ids
        self.text[self.texted : self.texted + len(points)] = points
        where = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, where, hashes)
        self.known_at = np.insert(self.known_at, where, self.stored + np.cumsum(counts) - counts)
        self.known_n = np.insert(self.known_n, where, counts)
        self.known_text = np.insert(self.known_text, where, self.texted + np.cumsum(sizes) - sizes)
        self.known_size = np.insert(self.known_size, where, sizes)
        self.stored += len(ids)
        self.texted += len(points)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the hash's odd base modulo 2^64, and of its inverse."""
        if len(self.up) < n:
            self.up = np.cumprod(np.append(np.uint64(1), np.full(n - 1, BASE, np.uint64)))
            self.down = np.cumprod(np.append(np.uint64(1), np.full(n - 1, pow(int(BASE), -1, 1 << 64), np.uint64)))
        return self.up, self.down

    up = down = np.empty(0, np.uint64)

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, ids in each piece, begin of each piece in the joined texts, and number of the first piece of each text and of the end."""
        joined, points, begins, stops, first = self.cut(texts)
        if not len(begins):
            return np.empty(0, np.uint32), np.empty(0, np.int64), begins, first
        up, down = self.powers(len(points) + 1)
        mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= up[: len(points)]
        total = np.cumsum(mixed)
        sums = (total[stops - 1] - total[begins] + mixed[begins]) * down[begins]
        sums ^= sums >> np.uint64(32)
        sums = sums * np.uint64(0xD6E8FEB86659FD93) + (stops - begins).astype(np.uint64)
        sizes = stops - begins
        order = np.argsort(sums)
        sorted_ = sums[order]
        new = np.append(True, sorted_[1:] != sorted_[:-1])
        at = order[new]  # an occurrence of each
        unique = sorted_[new]
        number = np.empty(len(sums), np.int64)
        number[order] = np.cumsum(new) - 1
        if len(self.known) > CACHE_PIECES or self.texted > CACHE_POINTS:
            self.forget()
        first_of = at[number]
        if (sizes[first_of] == sizes).all() and (points[spans(begins[first_of], sizes)] == points[spans(begins, sizes)]).all():
            where = np.searchsorted(self.known, unique)
            where[where == len(self.known)] = 0
            missing = np.flatnonzero(self.known[where] != unique) if len(self.known) else np.arange(len(unique))
            if len(missing):
                own = at[missing]
                encoded = self.encode_pieces(*in_bytes(joined, points, begins[own], stops[own]))
                self.add(unique[missing], sizes[own], points[spans(begins[own], sizes[own])], *encoded)
                where = np.searchsorted(self.known, unique)
            if (self.known_size[where] == sizes[at]).all() and (self.text[spans(self.known_text[where], sizes[at])] == points[spans(begins[at], sizes[at])]).all():
                which = where[number]
                counts = self.known_n[which]
                return self.store[spans(self.known_at[which], counts)], counts, begins, first
        # two pieces with one hash: this batch goes without the cache
        counts, ids = self.encode_pieces(*in_bytes(joined, points, begins, stops))
        return ids, counts, begins, first

    def encode_some(self, texts: list[str]) -> list[bytes]:
        if not self.at_added or not any(map(self.at_added.search, texts)):
            return self.encode_plain(texts)
        between, found = [self.at_added.split(t) for t in texts], [self.at_added.findall(t) for t in texts]
        encoded, out = iter(self.encode_plain([x for own in between for x in own])), []
        for own in found:
            parts = [next(encoded)]
            for t in own:
                parts += self.added[t].to_bytes(4, "little"), next(encoded)
            out.append(b"".join(parts))
        return out

    def encode_long(self, text: str) -> bytes:
        """Ids of one text, window by window; memory grows with the longest piece and the ids.

        A piece depends on no character before it and on at most two after the
        one that follows it, so the pieces before the last but two characters of
        a window are final, and the next window begins where the last of them does.
        """
        out, at, width = [], 0, BATCH_CHARS
        while at < len(text):
            window = text[at : at + width]
            ids, counts, begins, _ = self.ids_of([window])
            if at + width >= len(text):
                out.append(ids.astype("<u4").tobytes())
                break
            final = int(np.searchsorted(begins, len(window) - 3, "right")) - 1
            if final < 1:  # one piece
                width *= 2
                continue
            out.append(ids[: int(counts[:final].sum())].astype("<u4").tobytes())
            at, width = at + int(begins[final]), BATCH_CHARS
        return b"".join(out)

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts in which added tokens don't count."""
        if any(len(t) > BATCH_CHARS for t in texts):
            short = iter(self.encode_plain([t for t in texts if len(t) <= BATCH_CHARS]))
            return [self.encode_long(t) if len(t) > BATCH_CHARS else next(short) for t in texts]
        ids, counts, _, first = self.ids_of(texts)
        at = (4 * np.append(0, np.cumsum(counts))[first]).tolist()
        packed = ids.astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        held, chars = [], 0
        for t in texts:
            if held and chars + len(t) > BATCH_CHARS:
                yield from self.encode_some(held)
                held, chars = [], 0
            held.append(t)
            chars += len(t) + 1
            if chars >= BATCH_CHARS:
                yield from self.encode_some(held)
                held, chars = [], 0
        if held:
            yield from self.encode_some(held)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each id begins in the text it stands for."""
        return np.cumsum(self.token_size[ids]) - self.token_size[ids]

    def encode_with_offsets(self, text: str) -> tuple[list[int], list[int]]:
        """Ids, and for each the byte at which it begins in the text as UTF-8."""
        ids = np.frombuffer(self.encode_some([text])[0], "<u4")
        return ids.tolist(), self.offsets(ids).tolist()

    def decode(self, ids: bytes, offsets: np.ndarray | None = None, begin: int = 0, end: int | None = None, chunk: int = 1 << 20) -> bytes:
        """The bytes of ids, or those from ``begin`` to ``end`` of the text.

        With offsets (as retained by the encoder) only the ids of that span are
        read, and offsets that don't fit the ids are an error.
        """
        ids = np.frombuffer(ids, "<u4")
        if offsets is None:
            offsets = self.offsets(ids)
        first = max(0, int(np.searchsorted(offsets, begin, "right")) - 1)
        last = len(ids) if end is None else int(np.searchsorted(offsets, end, "left"))
        out = []
        for at in range(first, last, chunk):
            own = ids[at : min(last, at + chunk)]
            size, where = self.token_size[own], offsets[at : at + len(own)]
            if len(where) != len(own) or (np.cumsum(size) - size != where - where[0]).any():
                raise ValueError("offsets don't belong to the ids")
            out.append(self.token_bytes[spans(self.token_at[own], size)].tobytes())
        skip = begin - int(offsets[first]) if first < len(ids) else 0
        whole = b"".join(out)
        return whole[skip : None if end is None else skip + max(0, end - begin)]


def in_bytes(text: str, points: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text in UTF-8, and slices of it by their bytes."""
    data = text.encode()
    if len(data) == len(points):
        return data, begins, stops
    at = np.append(0, np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)))
    return data, at[begins], at[stops]


def spans(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of spans, one span after another."""
    total = np.cumsum(sizes)
    return np.repeat(begins - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)


_LOADED: dict[tuple, ByteBPE] = {}


def load(name: str, data: bytes) -> ByteBPE:
    """The worker's encoder, made once; ``name`` ends in .json for a tokenizer file, else it is a rank file."""
    key = name, len(data)
    if key not in _LOADED:
        _LOADED[key] = ByteBPE.from_json(data) if name.endswith(".json") else ByteBPE.from_ranks(data)
    return _LOADED[key]


def file_bytes(path: str) -> bytes:
    """A vocabulary file, read by the driver; at most a few MB, sent with the code of the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, ids (little-endian unsigned 32-bit), offsets (little-endian unsigned 64-bit, compressed).

    ``offsets`` has the byte of the text at which each id begins.  Null texts
    count as empty and give no ids.  Rows keep their order and repeats, other
    columns are not read; no shuffle takes place.
    """
    shared = docs.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))

    def run(batches):
        bpe = load(vocabulary, shared.value)
        for b in batches:
            ids = list(bpe.encode(x if x is not None else "" for x in b.column(1).to_pylist()))
            where = [pack_offsets(bpe.offsets(np.frombuffer(x, "<u4"))) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(where, pa.binary())], ["id", "n_tokens", "ids", "offsets"])
            del ids, where
        tidy()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids binary, offsets binary")
    return out.withColumnRenamed("id", id_col)


def pack_offsets(offsets: np.ndarray) -> bytes:
    """Offsets as their differences, a byte each; 255 stands for a longer token, whose 8 bytes follow at the end."""
    step = np.diff(offsets, prepend=0)
    return np.minimum(step, 255).astype(np.uint8).tobytes() + step[step >= 255].astype("<u8").tobytes()


def unpack_offsets(data: bytes, n: int) -> np.ndarray:
    step = np.frombuffer(data, np.uint8, n).astype(np.int64)
    step[step == 255] = np.frombuffer(data, "<u8", offset=n).astype(np.int64) if len(data) > n else 0
    return np.cumsum(step)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", offsets_col: str = "offsets", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col`` (binary): the bytes that the ids stand for, placed by the offsets if there is such a column; null ids give no bytes.

    A column of that name is replaced.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(file_bytes(vocabulary))
    names = [c for c in encoded.columns if c != out_col]
    encoded = encoded.select(*(f"`{c}`" for c in names))

    def run(batches):
        bpe = load(vocabulary, shared.value)
        for b in batches:
            ids = b.column(names.index(ids_col)).to_pylist()
            where = b.column(names.index(offsets_col)).to_pylist() if offsets_col in names else [None] * len(ids)
            out = [bpe.decode(x or b"", None if w is None else unpack_offsets(w, len(x or b"") // 4)) for x, w in zip(ids, where, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*names, out_col])
            del out, ids, where
        tidy()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, `{out_col}` binary")
