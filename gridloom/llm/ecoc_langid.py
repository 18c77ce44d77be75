"""Language identification with error-correcting output codes.

Every language has a codeword of signs.  For each bit a linear classifier over
hashed byte trigrams, fitted by regularised least squares, predicts the sign;
decoding sums an exponential loss of the bits against each codeword and takes
the language of least loss.  Two languages that are almost as near flag the
document as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

BITS = 13
FEATURES = 1 << BITS
UNDETERMINED = "und"
#: The letters of ASCII in lower case, bytes of other characters as they are, all else a space.
FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
LETTERS = bytes([*range(65, 91), *range(97, 123)])


def trigrams(text: bytes, chunk: int = 1 << 22) -> np.ndarray:
    """Counts of hashed trigrams of a whole text, counted chunk by chunk."""
    text = b" " + text.translate(FOLD) + b" "
    out = np.zeros(FEATURES)
    for at in range(0, len(text) - 2, chunk):
        b = np.frombuffer(text[at : at + chunk + 2], np.uint8).astype(np.uint32)
        key = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
        out += np.bincount(key >> np.uint32(32 - BITS), minlength=FEATURES)
    return out


def vector(text: bytes) -> np.ndarray:
    """Square roots of the shares of all trigrams, a vector of length 1."""
    counts = trigrams(text)
    return np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


def has_letter(text: str) -> bool:
    b = text.encode()
    return len(b.translate(None, LETTERS)) < len(b) or any(map(str.isalpha, text))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of signs for each of n languages: all splits in two for few languages, else random codes that lie far apart."""
    if n <= 7:
        bits = max(1, (1 << max(n - 1, 0)) - 1)
        return np.array([[1 if k == 0 or (c >> (k - 1)) & 1 else -1 for c in range(bits)] for k in range(n)]).reshape(n, bits)
    rng, best = np.random.default_rng(seed), (-1, None)
    for _ in range(100):
        code = rng.choice([-1, 1], (n, int(np.ceil(15 * np.log2(n)))))
        near = code @ code.T - 2 * code.shape[1] * np.eye(n)
        if (least := -near.max()) > best[0] or best[1] is None:
            best = least, code
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its confidence, and how much greater the mean loss of the second is, for rows of vectors."""
        margins = np.clip(x @ self.weights, -4, 4)
        loss = np.exp(-2 * margins[:, None, :] * self.code[None]).mean(2)
        order = np.argsort(loss, 1, kind="stable")
        share = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        rows = np.arange(len(x))
        second = loss[rows, order[:, 1]] if loss.shape[1] > 1 else np.full(len(x), np.inf)
        return order[:, 0], 1 / share.sum(1), second - loss[rows, order[:, 0]]


def fit(docs: DataFrame, train: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = 500, rows_in_all: int = 6000, ridge: float = 1.0) -> Model | None:
    """Fits on rows where ``train`` holds, language and text are not null and the text has a letter.

    About ``per_language`` rows of each language are used, fewer where all
    languages together would pass ``rows_in_all``, chosen by a hash of the id;
    this bounds what comes to the driver.  None without any such row.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    per_language = min(per_language, max(2, rows_in_all // len(sizes)))
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    chosen = reduce(lambda a, b: a | b, [(F.col("lang") == x) & (chance <= per_language / n) for x, n in sizes.items()])

    def features(batches):
        for b in batches:
            own = [(k, np.flatnonzero(v := vector(t.encode())).astype(np.uint16), v) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.string()), pa.array([x[1].tobytes() for x in own], pa.binary()), pa.array([x[2][x[1]].tobytes() for x in own], pa.binary())], ["lang", "at", "value"])
        tidy()

    sample = sorted(tuple(r) for r in rows.where(chosen).select("lang", "text").mapInArrow(features, "lang string, at binary, value binary").collect())
    if not sample:
        return None
    names = sorted({s[0] for s in sample})
    x, y = np.zeros((len(sample), FEATURES), np.float32), np.array([names.index(s[0]) for s in sample])
    for row, (_, at, value) in zip(x, sample, strict=True):
        row[np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float32)
    code = codewords(len(names))
    weight = (len(y) / len(names) / np.bincount(y))[y].astype(np.float32)  # every language counts alike
    gram = x @ x.T
    dual = np.linalg.solve(gram + np.diag(ridge / weight), code[y].astype(np.float32))
    return Model(names, code, (x.T @ dual).astype(np.float32))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", least_gap: float = 0.02, out_cols: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """Adds the predicted language, its score (0 to 1) and whether it is ambiguous to ``docs``, from the text alone.

    A null text, one without a letter, and any text without a model is ``und``
    with score 0 and not ambiguous.  Whole texts are read; rows keep their order
    and repeats, and columns named like the three are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in out_cols]
    docs = docs.select(*(f"`{c}`" for c in names))
    where = names.index(text_col)

    def run(batches):
        m = sent.value
        for b in slices(batches, where):
            texts = b.column(where).to_pylist()
            lang, score, unsure = [UNDETERMINED] * len(texts), [0.0] * len(texts), [False] * len(texts)
            real = [k for k, t in enumerate(texts) if m and t and has_letter(t)]
            for at in range(0, len(real), 256):
                own = real[at : at + 256]
                best, sure, gap = m.decode(np.stack([vector(texts[k].encode()) for k in own]))
                for k, l, s, g in zip(own, best.tolist(), sure.tolist(), gap.tolist(), strict=True):
                    lang[k], score[k], unsure[k] = m.languages[l], s, g < least_gap
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*names, *out_cols])
        tidy()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{out_cols[0]}` string, `{out_cols[1]}` double, `{out_cols[2]}` boolean")
