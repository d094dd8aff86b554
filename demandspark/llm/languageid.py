"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary classifier over hashed byte
n-grams tells whether a text belongs to the languages whose codeword has that bit set: its
weight for an n-gram is the log ratio of the n-gram's frequency in the two sets. The language
whose codeword loses least against the bits' margins wins (loss-weighted decoding); a small
lead over the runner-up marks the answer as ambiguous.

Counts come from all rows that may be learned from, summed in every task before they are
shuffled; what reaches the driver is at most languages x buckets numbers. One row is one
answer, so null ids, repeated rows and extra columns change nothing. A text that is null or
has no letter is ``und``; so is every text when nothing can be learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.words import Chunk, chunks, lanes

UNDETERMINED = "und"
BUCKETS = 1 << 14
ORDERS = (2, 3, 4)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: ASCII that is no letter counts as a space.
_FOLD = np.array([b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)


def _buckets(chunk: Chunk, order: int) -> np.ndarray:
    """The bucket of the n-gram at each byte; BUCKETS where it would cross the row's end."""
    n = chunk.size
    gram = lanes(chunk.data)[:n] & np.uint64((1 << (8 * order)) - 1)
    with np.errstate(over="ignore"):
        out = ((gram + np.uint64(order << 56)) * _MIX >> np.uint64(64 - 14)).astype(np.int32)
    for back in range(1, order):
        at = chunk.offsets[1:] - back
        out[at[at >= chunk.offsets[:-1]]] = BUCKETS
    return out


def _folded(column: pa.Array) -> Iterator[Chunk]:
    for chunk in chunks(pc.utf8_lower(column), lower=False):
        chunk.data[: chunk.size] = _FOLD[chunk.data[: chunk.size]]
        yield chunk


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over all rows of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.asarray(batch.column(1).to_pylist(), dtype=object)
            for one in sorted(set(langs)):
                of_lang = batch.column(0).filter(pa.array(langs == one))
                total = found.setdefault(one, np.zeros(BUCKETS, np.int64))
                for chunk in _folded(of_lang):
                    for order in ORDERS:
                        total += np.bincount(_buckets(chunk, order), minlength=BUCKETS + 1)[:BUCKETS]
        for one, total in found.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([one] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at])],
                ["lang", "bucket", "n"],
            )

    part = docs.select(text, lang).where(F.col(lang).isNotNull())
    counted = part.mapInArrow(count, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n_langs: int, seed: int = 7) -> np.ndarray:
    """One row of +1 / -1 for each language.

    Up to five languages get every split into two sets; more get random splits, of which the
    set with the largest smallest distance between two codewords is taken.
    """
    if n_langs < 2:
        return np.ones((n_langs, 1))
    if n_langs <= 5:
        n_bits = 2 ** (n_langs - 1) - 1
        bits = (np.arange(1, n_bits + 1)[:, None] >> np.arange(n_langs)) & 1
        return np.where(bits.T, 1.0, -1.0)
    n_bits = max(15, int(np.ceil(6 * np.log2(n_langs))))
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n_langs, n_bits))
        code[:, np.abs(code.sum(0)) == n_langs] *= np.where(np.arange(n_langs) % 2, 1, -1)[:, None]
        apart = (n_bits - code @ code.T) / 2 + n_bits * np.eye(n_langs)
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    """Learned languages, their codewords, and per bit the weights, scale and share of the loss."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def decode(self, means: np.ndarray, sharp: float) -> np.ndarray:
        """Loss of each language (columns) for the mean weights by row and bit."""
        margin = (means - self.shift) * self.scale
        loss = np.logaddexp(0, -sharp * margin[:, None, :] * self.code[None]) * self.trust
        return loss.sum(-1)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", smooth: float = 0.5) -> Model:
    """Classifiers of all bits from the n-gram counts of every row with a language."""
    rows = gram_counts(docs, text, lang).toPandas()
    langs = sorted(rows["lang"].unique()) if len(rows) else []
    freq = np.full((len(langs), BUCKETS), smooth)
    for i, one in enumerate(langs):
        of = rows[rows["lang"] == one]
        freq[i, of["bucket"]] += of["n"]
    freq /= freq.sum(1, keepdims=True)
    code = codewords(len(langs))
    n_bits = code.shape[1]
    weights, shift, scale, trust = np.zeros((BUCKETS + 1, n_bits)), np.zeros(n_bits), np.ones(n_bits), np.ones(n_bits)
    for b in range(n_bits) if len(langs) > 1 else ():
        on, off = freq[code[:, b] > 0].mean(0), freq[code[:, b] < 0].mean(0)
        weights[:BUCKETS, b] = np.log(on / off)
        expected = freq @ weights[:BUCKETS, b]
        low, high = expected[code[:, b] > 0].min(), expected[code[:, b] < 0].max()
        shift[b] = (low + high) / 2
        half = max((low - high) / 2, 1e-9)
        scale[b], trust[b] = 1 / half, half
    trust /= trust.mean() if len(langs) else 1
    return Model(list(langs), code, weights.astype(np.float32), shift, scale, trust)


def predict(
    docs: DataFrame, model: Model, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",),
    sharp: float = 4.0, lead: float = 1.0,
) -> DataFrame:
    """``keep`` and ``lang_pred``, ``score`` (0 to 1), ``ambiguous`` for every row.

    ``ambiguous``: the best codeword's loss is less than ``lead`` under the next one's, or there
    is nothing to go by. Equal losses: the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    part = docs.select(*keep, F.col(text).alias("__text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    kept = part.drop("__text", "__letter").schema

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNDETERMINED], dtype=object)
        for batch in batches:
            means = []
            for chunk in _folded(batch.column(batch.num_columns - 2)):
                sums = np.zeros((chunk.last - chunk.first, m.code.shape[1]))
                grams = np.zeros(len(sums))
                size = np.diff(chunk.offsets)
                full = np.flatnonzero(size)
                for order in ORDERS:
                    w = m.weights[_buckets(chunk, order)]
                    if len(full):
                        sums[full] += np.add.reduceat(w, chunk.offsets[:-1][full], axis=0, dtype=np.float64)
                    grams += np.maximum(size - order + 1, 0)
                means.append(sums / np.maximum(grams, 1)[:, None])
            n = batch.num_rows
            letter = np.asarray(batch.column(batch.num_columns - 1).to_pylist(), dtype=bool)
            best, score, unsure = np.full(n, len(m.langs)), np.zeros(n), np.ones(n, bool)
            if m.langs and n:
                loss = m.decode(np.concatenate(means), sharp)
                order = np.argsort(loss, axis=1, kind="stable")
                low = loss.min(1, keepdims=True)
                p = np.exp(low - loss)
                best = np.where(letter, order[:, 0], len(m.langs))
                score = np.where(letter, 1 / p.sum(1), 0.0)
                if len(m.langs) > 1:
                    ranked = np.take_along_axis(loss, order[:, :2], 1)
                    unsure = ~letter | (ranked[:, 1] - ranked[:, 0] < lead)
                else:
                    unsure = ~letter
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(names[best], pa.string()), pa.array(score), pa.array(unsure)],
                [*batch.schema.names[:-2], "lang_pred", "score", "ambiguous"],
            )

    out = kept.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return part.mapInArrow(answer, out)
