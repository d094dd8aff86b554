"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: which words, word stems, pairs of neighbours and pairs with one word between
occur in it, hashed to 2^20 places. Learning keeps a rate for every coordinate and an L1 threshold, so
most weights are exactly zero and the rest is small enough to broadcast.

Learning uses at most about ``MAX_ROWS`` labelled rows (a documented bound for the fit): the
labels are thinned by hash, features are made in parallel, and one task runs the sequential
updates in a fixed order. Scoring reads every whole text where it lies.

Defined results: null and empty texts have no feature and score the learned bias; rows that
can't be labelled (null id or label) don't teach; without any labelled row all scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.words import ALNUM, chunks, hash_spans, slices, words

BITS = 20
#: A word's first so many bytes are features as well: inflected words share them.
STEMS = (4, 5, 6)
MAX_ROWS = 12_000
EPOCHS = 3
#: Text whose features are made at once: six for a word, of some twelve bytes each.
CHUNK_BYTES = 1 << 20
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first and last row, row from first, feature) by chunk: every word, pair and skip pair,
    repeats included."""
    shift = np.uint64(64 - BITS)
    for chunk in chunks(column, limit=CHUNK_BYTES):
        found = words(chunk, ALNUM)
        h, row = hash_spans(chunk.data, found.starts, found.ends), found.rows().astype(np.int32)
        rows, feats = [row], [((h * _PAIR) >> shift).astype(np.int32)]
        length = found.ends - found.starts
        for size in STEMS:
            long = np.flatnonzero(length >= size)
            stem = hash_spans(chunk.data, found.starts[long], found.starts[long] + size, size)
            rows.append(row[long])
            feats.append(((stem * _SKIP) >> shift).astype(np.int32))
        for gap, salt in ((1, _PAIR), (2, _SKIP)):
            if len(h) > gap:
                same = row[gap:] == row[:-gap]
                pair = (h[:-gap] * salt + (h[gap:] ^ (h[gap:] >> np.uint64(31)))) * _SKIP
                rows.append(row[gap:][same])
                feats.append((pair[same] >> shift).astype(np.int32))
        yield chunk.first, chunk.last, np.concatenate(rows), np.concatenate(feats)


@dataclass
class Weights:
    place: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, column: pa.Array, table: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text; ``table`` is the weights spread out."""
        total = np.full(len(column), self.bias)
        for first, last, row, feat in features(column):
            some = np.flatnonzero(table[feat])
            # A feature counts once in a text.
            once = np.unique((row[some].astype(np.int64) << BITS) | feat[some])
            at = once >> BITS
            total[first:last] += np.bincount(at, table[once & ((1 << BITS) - 1)], minlength=last - first)
        return 1 / (1 + np.exp(-total))

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.place] = self.weight
        return out


def ftrl(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, epochs: int = EPOCHS) -> Weights:
    """Sequential FTRL-proximal over rows of distinct features."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias, bias_n = float(np.log(share / (1 - share))), 0.0

    def weight(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, y in zip(rows, labels):
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            n[at] = after
            bias_n += g * g
            bias -= alpha / (beta + np.sqrt(bias_n)) * g
    place = np.flatnonzero(np.abs(z) > l1)
    return Weights(place, weight(place), bias)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS) -> Weights:
    """Weights from the labelled rows that ``learn`` (over the label's id) allows."""
    taught = labels.where(learn & F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y")
    )
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))
    few = _thinned(taught, taught.count(), max_rows, F.pmod(F.xxhash64("__id"), F.lit(1 << 30)))
    few = _thinned(few, few.count(), 2 * max_rows, spread)  # one id with very many labels
    pairs = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(few), "__id")
    matched = pairs.select("__id").count()
    # An id with very many rows could exceed the bound.
    pairs = _thinned(pairs, matched, 2 * max_rows, spread)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0, 2 * CHUNK_BYTES)):
            sets: list[np.ndarray] = []
            for first, last, row, feat in features(batch.column(0)):
                both = np.unique((row.astype(np.int64) << BITS) | feat)
                cut = np.searchsorted(both >> BITS, np.arange(1, last - first))
                sets += np.split((both & ((1 << BITS) - 1)).astype(np.int32), cut)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(offsets), values)], ["y", "key", "features"]
            )

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y, keys = [], [], []
        for batch in batches:
            column = batch.column(2)
            rows += [column[i].values.to_numpy() for i in range(batch.num_rows)]
            y += batch.column(0).to_pylist()
            keys += batch.column(1).to_pylist()
        if not rows:
            return
        order = sorted(range(len(rows)), key=lambda i: (keys[i], y[i], len(rows[i])))
        w = ftrl([rows[i] for i in order], np.array([y[i] for i in order], float))
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.place.tolist()], pa.list_(pa.int32())), pa.array([w.weight.tolist()], pa.list_(pa.float64())), pa.array([w.bias])],
            ["place", "weight", "bias"],
        )

    made = pairs.select("__text", F.col("__y"), F.xxhash64("__id", F.lit(5)).alias("key")).mapInArrow(featured, "y int, key long, features array<int>")
    # Bounded by max_rows: the updates are sequential, so one task makes them.
    got = made.repartition(1).mapInArrow(learned, "place array<int>, weight array<double>, bias double").collect()
    if not got:
        return Weights(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    return Weights(np.array(got[0].place, np.int64), np.array(got[0].weight), got[0].bias)


def _thinned(df: DataFrame, n: int, most: int, number: Column) -> DataFrame:
    """Rows whose ``number`` (below 2^30) is in the share that leaves about ``most``."""
    return df if n <= most else df.where(number < int((1 << 30) * most / n))


def predict(docs: DataFrame, model: Weights, keep: tuple[str | Column, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and ``score``, ``predicted`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    part = docs.select(*keep, F.col(text).alias("__text"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.table()
        for batch in batches:
            score = shared.value.scores(batch.column(batch.num_columns - 1), table)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                [*batch.schema.names[:-1], "score", "predicted"],
            )

    return part.mapInArrow(answer, part.drop("__text").schema.add("score", "double").add("predicted", "integer"))


def accepted(docs: DataFrame, model: Weights, text: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted toxic; the rest as it is."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.table()
        for batch in batches:
            yield batch.filter(pa.array(shared.value.scores(batch.column(at), table) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
