"""Exact top-k by inner product: columnar branch and bound.

Every component x becomes floor(1024 * x). A task holds candidates dimension by dimension.
For each query it adds up the product over one block of dimensions after another; what the
dimensions still to come can add is at most the product of the two remaining norms
(Cauchy-Schwarz), so candidates whose total can't reach the task's k-th best are dropped and
the rest compacted before the next block is read. The best k of each task meet in a window.

Queries go to the tasks in blocks of bounded size; a block's best are written and the block is
released before the next one is read. Vectors that are null or hold null or non-finite
components take no part; neither do vectors of another length than the query's. Queries are rows
of the table, told apart by their place in it, so repeated ids ask each by themselves and only
the query's own row is no candidate for it. Queries from elsewhere have no own row: rows of their
id are left out. Ties go to the smaller id. A row without id is no query and no candidate.
Products are exact (Python integers where neither doubles nor longs hold them) up to 38 digits, at
which they are held; a score beyond a long is shown as the nearest long, ranks go by the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandspark.llm.store import row_key, written

QUERY_BLOCK = 4096
ROWS = 8192
DIMS = 8
SCALE = 1024
_LONG, _MOST = (1 << 63) - 1, 10**38 - 1


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part and their place (file, row); ``v`` as doubles."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & good).select(
        F.col(id_col).cast("long").alias("id"), v.alias("v"), row_key(vectors).alias("place")
    ).select("id", "v", "place.*")


def _matrices(ids: pa.Array, column: pa.Array, file: pa.Array, row: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, integers by dimension and row, places) for each length of vector."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    ids, size = ids.to_numpy(zero_copy_only=False), np.diff(offsets)
    places = np.stack([file.to_numpy(), row.to_numpy()], 1)
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        part = values[offsets[rows][:, None] + np.arange(length)[None]] if length else np.zeros((len(rows), 0))
        # Doubles times a power of two: rounding down is exact.
        yield ids[rows], np.ascontiguousarray(np.floor(SCALE * part).T), places[rows]


class _Best:
    """The best k (score, id) of one query so far; scores beyond longs are Python integers."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def floor(self) -> float:
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        if score.dtype == object:
            order = np.array(sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))[: self.k], int)
        else:
            order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


def _rest(m: np.ndarray) -> np.ndarray:
    """Norm of each column over the dimensions from each block's start on; one row more, zero."""
    squares = np.add.reduceat(m * m, np.arange(0, len(m), DIMS), axis=0)
    tail = np.cumsum(squares[::-1], axis=0)[::-1]
    return np.sqrt(np.vstack([tail, np.zeros((1, m.shape[1]))])) * (1 + 1e-9)


def _whole(x: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers as Python integers."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def search(q: np.ndarray, others: np.ndarray, q_rest: np.ndarray, ids: np.ndarray, m: np.ndarray, rest: np.ndarray, best: _Best) -> None:
    """One query against a block of candidates (dimension by row); ``others``: those that may be."""
    alive = np.flatnonzero(others)
    most = max(np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * max(len(q), 1), 1)
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    total = np.zeros(len(alive), kind)
    for b, d in enumerate(range(0, len(q), DIMS)):
        block = m[d : d + DIMS] if len(alive) == m.shape[1] else m[d : d + DIMS, alive]
        part = q[d : d + DIMS]
        if kind is np.int64:
            part, block = part.astype(np.int64), block.astype(np.int64)
        elif kind is object:
            part, block = _whole(part), _whole(block)
        total = total + part @ block
        about = total.astype(np.float64)
        with np.errstate(all="ignore"):
            reach = about + q_rest[b + 1] * rest[b + 1, alive] + 1e-3 + 1e-9 * np.abs(about)
        keep = ~(reach < best.floor)
        if not keep.all():
            alive, total = alive[keep], total[keep]
        if not len(alive):
            return
    if kind is not object and len(alive) > 4 * best.k:  # all that reach the k-th largest score, ties included
        keep = total >= np.partition(total, len(total) - best.k)[len(total) - best.k]
        alive, total = alive[keep], total[keep]
    best.add(total if kind is object else total.astype(np.int64), ids[alive])


def top_k(vectors: DataFrame, queries: DataFrame | Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all ``vectors`` for each of ``queries``, a
    condition on the table's rows or rows from elsewhere."""
    spark = vectors.sparkSession
    everything, inside = usable(vectors, id_col, vector), isinstance(queries, Column)
    asked = usable(vectors.where(queries) if inside else queries, id_col, vector)
    n_blocks = max(1, -(-asked.count() // (QUERY_BLOCK // 2)))
    parts = []
    for block in range(n_blocks):
        # About half of QUERY_BLOCK by hash: a bounded part of the query set at a time.
        shared = spark.sparkContext.broadcast(asked.where(F.pmod(F.xxhash64("id", "file", "row"), F.lit(n_blocks)) == block).toArrow())

        def best_of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            by_length: dict[int, list] = {}
            for ids, m, places in _matrices(*(asked.column(i).combine_chunks() for i in range(4))) if len(asked) else ():
                by_length[len(m)] = [(int(i), places[j], m[:, j], _rest(m[:, j : j + 1])[:, 0] if len(m) else np.zeros(1), _Best(k)) for j, i in enumerate(ids)]
            for batch in batches:
                for ids, m, places in _matrices(*batch.columns):
                    for at in range(0, len(ids), ROWS):
                        part, own, here = np.ascontiguousarray(m[:, at : at + ROWS]), ids[at : at + ROWS], places[at : at + ROWS]
                        rest = _rest(part) if len(part) else np.zeros((1, len(own)))
                        for i, place, q, q_rest, best in by_length.get(len(m), ()):
                            others = (here != place).any(1) if inside else own != i
                            search(q, others, q_rest, own, part, rest, best)
            found = [(i, place, best) for group in by_length.values() for i, place, _, _, best in group if len(best.id)]
            if found:
                n = [len(b.id) for _, _, b in found]
                places = np.repeat(np.stack([p for _, p, _ in found]), n, axis=0)
                exact = [Decimal(min(max(int(x), -_MOST), _MOST)) for _, _, b in found for x in b.score]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([i for i, _, _ in found], n), pa.int64()), pa.array(places[:, 0]), pa.array(places[:, 1]),
                        pa.array(np.concatenate([b.id for _, _, b in found])), pa.array(exact, pa.decimal128(38, 0)),
                    ],
                    ["query_id", "file", "row", "vec_id", "exact"],
                )

        best = everything.mapInArrow(best_of, "query_id long, file long, row long, vec_id long, exact decimal(38,0)")
        parts.append(written(best, "best"))
        shared.unpersist()
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    order = Window.partitionBy("query_id", "file", "row").orderBy(F.desc("exact"), "vec_id")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.least(F.greatest("exact", F.lit(Decimal(-_LONG - 1))), F.lit(Decimal(_LONG))).cast("long").alias("score")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score)
