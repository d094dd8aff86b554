"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint's bit is set where over half of the hashes of the row's word shingles have it.
Fingerprints that differ in at most ``radius`` bits are linked; a component is what links
reach. Candidates come from tables: of ``radius + 2`` bit ranges at least two are equal in any
linked pair, so every pair of ranges is a table and each fingerprint is in one bucket of each.

Within buckets comparison is bit-sliced: the bits of 64 fingerprints stand in one word per bit
plane. A shift by s compares every fingerprint with the one s places on, for all buckets of a
task at once; carry-save counters add the differing planes up, and words in which every pair
is beyond the radius are abandoned. Only links that join two groups are written out.

Distinct fingerprints are compared, so copies cost nothing. A bucket of more than ``most``
distinct fingerprints is not compared pair by pair: its fingerprints meet under each value at
most half the radius away (1 + 64 values for a radius of 2 or 3), in groups no larger than
that; for an even radius this finds the same links exactly. Links, components and fingerprints
stay distributed.

Rows without words have fingerprint zero. Null ids take part; a component's id is its smallest
non-null id. Repeated rows are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.components import components
from demandspark.llm.store import free_name, row_key, written
from demandspark.llm.words import NOT_SPACE, PAD, Chunk, chunks, words, xxh64

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Distinct fingerprints in a bucket that one task compares pair by pair.
MOST = 1 << 13
#: Rows of one fingerprint that may meet in one task.
HOT = 1 << 20
_ROWS = 1 << 16
_ELEMENTS = 1 << 14
#: A byte's bits, each as a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def shingle_hashes(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of a chunk, and how many each row has."""
    found = words(chunk, NOT_SPACE)
    lengths = found.ends - found.starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    # The words again, with one space after each.
    joined = np.full((int(ends[-1]) + 1 if len(ends) else 0) + PAD, 0x20, np.uint8)
    letter = np.ones(len(joined), bool)
    letter[ends] = False
    letter[len(joined) - PAD :] = False
    data = chunk.data[: chunk.size]
    joined[letter] = data[NOT_SPACE[data]]
    n_words = found.counts
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    first = np.repeat(found.row_first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    last = first + np.repeat(np.minimum(n_words, size), n) - 1
    return xxh64(joined, starts[first], ends[last], SEED), n


def fingerprint_of(column: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Unsigned fingerprint of each text."""
    out = [np.zeros(0, np.uint64)]
    for chunk in chunks(column):
        hashes, n = shingle_hashes(chunk, size)
        full = np.flatnonzero(n)
        fp = np.zeros(len(n), np.uint64)
        if len(full):
            n = n[full]
            # At most 255 hashes are added up in bytes, then those sums by row.
            pieces = -(-n // 255)
            piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts = np.repeat(np.cumsum(n) - n, pieces) + 255 * piece
            sums = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], starts, axis=0)
            counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), np.cumsum(pieces) - pieces, axis=0, dtype=np.int64)
            fp[full] = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        out.append(fp)
    return np.concatenate(out)


def fingerprints(docs: DataFrame, keep: tuple[str | Column, ...], text: str = "text", name: str = "fp") -> DataFrame:
    """``keep`` and the fingerprint as a signed long, for every row."""
    part = docs.select(*keep, F.col(text).alias("__text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprint_of(batch.column(batch.num_columns - 1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], [*batch.schema.names[:-1], name])

    return part.mapInArrow(each, part.drop("__text").schema.add(name, "long"))


def tables(radius: int) -> list[int]:
    """Bit masks: any two fingerprints within the radius agree under at least one of them."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    ranges = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(ranges, 2)]


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class _Groups:
    """Sets of rows, each known by its first row."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[a], root[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root[:] = up


def linked(fps: np.ndarray, bucket: np.ndarray, radius: int) -> np.ndarray:
    """For each of the fingerprints, sorted by bucket, the first row it is linked to through
    pairs within the radius in its own bucket."""
    n = len(fps)
    groups = _Groups(n)
    if n < 2:
        return groups.root
    last = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]), n - 1)
    room = np.repeat(last, np.diff(np.concatenate([[-1], last]))) - np.arange(n)
    n_words = -(-n // 64)
    planes = np.zeros((64, n_words + int(room.max()) // 64 + 2), np.uint64)
    padded = np.zeros(n_words * 64, np.uint64)
    padded[:n] = fps
    for b in range(64):
        bits = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        planes[b, :n_words] = np.packbits(bits, bitorder="little").view("<u8")
    room = np.pad(room, (0, n_words * 64 - n), constant_values=0).reshape(-1, 64)
    widest = room.max(1)
    n_counters = int(radius).bit_length() + 1
    shift, most_room = 1, int(room.max())
    while shift <= most_room:
        # So many shifts at once that the arrays below are of some size.
        words_left = int((widest >= shift).sum())
        upto = min(most_room, shift + max(0, _ELEMENTS // max(words_left, 1) - 1))
        by_shift = [np.flatnonzero(widest >= s) for s in range(shift, upto + 1)]
        active = np.concatenate(by_shift)
        step = np.repeat(np.arange(shift, upto + 1), [len(x) for x in by_shift])
        alive = np.packbits(room[active] >= step[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        counters = [np.zeros(len(active), np.uint64) for _ in range(n_counters)]
        for b in range(64):
            at, low = active + (step >> 6), (step & 63).astype(np.uint64)
            there = (planes[b, at] >> low) | (planes[b, at + 1] << (np.uint64(64) - low))
            carry = planes[b, active] ^ there
            for c in counters:
                c ^= carry
                carry &= ~c
            alive &= ~(carry | _above(counters, radius))
            if b % 4 == 3:
                still = np.flatnonzero(alive)
                if len(still) < 0.8 * len(active):
                    active, step, alive, counters = active[still], step[still], alive[still], [c[still] for c in counters]
                if not len(active):
                    break
        if len(active):
            hit = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, lane = np.nonzero(hit)
            first = active[word] * 64 + lane
            groups.join(first, first + step[word])
        shift = upto + 1
    return groups.root


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over the radius."""
    over = np.zeros_like(counters[0])
    equal = ~over
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            over |= equal & counters[k]
            equal &= ~counters[k]
    return over


def links(distinct: DataFrame, radius: int = RADIUS, most: int = MOST, name: str = "fp") -> DataFrame:
    """(a, b) pairs of distinct fingerprints whose components are those of all links."""
    fp = F.col(name)
    rows = [F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(_long(m))).alias("key")) for i, m in enumerate(tables(radius))]
    keyed = distinct.select(fp, F.explode(F.array(*rows)).alias("at")).select("at.t", "at.key", name)
    large = keyed.groupBy("t", "key").count().where(F.col("count") > most)
    # As many rows as buckets over the limit: at most tables * fingerprints / most.
    large = written(large.select("t", "key"), "large-buckets")
    normal = keyed.join(large, ["t", "key"], "left_anti")
    schema = "a long, b long"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= _ROWS:
                t, key, fps = (np.concatenate(x) for x in zip(*held))
                cut = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1]) + 1 if (t[0], key[0]) != (t[-1], key[-1]) else 0
                if cut:
                    yield _found(t[:cut], key[:cut], fps[:cut], radius)
                held, size = [[t[cut:], key[cut:], fps[cut:]]], len(t) - cut
        if size:
            yield _found(*(np.concatenate(x) for x in zip(*held)), radius)

    compared = normal.repartition("t", "key").sortWithinPartitions("t", "key", name).mapInArrow(compare, schema)
    if not large.head(1):
        return compared
    wide = keyed.join(large, ["t", "key"], "left_semi").select(name).distinct()
    near = [fp, *(fp.bitwiseXOR(F.lit(_long(1 << i))) for i in range(64))]
    if radius not in (0, 2):
        raise ValueError("buckets over the limit can be linked exactly for a radius of 0 or 2")
    met = wide.select(fp, F.explode(F.array(*near) if radius else F.array(fp)).alias("value")).groupBy("value").agg(F.collect_list(name).alias("all"))
    star = met.where(F.size("all") > 1).select(F.array_min("all").alias("b"), F.explode("all").alias("a"))
    return compared.unionByName(star.where("a <> b").select("a", "b"))


def _found(t: np.ndarray, key: np.ndarray, fps: np.ndarray, radius: int) -> pa.RecordBatch:
    bucket = np.cumsum(np.append(0, (t[1:] != t[:-1]) | (key[1:] != key[:-1])))
    # Buckets of one are most of them and have nothing to compare.
    several = np.bincount(bucket)[bucket] > 1
    fps, bucket = fps[several], bucket[several]
    root = linked(fps.view(np.uint64), bucket, radius)
    at = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(fps[at]), pa.array(fps[root[at]])], ["a", "b"])


def classes(fps: DataFrame, smallest: Column, radius: int = RADIUS, name: str = "fp", most: int = MOST) -> DataFrame:
    """(fp, copies, first): for each distinct fingerprint its rows and the smallest value of
    ``smallest`` over its component."""
    return known_classes(fps, smallest, lambda distinct: links(distinct, radius, most, name), name)


def known_classes(fps: DataFrame, smallest: Column, find_links: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``classes`` for links of any kind, found from the distinct values of ``name``."""
    distinct = written(fps.groupBy(name).agg(F.min(smallest).alias("own"), F.count("*").alias("copies")), "distinct")
    found = components(find_links(distinct.select(name)))
    known = distinct.join(found.select(F.col("node").alias(name), "root"), name, "left").withColumn("root", F.coalesce("root", name))
    known = written(known, "known")
    first = known.groupBy("root").agg(F.min("own").alias("first"))
    return known.join(first, "root").select(name, "copies", "first")


def with_class(fps: DataFrame, known: DataFrame, name: str = "fp", hot: int = HOT) -> DataFrame:
    """The rows of ``fps`` with ``first`` of their fingerprint; ``known`` as ``classes`` gives it.

    Fingerprints of more than ``hot`` rows, at most one for so many rows of the table, are
    broadcast, so that their copies stay where they are.
    """
    known = written(known, "classes")
    many = known.where(F.col("copies") > hot).select(name, "first")
    rest = known.select(name, "first")
    if not many.head(1):
        return fps.join(rest, name)
    many = F.broadcast(many)
    return fps.join(many, name).unionByName(fps.join(many, name, "left_anti").join(rest, name))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(id, fingerprint, component_id) for every row."""
    fps = written(fingerprints(docs, (id_col,), text, "__fp"), "fingerprints")
    known = classes(fps, F.col(id_col), radius, "__fp")
    hex_ = F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint")
    return with_class(fps, known, "__fp", hot).select(id_col, hex_, F.col("first").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null ids last), and of
    those the first in the table."""
    key = free_name(docs, "row_key")
    fps = written(fingerprints(docs, (F.col(id_col).alias("id"), row_key(docs).alias("key")), text), "fingerprints")
    order = F.struct(F.col("id").isNull(), "id", "key")
    known = classes(fps, order, radius)
    dropped = with_class(fps, known, "fp", hot).where(F.col("first.key") != F.col("key")).select(F.col("key").alias(key))
    return docs.withColumn(key, row_key(docs)).join(written(dropped, "dropped"), key, "left_anti").drop(key)
