"""Near-duplicates by exact Jaccard similarity of word shingles, compared in bit planes.

Two rows are linked if the sets of their five-word shingles have a Jaccard similarity of at
least ``SIMILARITY``; a group is what links reach. No pair is missed: all shingles stand in one
order, and two sets that are that similar have a shingle in common among the first
``n - ceil(0.8 n) + 1`` of each. Those first shingles are the keys under which sets meet.
Shingles that a sample finds in several rows come last in the order, so that they are keys only
where a row has hardly any others.

Distinct sets are compared, so copies cost nothing. Every set has a parity sketch of about one
bit for each of its shingles: sets differ in at least as many shingles as their sketches do in
bits, so pairs whose sketches are too far apart go without losing any link, and only what is
left is compared as whole sets.

* Under a key of up to ``FEW`` sets all pairs are candidates.
* Under a larger one each set first meets one of them, another one for every key. Common shingles
  are never gathered: their rows stay where they are and get the one set by broadcast.
* Sets of a large key that are still in different groups are compared in blocks of ``BLOCK`` sets
  by bit-sliced sketches: one word per plane holds a bit of 64 sets, carry-save counters add the
  differing planes up, and words in which all sets are beyond their radius are abandoned. The
  largest group under a key is compared with the others, not with itself. Each set's closest one is
  tried first, round by round while that joins groups, then all pairs that are left. Where unlike
  sets fill a key, comparing is quadratic in their number, spread over block pairs.

Shingles and sets are told apart by 64-bit hashes. Rows without words are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.components import components
from demandspark.llm.simhash import known_classes, shingle_hashes, with_class
from demandspark.llm.store import free_name, looked_up, row_key, temporary, written
from demandspark.llm.words import chunks, slices

SHINGLE = 5
#: As a fraction, so that comparing is exact.
SIMILARITY = (4, 5)
#: Sets under one key that are compared pair by pair at once.
FEW = 16
#: Rows in a sample of one in so many are looked through for common shingles.
SAMPLED = 16
#: A shingle in so many sampled rows is common; more if over ``MOST_COMMON`` are.
COMMON = 3
MOST_COMMON = 1 << 18
#: Sets of a large key that are compared with each other at once.
BLOCK = 1 << 12
#: Sets asked for by a broadcast, of about 100 bytes each; more are joined.
BROADCAST_SETS = 1 << 18
#: Bytes of text at once, of which each takes about fifty bytes of numbers.
_CHUNK = 1 << 20
_ROWS = 1 << 16
_PAIRS = 1 << 16
_LEAST_SKETCH = 512
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _M1
        h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def sets_of(column: pa.Array, common: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(shingles row by row in the order of all shingles, how many each row has, sets' hashes)."""
    for chunk in chunks(column, limit=_CHUNK):
        hashes, n = shingle_hashes(chunk, SHINGLE)
        row = np.repeat(np.arange(len(n)), n)
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes if len(common) else np.zeros(len(hashes), bool)
        order = np.lexsort((hashes, late, row))
        row, hashes = row[order], hashes[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        row, hashes = row[first], hashes[first]
        n = np.bincount(row, minlength=len(n))
        sig = np.zeros(len(n), np.uint64)
        full = np.flatnonzero(n)
        if len(full):
            # A sum is the same in every order.
            sig[full] = _mixed(np.add.reduceat(_mixed(hashes), (np.cumsum(n) - n)[full]) + n[full].astype(np.uint64))
        yield hashes, n, sig


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def common_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles of many rows, sorted; at most ``MOST_COMMON``. They set the order only."""
    part = docs.select(F.pmod(F.xxhash64(row_key(docs)), F.lit(SAMPLED)).alias("s"), F.col(text).alias("t")).where("s = 0").select("t")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, _, _ in sets_of(batch.column(0), np.zeros(0, np.uint64)):
                values, counts = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([_signed(values), pa.array(counts.astype(np.int64))], ["h", "n"])

    counted = part.mapInArrow(each, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted, least = written(counted.where(F.col("n") >= COMMON), "common-shingles"), COMMON
    while counted.where(F.col("n") >= least).count() > MOST_COMMON:
        least *= 2
    found = counted.where(F.col("n") >= least).select("h").toArrow().column("h").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _sketches(hashes: np.ndarray, n: np.ndarray) -> pa.Array:
    """The parity sketch of each row: a power of two of bits, ``_LEAST_SKETCH`` and its size at least."""
    bits = np.maximum(_LEAST_SKETCH, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    first = np.append(0, np.cumsum(bits))
    at = np.repeat(first[:-1], n) + (hashes & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(at, minlength=first[-1]) & 1).astype(np.uint8)
    data = np.packbits(parity, bitorder="little")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((first // 8).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _keys(docs: DataFrame, text: str, common: np.ndarray, late: bool) -> DataFrame:
    """(key, sig, n): first shingles of sets, the set and its size, once for each set and task.

    ``late``: those keys that are common shingles, else all others.
    """
    over, under = SIMILARITY

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for hashes, n, sig in sets_of(batch.column(0), common):
                new = np.zeros(len(n), bool)
                new[np.unique(sig, return_index=True)[1]] = True
                new &= np.array([x not in seen for x in sig.tolist()], bool)
                seen.update(sig[new].tolist())
                upto = np.where((n > 0) & new, n + (-over * n) // under + 1, 0)
                row = np.repeat(np.arange(len(n)), upto)
                at = np.arange(len(row)) + np.repeat((np.cumsum(n) - n) - (np.cumsum(upto) - upto), upto)
                key = hashes[at]
                is_late = common[np.minimum(np.searchsorted(common, key), len(common) - 1)] == key if len(common) else np.zeros(len(key), bool)
                some = np.flatnonzero(is_late == late)
                key, row = key[some], row[some]
                yield pa.RecordBatch.from_arrays([_signed(key), _signed(sig[row]), pa.array(n[row].astype(np.int32))], ["key", "sig", "n"])

    return docs.select(F.col(text).alias("t")).mapInArrow(each, "key long, sig long, n int")


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    over, under = SIMILARITY
    return under * np.minimum(a, b).astype(np.int64) >= over * np.maximum(a, b).astype(np.int64)


def _whole(batches: Iterator[pa.RecordBatch], keys: int, limit: int = _ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups, of rows that are sorted by the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < limit:
            continue
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        columns = [rows.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        other = np.flatnonzero(np.any([c != c[-1] for c in columns], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield rows.slice(0, cut)
        held, size = [rows.slice(cut)], rows.num_rows - cut
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b), and the rows (sig, key, n) of keys of more than ``FEW`` sets."""
    for batch in _whole(batches, 1):
        key, sig, n = (c.to_numpy() for c in batch.columns)
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        key, sig, n = key[first], sig[first], n[first]
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(start, len(key)))
        group = np.repeat(np.arange(len(start)), size)
        large = size[group] > FEW
        pairs = []
        small = np.flatnonzero(~large & (size[group] > 1))
        for s in range(1, FEW):
            i = small[small + s < len(key)]
            i = i[key[i] == key[i + s]]
            if not len(i):
                break
            pairs.append((i, i + s))
        at = np.flatnonzero(large)
        if len(at):
            luck = _mixed(sig[at].view(np.uint64) ^ _mixed(key[at].view(np.uint64)))
            order = np.lexsort((luck, group[at]))
            head = np.append(True, np.diff(group[at][order]) > 0)
            centre = np.zeros(len(start), np.int64)
            centre[group[at][order][head]] = at[order][head]
            pairs.append((at, centre[group[at]]))
        a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        good = (a != b) & _similar(n[a], n[b])
        a, b = sig[a[good]], sig[b[good]]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(both[0], sig[at])), pa.array(np.append(both[1], key[at])), pa.array(np.append(np.zeros(both.shape[1], np.int32), n[at]))],
            ["a", "b", "n"],
        )


def _words(sketches: pa.Array) -> np.ndarray:
    """Sketches of one length as rows of 64-bit words."""
    joined = b"".join(sketches.to_pylist())
    return np.frombuffer(joined, "<u8").reshape(len(sketches), -1)


def _folded(rows: np.ndarray, words: int) -> np.ndarray:
    """The sketches in fewer bits."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs (a, b, na, nb, sa, sb) those whose sketches allow them to be similar."""
    over, under = SIMILARITY
    for batch in batches:
        n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
        sizes = [pc.binary_length(batch.column(k)).to_numpy() for k in (4, 5)]
        keep = np.zeros(batch.num_rows, bool)
        for la, lb in {*zip(sizes[0].tolist(), sizes[1].tolist())}:
            at = np.flatnonzero((sizes[0] == la) & (sizes[1] == lb))
            left, right = (_words(batch.column(k).take(pa.array(at))) for k in (4, 5))
            few = min(left.shape[1], right.shape[1])
            apart = np.bitwise_count(_folded(left, few) ^ _folded(right, few)).sum(1, dtype=np.int64)
            keep[at] = (over + under) * apart <= (under - over) * n[at]
        yield batch.select([0, 1]).filter(pa.array(keep))


def _lists(docs: DataFrame, text: str, asked: DataFrame) -> DataFrame:
    """(sig, hashes) of the sets whose ``sig`` is asked for."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                for hashes, n, sig in sets_of(part.column(0), np.zeros(0, np.uint64)):
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), _signed(hashes))
                    yield pa.RecordBatch.from_arrays([_signed(sig), lists], ["sig", "hashes"])

    asked = F.broadcast(asked) if asked.count() <= BROADCAST_SETS else asked
    found = docs.select(F.col(text).alias("t")).mapInArrow(each, "sig long, hashes array<long>").join(asked, "sig", "left_semi")
    return written(found.groupBy("sig").agg(F.any_value("hashes").alias("hashes")), "lists")


def _checked(docs: DataFrame, text: str, pairs: DataFrame) -> DataFrame:
    """The similar ones of the pairs (a, b), by whole sets."""
    over, under = SIMILARITY
    lists = _lists(docs, text, written(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), "asked"))
    left, right = (lists.select(F.col("sig").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    both = F.size(F.array_intersect("ha", "hb"))
    # both / (a + b - both) >= over / under
    similar = (over + under) * both >= over * (F.size("ha") + F.size("hb"))
    return written(pairs.join(left, "a").join(right, "b").where(similar).select("a", "b"), "similar")


def _sliced(left: np.ndarray, right: np.ndarray, row: np.ndarray, word: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of left, row of right, differing bits) of the rows that are within a limit.

    ``right`` (a multiple of 64 rows) is held in planes, 64 rows a word; each of ``row`` is compared
    with the 64 rows of its ``word``, up to its ``limit`` of differing bits.
    """
    n_bits = 64 * right.shape[1]
    if len(row) <= right.shape[1]:
        # Fewer words than planes: not worth a pass over all planes.
        row, other = np.repeat(row, 64), (64 * word[:, None] + np.arange(64)).ravel()
        step = max(1, (1 << 20) // right.shape[1])
        parts = [np.bitwise_count(left[row[k : k + step]] ^ right[other[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(row), step)]
        apart = np.concatenate(parts)
        at = np.flatnonzero(apart <= np.repeat(limit, 64))
        return row[at], other[at], apart[at]
    bits = np.unpackbits(np.ascontiguousarray(right).view(np.uint8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")
    mine = np.ascontiguousarray(np.unpackbits(np.ascontiguousarray(left).view(np.uint8), axis=1, bitorder="little").T)
    n_counters = n_bits.bit_length()
    counters = np.zeros((n_counters, len(row)), np.uint64)
    one, full = np.uint64(1), ~np.uint64(0)
    for b in range(0, n_bits, 2):
        # Two planes and the lowest counter make one sum and one carry.
        x, y = (planes[k][word] ^ (mine[k][row].astype(np.uint64) * full) for k in (b, b + 1))
        low = counters[0]
        half = low ^ x
        carry = (low & x) | (half & y)
        counters[0] = half ^ y
        for k in range(1, int(b + 2).bit_length()):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        if b % 32 == 30:
            over, equal = np.zeros_like(carry), np.full_like(carry, full)
            for k in range(n_counters - 1, -1, -1):
                is_set = ((limit >> k) & 1).astype(np.uint64) * full
                over |= equal & counters[k] & ~is_set
                equal &= ~(counters[k] ^ is_set)
            within = ~over
            alive = np.flatnonzero(within)
            if len(alive) < 0.8 * len(row) or b == n_bits - 2:
                row, word, limit, counters, within = row[alive], word[alive], limit[alive], counters[:, alive], within[alive]
            if not len(row):
                return (np.zeros(0, np.int64),) * 3
    at, lane = np.nonzero(np.unpackbits(within.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    apart = sum(((counters[k][at] >> lane.astype(np.uint64)) & one).astype(np.int64) << k for k in range(n_counters))
    return row[at], word[at] * 64 + lane, apart


def _across(batches: Iterator[pa.RecordBatch], closest: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of one pair of blocks (key, i, j) in different groups that sketches allow to be
    similar; with ``closest`` each left row's nearest one only."""
    over, under = SIMILARITY
    for batch in _whole(batches, 3, 2 * BLOCK):
        keys = [batch.column(k).to_numpy() for k in range(3)]
        item = np.cumsum(np.append(0, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
        is_left = batch.column(3).to_numpy(zero_copy_only=False)
        n, sig, root = (batch.column(k).to_numpy() for k in (4, 5, 6))
        n = n.astype(np.int64)
        size = pc.binary_length(batch.column(7)).to_numpy().astype(np.int64)
        for la in np.unique(size[is_left]):
            for lb in (la // 2, la, 2 * la):
                i, j = np.flatnonzero(is_left & (size == la)), np.flatnonzero(~is_left & (size == lb))
                j = j[np.isin(item[j], item[i])]
                if not len(i) or not len(j):
                    continue
                # Words of 64 rows of one item that are of like size and so have like limits.
                j = j[np.lexsort((n[j], item[j]))]
                cuts = np.flatnonzero(np.append(True, item[j][1:] != item[j][:-1]))
                rows = np.diff(np.append(cuts, len(j)))
                words = -(-rows // 64)
                place = np.arange(len(j)) - np.repeat(cuts, rows) + np.repeat(64 * (np.cumsum(words) - words), rows)
                slot = np.full(64 * int(words.sum()), -1)
                slot[place] = j
                few = min(la, lb) // 8
                right = np.zeros((len(slot), few), np.uint64)
                right[place] = _folded(_words(batch.column(7).take(pa.array(j))), few)
                edge = np.where(slot >= 0, n[slot], 0).reshape(-1, 64).max(1)
                left = _folded(_words(batch.column(7).take(pa.array(i))), few)
                known = np.searchsorted(item[j][cuts], item[i])
                found = (known < len(cuts)) & (item[j][cuts][np.minimum(known, len(cuts) - 1)] == item[i])
                mine = np.flatnonzero(found)
                many = words[known[mine]]
                row = np.repeat(mine, many)
                word = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + np.repeat((np.cumsum(words) - words)[known[mine]], many)
                # So many at once that the left rows' bits are a few megabytes.
                step = min(_PAIRS, max(64, (1 << 19) // la))
                for at in range(0, len(row), step):
                    r, w = row[at : at + step], word[at : at + step]
                    limit = (under - over) * (n[i[r]] + edge[w]) // (over + under)
                    a, b, apart = _sliced(left[r[0] : r[-1] + 1], right, r - r[0], w, limit)
                    a, b = i[a + r[0]], slot[b]
                    good = (b >= 0) & (root[a] != root[b]) & ((over + under) * apart <= (under - over) * (n[a] + n[b])) & _similar(n[a], n[b])
                    a, b, apart = a[good], b[good], apart[good]
                    if closest and len(a):
                        order = np.lexsort((apart / np.maximum(n[a] + n[b], 1), a))
                        first = order[np.append(True, a[order][1:] != a[order][:-1])]
                        a, b = a[first], b[first]
                    a, b = sig[a], sig[b]
                    if len(a):
                        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])


def _rest(large: DataFrame, sketches: DataFrame, closest: bool) -> DataFrame:
    """Pairs (a, b) under the large keys of rows (key, sig, n, root) that are in different groups, all
    or the closest ones."""
    by_root = large.groupBy("key", "root").count()
    top = F.max(F.struct("count", "root")).alias("top")
    keys = by_root.groupBy("key").agg(F.sum("count").alias("total"), top, F.count("*").alias("roots")).where("roots > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    keys = written(keys.select("key", "total", F.col("top.root").alias("most"), blocks(F.col("total") - F.col("top.count")).alias("lefts"), blocks(F.col("total")).alias("rights")), "several")
    rows = looked_up(large, keys, "key", "total").join(sketches.drop("n"), "sig")
    luck = F.xxhash64("sig")
    left = rows.where("root <> most").withColumns({"i": F.pmod(luck, "lefts").cast("int"), "j": F.explode(F.sequence(F.lit(0), F.col("rights") - 1)), "side": F.lit(True)})
    right = rows.withColumns({"i": F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)), "j": F.pmod(luck, "rights").cast("int"), "side": F.lit(False)})
    both = left.unionByName(right).select("key", "i", "j", "side", "n", "sig", "root", "sketch")
    both = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return written(both.mapInArrow(lambda it: _across(it, closest), "a long, b long").distinct(), "across")


def links(docs: DataFrame, sketches: DataFrame, text: str = "text") -> DataFrame:
    """(a, b) pairs of sets whose groups are those of all similar pairs.

    ``sketches``: one row (sig, n, sketch) for each set of ``docs``.
    """
    common = common_shingles(docs, text)
    keyed = _keys(docs, text, common, late=False)
    met = written(keyed.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(_meet, "a long, b long, n int"), "met")
    late = written(_keys(docs, text, common, late=True).distinct(), "late-keys")
    # One row for each common shingle at most, so the broadcast is bounded.
    centre = late.groupBy("key").agg(F.min(F.struct(F.xxhash64("sig", "key").alias("luck"), "sig", "n")).alias("c"), F.count("*").alias("m")).where("m > 1")
    centre = F.broadcast(written(centre.select("key", F.col("c.sig").alias("other"), F.col("c.n").alias("k")), "centres"))
    late = late.join(centre, "key")
    over, under = SIMILARITY
    starred = late.where((F.col("sig") != F.col("other")) & (under * F.least("n", "k").cast("long") >= over * F.greatest("n", "k").cast("long")))
    pairs = met.where("n = 0").select("a", "b").union(starred.select(F.least("sig", "other"), F.greatest("sig", "other"))).distinct()
    left, right = (sketches.select(F.col("sig").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    near = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near, "a long, b long")
    near = written(near, "near")
    found = _checked(docs, text, near)
    large = met.where("n > 0").select(F.col("b").alias("key"), F.col("a").alias("sig"), "n").unionByName(late.select("key", "sig", "n"))
    if not large.head(1):
        return found
    tested, closest = near, True
    while True:
        group = components(found).withColumnRenamed("node", "sig")
        rooted = written(large.join(group, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "large-keys")
        rest = written(_rest(rooted, sketches, closest).join(tested, ["a", "b"], "left_anti"), "rest")
        more = _checked(docs, text, rest) if rest.head(1) else None
        if not closest:
            return found if more is None else found.unionByName(more)
        # Closest pairs first, until they join no more groups; then whatever is left.
        if more is None or not more.head(1):
            closest = False
        else:
            found = written(found.unionByName(more), "found")
        tested = written(tested.unionByName(rest), "tested")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id (null ids last), and of those
    the first in the table."""
    key = free_name(docs, "row_key")
    part = docs.select(F.col(id_col).alias("id"), row_key(docs).alias("key"), F.col(text).alias("t"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 2):
                done = 0
                for hashes, n, sig in sets_of(rows.column(2), np.zeros(0, np.uint64)):
                    own = rows.slice(done, len(n))
                    done += len(n)
                    yield pa.RecordBatch.from_arrays([*own.columns[:2], _signed(sig), pa.array(n.astype(np.int32)), _sketches(hashes, n)], [*batch.schema.names[:2], "sig", "n", "sketch"])

    with temporary(docs.sparkSession):
        schema = part.drop("t").schema.add("sig", "long").add("n", "integer").add("sketch", "binary")
        rows = written(part.mapInArrow(each, schema), "rows")
        sketches = written(rows.groupBy("sig").agg(F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "sketches")
        rows = rows.select("id", "key", "sig")
        order = F.struct(F.col("id").isNull(), "id", "key")
        known = known_classes(rows, order, lambda distinct: links(docs, sketches, text), "sig")
        dropped = with_class(rows, known, "sig").where(F.col("first.key") != F.col("key")).select(F.col("key").alias(key))
        dropped = written(dropped, "dropped", keep=True)
    return docs.withColumn(key, row_key(docs)).join(dropped, key, "left_anti").drop(key)
