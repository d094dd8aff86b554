"""Benchmark decontamination with training suffix arrays.

A shard is one Arrow batch of whole documents. Its words become ids of the benchmark's
vocabulary. Only stretches of at least ``shortest window`` known words can hold a benchmark
window, so the shard's suffix array is built over those stretches (prefix doubling, as deep as
the longest item). Every suffix of every benchmark item is then binary-searched in it, one word
deeper at a time: the range after 13 words is every verbatim occurrence of that window, and the
depth at which the range empties is the suffix's longest match. Occurrences mark document words.

Nothing is shuffled and no document leaves its task. The benchmark goes to the tasks in blocks
of bounded size; several blocks are applied one after another, marks adding up.

Defined results: a null or wordless text has 0 words and is clean; wordless items have no
window; items are named by their id as text ('' if null); repeated items and rows count each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandspark.llm.store import free_name, written
from demandspark.llm.words import ALNUM, Chunk, Words, chunks, hash_spans, words

WINDOW = 13
#: Benchmark text in one block, about.
BLOCK_BYTES = 16 << 20


@dataclass
class Benchmark:
    """A block of items as word ids; 0 parts items, ids start at 1."""

    item_ids: list[str]
    text: np.ndarray
    item_of: np.ndarray
    left: np.ndarray
    window: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    spelling: list[bytes]
    maybe: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @property
    def shortest(self) -> int:
        return int(self.window[self.window > 0].min())

    @property
    def depth(self) -> int:
        return int(self.left.max())


def benchmark_block(item_ids: list[str], texts: pa.Array, window: int = WINDOW) -> Benchmark | None:
    """None if no item has a word."""
    vocabulary: dict[bytes, int] = {}
    text, item_of, left, size = [], [], [], []
    for chunk in chunks(texts):
        found = words(chunk, ALNUM)
        raw = chunk.data.tobytes()
        for row in range(chunk.last - chunk.first):
            at = range(found.row_first[row], found.row_first[row + 1])
            n = len(at)
            for k, w in enumerate(at):
                text.append(vocabulary.setdefault(raw[found.starts[w] : found.ends[w]], len(vocabulary) + 1))
                item_of.append(chunk.first + row)
                left.append(n - k)
                # Only suffixes that begin a window ask for its occurrences.
                size.append(min(window, n) if n - k >= min(window, n) else 0)
    if not text:
        return None
    spelling = list(vocabulary)
    data = np.frombuffer(b"".join(spelling) + bytes(8), np.uint8)
    ends = np.cumsum([len(w) for w in spelling])
    hashes = hash_spans(data, np.concatenate([[0], ends[:-1]]), ends)
    order = np.argsort(hashes, kind="stable")
    maybe = np.zeros(1 << 16, bool)
    maybe[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
    return Benchmark(
        item_ids, np.array(text), np.array(item_of), np.array(left), np.array(size), hashes[order], order + 1, spelling, maybe
    )


def known_words(b: Benchmark, chunk: Chunk, found: Words) -> np.ndarray:
    """The vocabulary id of each word of a chunk, 0 if unknown; equal hashes are compared in full."""
    ids = np.zeros(len(found.starts), np.int32)
    if not len(ids):
        return ids
    h = hash_spans(chunk.data, found.starts, found.ends)
    some = np.flatnonzero(b.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(b.hashes, h[some]), len(b.hashes) - 1)
    hit = b.hashes[at] == h[some]
    ids[some[hit]] = b.ids[at[hit]]
    return ids


def stretches(ids: np.ndarray, rows: np.ndarray, shortest: int) -> np.ndarray:
    """Numbers of the words in runs of at least ``shortest`` known words of one row."""
    known = np.flatnonzero(ids)
    if not len(known):
        return known
    new = np.ones(len(known), bool)
    new[1:] = (np.diff(known) > 1) | (rows[known[1:]] != rows[known[:-1]])
    run = np.cumsum(new) - 1
    return known[np.bincount(run)[run] >= shortest]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in order of their first ``depth`` words, by prefix doubling."""
    rank, k = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        second = np.zeros(len(rank), np.int64)
        second[:-k] = rank[k:] + 1 if k < len(rank) else second[:-k]
        order = np.lexsort((second, rank))
        new = np.ones(len(rank), np.int64)
        new[1:] = (rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
        rank = np.empty(len(rank), np.int64)
        rank[order] = np.cumsum(new)
        k *= 2
        if rank[order[-1]] == len(rank):
            break
    return order


def _bound(text: np.ndarray, sa: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, word: np.ndarray, above: bool) -> np.ndarray:
    """First place in low..high whose word at ``depth`` is not below (``above``: is above) ``word``."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) >> 1
        at = sa[mid] + depth
        there = np.where(at < len(text), text[np.minimum(at, len(text) - 1)], 0)
        before = there <= word[open_] if above else there < word[open_]
        low[open_[before]] = mid[before] + 1
        high[open_[~before]] = mid[~before]


def occurrences(b: Benchmark, text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per suffix of the benchmark: the range of its whole window (empty if none or no window),
    the length of its longest match, and the range of that."""
    n = len(b.text)
    low, high = np.zeros(n, np.int64), np.full(n, len(sa))
    w_low, w_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    longest, active, depth = np.zeros(n, np.int64), np.arange(n), 0
    while len(active):
        word = b.text[active + depth]
        lo = _bound(text, sa, depth, low[active], high[active], word, False)
        hi = _bound(text, sa, depth, lo, high[active], word, True)
        some = lo < hi
        active, lo, hi = active[some], lo[some], hi[some]
        low[active], high[active] = lo, hi
        depth += 1
        longest[active] = depth
        whole = active[b.window[active] == depth]
        w_low[whole], w_high[whole] = low[whole], high[whole]
        active = active[b.left[active] > depth]
    return w_low, w_high, longest, low, high


@dataclass
class Shard:
    """The known stretches of a batch: ids with 0 between runs, and each one's word number."""

    text: np.ndarray
    word_at: np.ndarray
    sa: np.ndarray


def shard(b: Benchmark, ids: np.ndarray, rows: np.ndarray) -> Shard | None:
    at = stretches(ids, rows, b.shortest)
    if not len(at):
        return None
    gap = np.flatnonzero((np.diff(at) > 1) | (rows[at[1:]] != rows[at[:-1]])) + 1
    text = np.append(np.insert(ids[at], gap, 0), 0)
    word_at = np.append(np.insert(at, gap, -1), -1)
    sa = suffix_array(text, b.depth)
    return Shard(text, word_at, sa)


def _in_vocabulary(b: Benchmark, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word ids, row) of all words of a batch; ids of stretches are checked letter by letter."""
    all_ids, all_rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for chunk in chunks(column):
        found = words(chunk, ALNUM)
        ids, rows = known_words(b, chunk, found), found.rows()
        for w in stretches(ids, rows, b.shortest):
            if chunk.data[found.starts[w] : found.ends[w]].tobytes() != b.spelling[ids[w] - 1]:
                ids[w] = 0
        all_ids.append(ids)
        all_rows.append(rows + chunk.first)
    return np.concatenate(all_ids), np.concatenate(all_rows)


def mark(b: Benchmark | None, column: pa.Array) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """Per row of a text column: number of words, numbers of the hit ones, items that occur."""
    n = len(column)
    if b is None:
        sizes = np.concatenate([words(c, ALNUM).counts for c in chunks(column)]) if n else np.zeros(0, np.int64)
        return sizes, [np.zeros(0, np.int32)] * n, [[]] * n
    ids, rows = _in_vocabulary(b, column)
    sizes = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(sizes)])
    hits, items = [np.zeros(0, np.int32)] * n, [[] for _ in range(n)]
    s = shard(b, ids, rows)
    if s is None:
        return sizes, hits, items
    w_low, w_high, *_ = occurrences(b, s.text, s.sa)
    asked = np.flatnonzero(w_low < w_high)
    count = w_high[asked] - w_low[asked]
    suffix = np.repeat(asked, count)
    place = np.repeat(w_low[asked] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    start = s.word_at[s.sa[place]]
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + b.window[suffix], -1)
    hit = np.flatnonzero(np.cumsum(cover[:-1]))
    for row, at in zip(*_grouped(rows[hit], hit)):
        hits[row] = (at - first[row]).astype(np.int32)
    pairs = np.unique(rows[start] * len(b.item_ids) + b.item_of[suffix])
    for row, item in zip((pairs // len(b.item_ids)).tolist(), (pairs % len(b.item_ids)).tolist()):
        items[row].append(b.item_ids[item])
    return sizes, hits, items


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Runs of equal keys (sorted already) and their values."""
    if not len(keys):
        return keys, []
    cut = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate([[0], cut])], np.split(values, cut)


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> tuple[int, Iterator[Benchmark | None]]:
    """How many blocks of about BLOCK_BYTES the items make, and the blocks, each read when asked for."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))

    def read() -> Iterator[Benchmark | None]:
        for i in range(n):
            got = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).toArrow().combine_chunks()
            column = got.column("text").combine_chunks() if len(got) else pa.array([], pa.string())
            yield benchmark_block(got.column("item").to_pylist(), column, window)

    return n, read()


def _marked(docs: DataFrame, text: str, benchmark: DataFrame, item: str, item_text: str, window: int) -> tuple[DataFrame, Broadcast, str, str]:
    """``docs`` with what all blocks but the last hit, the last one as a broadcast, and the names of
    the columns of hits and items, which there are if there are several blocks.

    A block is broadcast, applied, its hits written, and released before the next one is read.
    """
    sc = docs.sparkSession.sparkContext
    hits_col, items_col = free_name(docs, "hits"), free_name(docs, "items")
    at, (n, blocks) = docs.columns.index(text), _blocks(benchmark, item, item_text, window)
    df = docs
    if n > 1:
        df = docs.select("*", F.lit(None).cast("array<int>").alias(hits_col), F.lit(None).cast("array<string>").alias(items_col))
    schema = df.schema
    for i, read in enumerate(blocks):
        block = sc.broadcast(read)
        del read
        if i == n - 1:
            return df, block, hits_col, items_col

        def add(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, hits, items = mark(block.value, batch.column(at))
                hits, items = _joined(batch, hits, items)
                columns = [pa.array([h.tolist() for h in hits], pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], batch.schema.names)

        df = written(df.mapInArrow(add, schema), "overlap")
        block.destroy()
    raise AssertionError("there is at least one block")


def overlap(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    last = f"`{id_col}` {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    df, block, _, _ = _marked(docs.select(F.col(id_col), F.col(text).alias("text")), "text", benchmark, item, item_text, window)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hits, items = mark(block.value, batch.column(1))
            if batch.num_columns > 2:
                hits, items = _joined(batch, hits, items)
            n_hit = np.array([len(h) for h in hits], np.int64)
            names = [sorted(set(x)) for x in items]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(n_hit), pa.array([len(x) for x in names], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                    pa.array((n_hit > 0) & (20 * n_hit >= sizes)),
                ],
                [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return df.mapInArrow(finish, last)


def _joined(batch: pa.RecordBatch, hits: list[np.ndarray], items: list[list[str]]) -> tuple[list[np.ndarray], list[list[str]]]:
    before, names = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
    hits = [np.union1d(h, np.array(o or [], np.int32)) for h, o in zip(hits, before)]
    return hits, [[*x, *(o or [])] for x, o in zip(items, names)]


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, item_word, n_words, doc_id, doc_word): for each suffix of an item the longest
    verbatim match over all shards and a place of it, if it is as long as the shortest window."""
    sc = docs.sparkSession.sparkContext
    schema = f"item_id string, item_word long, n_words long, doc_id {docs.schema[id_col].dataType.simpleString()}, doc_word long"
    parts = []
    for b in _blocks(benchmark, item, item_text, window)[1]:
        block = sc.broadcast(b)

        def best(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            b = block.value
            for batch in batches if b is not None else ():
                ids, rows = _in_vocabulary(b, batch.column(1))
                s = shard(b, ids, rows)
                if s is None:
                    continue
                _, _, longest, low, _ = occurrences(b, s.text, s.sa)
                at = np.flatnonzero(longest >= b.shortest)
                place = s.word_at[s.sa[low[at]]]
                first = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))])
                of_item = np.searchsorted(b.item_of, b.item_of[at])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.item_ids[i] for i in b.item_of[at]], pa.string()), pa.array(at - of_item, pa.int64()),
                        pa.array(longest[at]), batch.column(0).take(pa.array(rows[place])), pa.array(place - first[rows[place]], pa.int64()),
                    ],
                    ["item_id", "item_word", "n_words", "doc_id", "doc_word"],
                )

        parts.append(written(docs.select(F.col(id_col), F.col(text).alias("text")).mapInArrow(best, schema), "matches"))
        block.destroy()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    top = F.max(F.struct("n_words", "doc_id", "doc_word")).alias("top")
    return found.groupBy("item_id", "item_word").agg(top).select("item_id", "item_word", "top.*")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated rows; all columns and all other rows stay as they are."""
    at = docs.columns.index(text)
    df, block, hits_col, items_col = _marked(docs, text, benchmark, item, item_text, window)
    several = hits_col in df.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hits, items = mark(block.value, batch.column(at))
            if several:
                hits, _ = _joined(batch, hits, items)
            n_hit = np.array([len(h) for h in hits], np.int64)
            yield batch.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= sizes))))

    return df.mapInArrow(keep, df.schema).drop(hits_col, items_col) if several else df.mapInArrow(keep, df.schema)
