"""Compression of vectors to codes by Lloyd rounds over cover trees.

A vector's components become integers and its parts are coded one by one by the nearest entry of
the part's codebook. Codebooks start as the parts of the vectors of smallest id and are improved
by a fixed number of Lloyd rounds; everything is exact in integers, so results depend neither on
partitions nor on the order of sums.

Vectors are packed in blocks of at most ``BLOCK`` where they lie, and every part of a block gets a
cover tree: a node's points are within its radius of its centre, its children's centres are
further apart than half of the next power of two above that radius and cover its points within
that half; the first child has the node's own centre. Points stand in tree order with cumulative
sums, so a node is a range and its sum a difference. The trees are written once and read in
every round. An assignment walks down them: by the triangle inequality an entry whose distance to
the centre is more than two radii beyond the nearest one's can't win in the subtree; a node with
one entry left is assigned whole, and only nodes that stay ambiguous are descended, at the end to
exact integer distances of single points. What a round shuffles is one row for each entry and
position, combined in every task; what reaches the driver is the codebooks.

Rows whose vector is null or holds a null, NaN or infinite component take no part, nor do vectors
of another length than most (of equally many the longer), nor those with a component of
``LARGEST`` or more after scaling. Lengths that the number of parts doesn't divide are filled up
with zeros. Fewer vectors than entries make smaller codebooks. Repeated rows and ids count each
by itself; the first entries are the smallest by id, nulls last, then by vector. Sums of errors
beyond a long are null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandspark.llm.store import looked_up, temporary, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Vectors of one block of trees.
BLOCK = 1 << 12
#: Nodes of so few points aren't split.
LEAF = 32
#: So that sums of 10^9 vectors have at most 38 digits.
LARGEST = 1 << 96
_SAFE = 1 << 61
_NODE = np.dtype([("first", "i4"), ("last", "i4"), ("child", "i4"), ("children", "i4"), ("radius", "f8"), ("centre", "i4")])


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    """Components scaled and rounded down, a row for each vector; Python integers if they are large."""
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(column), dims)
    if not values.size or np.abs(values).max() < 2.0**62:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values], object).reshape(values.shape)


def _exact(points: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as int64 if squared distances and sums between them fit, else as Python integers."""
    most = max((int(np.abs(x).max()) for x in (points, others) if x.size), default=0)
    if (2 * most) ** 2 * max(1, points.shape[1]) < _SAFE and most * max(1, len(points)) < _SAFE:
        return points.astype(np.int64), others.astype(np.int64)
    return points.astype(object), others.astype(object)


def _squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of points and entries."""
    points, book = _exact(points, book)
    out = [((points - entry) ** 2).sum(1) for entry in book]
    return np.stack(out, 1) if out else np.zeros((len(points), 0), np.int64)


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the points, nodes); a node's points are a range of that order."""
    at = points.astype(np.float64)
    n = len(at)
    order = np.arange(n)
    radius = float(np.sqrt(((at - at[0]) ** 2).sum(1)).max()) if n else 0.0
    nodes = [np.array([(0, n, 0, 0, radius, 0)], _NODE)]
    total = 1
    level, level_at = nodes[0], 0
    while True:
        split = np.flatnonzero((level["last"] - level["first"] > LEAF) & (level["radius"] > 0))
        if not len(split):
            break
        parents = level[split]
        size = parents["last"] - parents["first"]
        place = np.repeat(parents["first"] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(parents)), size)
        cover = 2.0 ** (np.ceil(np.log2(parents["radius"])) - 1)
        child, apart = np.full(len(place), -1), np.zeros(len(place))
        centres: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        left, centre, found = np.arange(len(place)), parents["centre"].copy(), np.arange(len(parents))
        made = 0
        while len(left):
            # One new child for every node that still has points: first its own centre, then any point left.
            number = np.full(len(parents), -1)
            number[found] = made + np.arange(len(found))
            centres.append(centre)
            owners.append(found)
            made += len(found)
            middle = np.zeros((len(parents), at.shape[1]))
            middle[found] = at[centre]
            mine = owner[left]
            distance = np.sqrt(((at[order[place[left]]] - middle[mine]) ** 2).sum(1))
            near = distance <= cover[mine]
            child[left[near]], apart[left[near]] = number[mine[near]], distance[near]
            left = left[~near]
            mine = owner[left]
            first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1])) if len(left) else np.zeros(0, int)
            found, centre = mine[first], order[place[left[first]]]
        owners_, centres_ = np.concatenate(owners), np.concatenate(centres)
        # Children by parent, in the order they were made.
        rank = np.lexsort((np.arange(made), owners_))
        new = np.zeros(made, _NODE)
        new["centre"] = centres_[rank]
        place_of = np.empty(made, int)
        place_of[rank] = np.arange(made)
        child = place_of[child]
        largest = np.zeros(made)
        np.maximum.at(largest, child, apart)
        new["radius"] = largest
        moved = np.argsort(child, kind="stable")
        order[place] = order[place[moved]]
        counts = np.bincount(child, minlength=made)
        ends = np.cumsum(counts)
        shift = np.repeat(parents["first"] - (np.cumsum(size) - size), np.bincount(owners_, minlength=len(parents)))
        new["first"], new["last"] = ends - counts + shift, ends + shift
        kids = np.bincount(owners_, minlength=len(parents))
        nodes[-1]["child"][split] = total + np.cumsum(kids) - kids
        nodes[-1]["children"][split] = kids
        nodes.append(new)
        level, level_at, total = new, total, total + made
    return order, np.concatenate(nodes)


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    size = last - first
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def assigned(sums: np.ndarray, nodes: np.ndarray, centres: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each point in tree order, points of each entry, their sums).

    ``sums`` are the cumulative sums of the points in tree order, ``centres`` the nodes' centres.
    """
    points = sums[1:] - sums[:-1]
    n, k = len(points), len(book)
    entry = np.zeros(n, np.int64)
    count, total = np.zeros(k, np.int64), np.zeros((k, points.shape[1]), sums.dtype)
    # Of equal entries the first wins, so the others never take part.
    _, first = np.unique(book.astype(str) if book.dtype == object else book, axis=0, return_index=True)
    here, able = np.zeros(1, int), np.zeros((1, k), bool)
    able[0, first] = True
    entries = book.astype(np.float64)
    while n and len(here):
        node = nodes[here]
        away = np.sqrt(((centres[here].astype(np.float64)[:, None, :] - entries) ** 2).sum(2))
        nearest = np.where(able, away, np.inf).min(1)
        # The triangle inequality, with room for rounding.
        able = able & (away - 2 * node["radius"][:, None] <= nearest[:, None] + 1e-9 * (away + node["radius"][:, None] + 1))
        sure = able.sum(1) == 1
        whole, winner = node[sure], able[sure].argmax(1)
        entry[_ranges(whole["first"], whole["last"])] = np.repeat(winner, whole["last"] - whole["first"])
        np.add.at(count, winner, whole["last"] - whole["first"])
        np.add.at(total, winner, sums[whole["last"]] - sums[whole["first"]])
        leaf = ~sure & (node["children"] == 0)
        single = _ranges(node["first"][leaf], node["last"][leaf])
        if len(single):
            won = _squares(points[single], book).argmin(1)
            entry[single] = won
            np.add.at(count, won, 1)
            np.add.at(total, won, points[single])
        down = ~sure & ~leaf
        able = np.repeat(able[down], node["children"][down], axis=0)
        here = _ranges(node["child"][down], node["child"][down] + node["children"][down])
    return entry, count, total


def _kept(vectors: DataFrame, id_col: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """(id, label, v) of the rows that take part, and how long their vectors are."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float(LARGEST) / SCALE))
    rows = vectors.where(fine).select(F.col(id_col).alias("id"), F.col(label).alias("label"), v.alias("v"))
    most = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return (rows, 0) if most is None else (rows.where(F.size("v") == most["size"]), most["size"])


def _padded(points: np.ndarray, parts: int) -> np.ndarray:
    more = -points.shape[1] % parts
    return np.concatenate([points, np.zeros((len(points), more), points.dtype)], 1) if more else points


def _trees(rows: DataFrame, dims: int, parts: int) -> DataFrame:
    """A row (ids, labels, trees) for each block; ``trees`` holds arrays for every part."""
    id_type, label_type = (rows.schema[c].dataType for c in ("id", "label"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)), T.StructField("trees", T.BinaryType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                block = batch.slice(start, BLOCK)
                points = _padded(_integers(block.column(2), dims), parts)
                trees = []
                for part in np.split(points, parts, 1):
                    order, nodes = cover_tree(part)
                    wide = part if part.dtype == object or not part.size or int(np.abs(part).max()) * len(part) < _SAFE else part.astype(object)
                    sums = np.zeros((len(part) + 1, part.shape[1]), wide.dtype)
                    np.cumsum(wide[order], axis=0, out=sums[1:])
                    trees.append((order.astype(np.int32), nodes, part[nodes["centre"]], sums))
                lists = [pa.ListArray.from_arrays(pa.array([0, block.num_rows], pa.int32()), block.column(k)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([pickle.dumps(trees)], pa.binary())], ["ids", "labels", "trees"])

    return rows.mapInArrow(each, schema)


def _round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries replaced by the means of their points, rounded down; unused ones stay."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for p, (_, nodes, centres, sums) in enumerate(pickle.loads(data)):
                    _, count, total = assigned(sums, nodes, centres, books[p])
                    counts[p] += count
                    totals[p] = totals[p] + total.astype(object)
        rows = [(p, k, i, int(counts[p][k]), Decimal(int(x))) for p, t in enumerate(totals) for k, row in enumerate(t) for i, x in enumerate(row) if counts[p][k]]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        columns = [list(x) for x in zip(*rows)] if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["part", "entry", "place", "n", "total"])

    found = trees.select("trees").mapInArrow(each, "part int, entry int, place int, n long, total decimal(38,0)")
    means = found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    new = [b.astype(object) for b in books]
    for r in means:
        new[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return new


def _codes(trees: DataFrame, books: list[np.ndarray], id_type: T.DataType, label_type: T.DataType) -> DataFrame:
    """(id, label, code, error) of every vector."""
    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(2).to_pylist()):
                ids, labels = (batch.column(k).slice(i, 1).flatten() for k in (0, 1))
                codes, error = np.zeros((len(ids), len(books)), np.int64), np.zeros(len(ids), object)
                for p, (order, nodes, centres, sums) in enumerate(pickle.loads(data)):
                    entry, _, _ = assigned(sums, nodes, centres, books[p])
                    points, book = _exact(sums[1:] - sums[:-1], books[p])
                    codes[order, p] = entry
                    error[order] += ((points - book[entry]) ** 2).sum(1).astype(object)
                texts = pa.array(["".join(f"{x:02x}" for x in row) for row in codes.tolist()], pa.string())
                errors = pa.array([int(x) if x < 1 << 63 else None for x in error], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, labels, texts, errors], ["id", "label", "code", "error"])

    return trees.mapInArrow(each, schema)


def fit(trees: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after so many Lloyd rounds over the trees."""
    for _ in range(rounds):
        books = _round(trees, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    rows, dims = _kept(vectors, id_col, vector, label)
    with temporary(vectors.sparkSession):
        first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().combine_chunks()
        start = first.column("v").combine_chunks() if first.num_rows else pa.array([], pa.list_(pa.float32()))
        points = _padded(_integers(start, dims), parts)
        width = points.shape[1] // parts
        trees = written(_trees(rows, dims, parts), "cover-trees")
        # Positions that only fill up a part are no part of an entry.
        books = fit(trees, np.split(points, parts, 1), rounds)
        real = [b[:, : max(0, min(width, dims - p * width))] for p, b in enumerate(books)]
        id_type, label_type = (rows.schema[c].dataType for c in ("id", "label"))
        key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-")).alias("key")
        coded = written(_codes(trees, books, id_type, label_type).select("id", key, "code", "error"), "codes", keep=True)
        total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long").alias("label_error")
        by_label = written(coded.groupBy("key").agg(total, F.count("*").alias("n")), "label-errors", keep=True)
    return looked_up(coded, by_label, "key", "n").select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(real)).alias("codebooks_sha256"))


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    distance = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, part, e[part * len(e) // {parts} + 1 : (part + 1) * len(e) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS part))",
        f"""b0 AS MATERIALIZED (SELECT part, k, x FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, e) - 1 AS k FROM v
              QUALIFY k < {entries}) USING (r))""",
    ]
    nearest = f"SELECT p.part, p.r, p.x, min(({distance})::HUGEINT * {entries} + b.k) AS best FROM p JOIN b{{}} b ON p.part = b.part GROUP BY ALL"
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED (SELECT part, best % {entries} AS k, x FROM ({nearest.format(i)}))")
        steps.append(
            f"""s{i} AS MATERIALIZED (SELECT part, k, list(m ORDER BY place) AS x FROM (SELECT part, k, place, floor(sum(y)::DOUBLE / count(*))::BIGINT AS m
                FROM (SELECT part, k, unnest(x) AS y, generate_subscripts(x, 1) AS place FROM a{i}) GROUP BY ALL) GROUP BY ALL)"""
        )
        steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.k, coalesce(s.x, b.x) AS x FROM b{i} b LEFT JOIN s{i} s ON b.part = s.part AND b.k = s.k)")
    steps.append(f"f AS MATERIALIZED (SELECT r, string_agg(printf('%02x', (best % {entries})::BIGINT), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM ({nearest.format(rounds)}) GROUP BY r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + """
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN v USING (r), h"""


ORACLE_SQL = _oracle()
