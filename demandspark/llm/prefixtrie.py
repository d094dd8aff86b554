"""The prefix trie of conversations, from adaptive radix trees.

Conversations are sequences of turns; a turn's id is a hash of its role and text, of ``WIDTH``
bytes. A conversation is the byte string of its ids, and conversations that begin alike share the
top of a radix tree: its nodes grow through four layouts, chains are one compressed path, and only
byte depths that are whole turns are nodes of the trie.

Trees are local to a task and bounded (``TREE`` pieces each); a node is known everywhere by a key
that is the sum of its turns' hashes with their depths, so what local trees find is combined by
that key before and after one shuffle, and no node's members meet in one task. Conversations of
over ``PIECE`` turns are cut into pieces; a piece starts under the key of what precedes it.

Sums over subtrees are additive as well: every node is handed to one member (the smallest), whose
path runs through all nodes above it. Local trees are built again with those values, are summed
from the leaves up, and the sums are combined by key. A long conversation's later pieces count in
its earlier ones.

The hash over the ids of the conversations that end in a node is by nature one stream; ids are
put together in ranges of ``RANGE`` values first, so that a node with very many such conversations
streams few rows, holding one at a time.

Turns are ordered by number, nulls first, equal numbers by the hash of role and text; null role or
text is empty. Rows without a conversation id take no part. Repeated rows are turns of their own.
An empty table has no nodes, not even the root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.radix import Node, Tree
from demandspark.llm.store import looked_up, temporary, written
from demandspark.operators.ordered import OrderedFrame, SeriesSpec

WIDTH = 16
#: Turns of one piece, pieces of one tree.
PIECE = 64
TREE = 1 << 14
RANGE = 1 << 16
#: Conversations share the first turns of the next lower one divisible by so much; at most one less than this many turns.
SHARED_BY, SHARED_MOST = 5, 9
_MASK = (1 << 64) - 1
_NO_TURNS = hashlib.sha256(b"").hexdigest()


def _hash(turn: bytes, depth: int) -> tuple[int, int]:
    """What a turn at a depth adds to the key of its node."""
    h = hashlib.blake2b(turn + depth.to_bytes(8, "big"), digest_size=16).digest()
    return int.from_bytes(h[:8], "big"), int.from_bytes(h[8:], "big")


def _key(a: int, b: int) -> bytes:
    return (a & _MASK).to_bytes(8, "big") + (b & _MASK).to_bytes(8, "big")


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, id, bytes): turns numbered from 0; ids as hexadecimal text."""
    role_, text_ = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    turn_id = F.md5(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), turn_id.alias("id"), F.octet_length(text_).cast("long").alias("bytes")
    )
    placed = OrderedFrame(rows, SeriesSpec(("turn", "id"), ("conv",))).row_index("pos").df
    return placed.select("conv", "pos", "id", "bytes")


def rebuilt(turns: DataFrame, shared_by: int = SHARED_BY, most: int = SHARED_MOST) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation begins with turns of the one it is built on.

    The first crc32(id) % ``most`` turns come from conversation id - id % ``shared_by``, all if
    there are fewer; then follow its own turns after as many of its own.
    """
    turns = written(turns, "turns")
    convs = turns.groupBy("conv").agg(F.count("*").alias("len"))
    convs = written(convs.select("conv", "len", (F.crc32(F.col("conv").cast("string")) % most).alias("h"), (F.col("conv") - F.col("conv") % shared_by).alias("base")), "conversations")
    have = convs.select(F.col("conv").alias("base"), F.col("len").alias("there"))
    convs = written(convs.join(have, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))), "built-on")
    first = turns.where((F.col("conv") % shared_by == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "base")
    heads = first.join(convs.select("base", "conv", "h"), "base").where("pos < h").select("conv", "pos", "id", "bytes")
    own = looked_up(turns, convs.select("conv", "len", "h", "k"), "conv", "len").where("pos >= h")
    tails = own.select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "id", "bytes")
    return heads.unionByName(tails), convs.select("conv")


def _pieces(turns: DataFrame, size: int) -> DataFrame:
    """(conv, piece, ids, sizes, a, b, n): turns of a piece and the key they start under."""
    at = F.floor(F.col("pos") / size).cast("long")
    rows = turns.groupBy("conv", at.alias("piece")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "bytes"))).alias("turns"))
    rows = rows.select("conv", "piece", F.unhex(F.array_join("turns.id", "")).alias("ids"), F.col("turns.bytes").alias("sizes"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for piece, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a = b = 0
                for k in range(len(ids) // WIDTH):
                    x, y = _hash(ids[WIDTH * k : WIDTH * (k + 1)], piece * size + k + 1)
                    a, b = (a + x) & _MASK, (b + y) & _MASK
                sums.append((Decimal(a), Decimal(b)))
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([s[k] for s in sums], kind) for k in (0, 1))], [*batch.schema.names, "own_a", "own_b"])

    schema = "conv long, piece long, ids binary, sizes array<long>, own_a decimal(38,0), own_b decimal(38,0)"
    rows = written(rows.mapInArrow(each, schema), "pieces")
    zero = F.lit(0).cast("decimal(38,0)")
    before = {"a": zero, "b": zero}
    if not rows.where("piece > 0").head(1):
        return rows.withColumns(before)
    # What stands before a piece: the running sum without the piece's own.
    running = OrderedFrame(rows.select("conv", "piece", "own_a", "own_b"), SeriesSpec(("piece",), ("conv",)))
    running = running.running_sum("own_a", "sum_a").running_sum("own_b", "sum_b").df
    before = running.where("piece > 0").select("conv", "piece", *[F.expr(f"cast(sum_{x} as decimal(38,0)) - own_{x}").cast("decimal(38,0)").alias(x) for x in "ab"])
    return written(rows.join(before, ["conv", "piece"], "left").withColumns({x: F.coalesce(x, zero) for x in "ab"}), "placed-pieces")


def _grown(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, int, int, list[int]]]:
    """(row, conv, key string, piece, turns, sizes) of each piece of a batch."""
    get = {n: batch.column(n).to_pylist() for n in ("conv", "piece", "ids", "sizes", "a", "b")}
    for i, (conv, piece, ids, sizes, a, b) in enumerate(zip(*get.values())):
        yield i, conv, _key(int(a), int(b)) + piece.to_bytes(WIDTH, "big") + ids, piece, len(ids) // WIDTH, sizes


#: Two leading fields name where a piece starts: the key before it, and the piece's number.
_LEAD = 2 * WIDTH


def _aligned(tree: Tree, size: int) -> Iterator[tuple[Node, int, int, bytes, bytes, bytes]]:
    """(node, place of it, depth, turn, key, parent's key) for whole-turn depths on every path."""
    walk = tree.walk()
    sums: list[tuple[int, int]] = []
    for i, (node, key, up) in enumerate(walk):
        before = len(walk[up][1]) if up >= 0 else 0
        a, b = sums[up] if before >= _LEAD else (int.from_bytes(key[:8], "big"), int.from_bytes(key[8:16], "big"))
        piece = int.from_bytes(key[WIDTH:_LEAD], "big")
        for t in range(max(_LEAD, before - before % WIDTH) // WIDTH, len(key) // WIDTH):
            turn, depth = key[WIDTH * t : WIDTH * (t + 1)], piece * size + t - 1
            x, y = _hash(turn, depth)
            parent = _key(a, b)
            a, b = a + x, b + y
            yield node, i, depth, turn, _key(a, b), parent
        sums.append((a, b))


def _members(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(depth, key, parent, n, conv, bytes) of the nodes of local trees."""
    for batch in batches:
        for start in range(0, batch.num_rows, TREE):
            tree, size_of = Tree(), {}
            for _, conv, key, _, n, sizes in _grown(batch.slice(start, TREE)):
                node = tree.at(key)
                node.value = (1, conv) if node.value is None else (node.value[0] + 1, min(node.value[1], conv))
                size_of.update((key[_LEAD + WIDTH * k : _LEAD + WIDTH * (k + 1)], sizes[k]) for k in range(n))
            walk = tree.walk()
            total = [node.value or (0, None) for node, _, _ in walk]
            for i in range(len(walk) - 1, 0, -1):
                up, (n, conv) = walk[i][2], total[i]
                m, least = total[up]
                total[up] = (m + n, conv if least is None else min(least, conv))
            rows = [(depth, key, parent, *total[i], size_of[turn]) for _, i, depth, turn, key, parent in _aligned(tree, size)]
            yield _batch(rows, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), ("depth", "key", "parent", "n", "conv", "bytes"))


def _batch(rows: list[tuple], kinds: tuple[pa.DataType, ...], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], list(names))


def _summed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(depth, key, leaves, saved): sums over the local subtrees of what was handed to members."""
    for batch in batches:
        for start in range(0, batch.num_rows, TREE):
            tree, part = Tree(), batch.slice(start, TREE)
            given, more = part.column("given").to_pylist(), part.column("more").to_pylist()
            for i, _, key, piece, n, _ in _grown(part):
                for depth, leaves, saved in [(g["depth"], g["leaves"], g["saved"]) for g in given[i] or []] + [(piece * size + n, more[i]["leaves"], more[i]["saved"])]:
                    node = tree.at(key[: _LEAD + WIDTH * (depth - piece * size)])
                    old = node.value or (0, 0)
                    node.value = (old[0] + leaves, old[1] + int(saved))
            walk = tree.walk()
            total = [node.value or (0, 0) for node, _, _ in walk]
            for i in range(len(walk) - 1, 0, -1):
                up = walk[i][2]
                total[up] = (total[up][0] + total[i][0], total[up][1] + total[i][1])
            rows = [(depth, key, total[i][0], Decimal(total[i][1])) for _, i, depth, _, key, _ in _aligned(tree, size) if any(total[i])]
            yield _batch(rows, (pa.int64(), pa.binary(), pa.int64(), pa.decimal128(38, 0)), ("depth", "key", "leaves", "saved"))


def _subtrees(pieces: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(depth, key, leaves, saved) over the subtree of each node, itself included."""
    saved = ((F.col("n") - 1).cast("decimal(20,0)") * F.col("bytes")).cast("decimal(38,0)")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    values = nodes.select("conv", F.floor((F.col("depth") - 1) / size).cast("long").alias("piece"), "depth", leaf.alias("leaves"), saved.alias("saved"))
    # At most ``size`` nodes of a piece are handed to its conversation.
    given = values.groupBy("conv", "piece").agg(
        F.collect_list(F.struct("depth", "leaves", "saved")).alias("given"), F.sum("leaves").alias("own_leaves"), F.sum("saved").cast("decimal(38,0)").alias("own_saved")
    )
    rows = pieces.select("conv", "piece", "ids", "sizes", "a", "b").join(given, ["conv", "piece"], "left")
    zero = {"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("decimal(38,0)")}
    more = F.struct(*[z.alias(n) for n, z in zero.items()])
    if pieces.where("piece > 0").head(1):
        rows = written(rows, "given").withColumns({f"own_{n}": F.coalesce(f"own_{n}", z) for n, z in zero.items()})
        later = OrderedFrame(rows.select("conv", "piece", "own_leaves", "own_saved", (-F.col("piece")).alias("back")), SeriesSpec(("back",), ("conv",)))
        later = later.running_sum("own_leaves", "sum_leaves").running_sum("own_saved", "sum_saved").df
        later = later.select("conv", "piece", *[(F.col(f"sum_{n}") - F.col(f"own_{n}")).cast("decimal(38,0)" if n == "saved" else "long").alias(f"later_{n}") for n in zero])
        rows = rows.join(later, ["conv", "piece"])
        more = F.struct(*[F.col(f"later_{n}").alias(n) for n in zero])
    rows = rows.select("conv", "piece", "ids", "sizes", "a", "b", "given", more.alias("more"))
    return rows.mapInArrow(lambda it: _summed(it, size), "depth long, key binary, leaves long, saved decimal(38,0)").groupBy("depth", "key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _ends(pieces: DataFrame, convs: DataFrame, size: int) -> DataFrame:
    """(depth, key, conv): the node in which each conversation ends."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for piece, n, *sums in zip(*(batch.column(c).to_pylist() for c in ("piece", "n", "a", "b", "own_a", "own_b"))):
                rows.append((piece * size + n, _key(int(sums[0]) + int(sums[2]), int(sums[1]) + int(sums[3]))))
            found = _batch(rows, (pa.int64(), pa.binary()), ("depth", "key"))
            yield pa.RecordBatch.from_arrays([*found.columns, batch.column("conv")], ["depth", "key", "conv"])

    last = pieces.groupBy("conv").agg(F.max("piece").alias("piece"))
    at = pieces.join(last, ["conv", "piece"]).select("conv", "piece", F.size("sizes").alias("n"), "a", "b", "own_a", "own_b")
    found = at.mapInArrow(each, "depth long, key binary, conv long")
    turnless = convs.join(last, "conv", "left_anti").select(F.lit(0).cast("long").alias("depth"), F.lit(_key(0, 0)).alias("key"), "conv")
    return found.unionByName(turnless)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, key, ends_sha256) of rows (depth, key, part) that are sorted; one part is held at a time."""
    now, digest, rows = None, None, []
    for batch in batches:
        for depth, key, part in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "part"))):
            if (depth, key) != now:
                if now is not None:
                    rows.append((*now, digest.hexdigest()))
                now, digest = (depth, key), hashlib.sha256(part.encode())
            else:
                digest.update(f",{part}".encode())
        yield _batch(rows, (pa.int64(), pa.binary(), pa.string()), ("depth", "key", "ends_sha256"))
        rows = []
    if now is not None:
        yield _batch([(*now, digest.hexdigest())], (pa.int64(), pa.binary(), pa.string()), ("depth", "key", "ends_sha256"))


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256) of nodes in which conversations end."""
    ids = F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string"))
    parts = written(ends.groupBy("depth", "key", F.floor(F.col("conv") / RANGE).alias("range")).agg(F.array_join(ids, ",").alias("part")), "ends")
    many = parts.groupBy("depth", "key").count().where("count > 1").select("depth", "key")
    alone = parts.join(many, ["depth", "key"], "left_anti").select("depth", "key", F.sha2("part", 256).alias("ends_sha256"))
    several = parts.join(many, ["depth", "key"], "left_semi")
    several = several.repartition("depth", "key").sortWithinPartitions("depth", "key", "range").select("depth", "key", "part")
    return alone.unionByName(several.mapInArrow(_hashed, "depth long, key binary, ends_sha256 string"))


def trie(turns: DataFrame, convs: DataFrame, size: int = PIECE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for
    every node, from turns (conv, pos, id, bytes) and all conversations (conv), with turns or not."""
    long = lambda c: F.col(c).cast("long")
    with temporary(turns.sparkSession):
        pieces = _pieces(turns, size)
        found = pieces.select("conv", "piece", "ids", "sizes", "a", "b").mapInArrow(lambda it: _members(it, size), "depth long, key binary, parent binary, n long, conv long, bytes long")
        found = found.groupBy("depth", "key").agg(F.any_value("parent").alias("parent"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("bytes").alias("bytes"))
        root_key, no_key = F.lit(_key(0, 0)), F.lit(None).cast("binary")
        root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0")
        root = root.select(F.lit(0).cast("long").alias("depth"), root_key.alias("key"), no_key.alias("parent"), "n", "conv", F.lit(0).cast("long").alias("bytes"))
        found = written(found.unionByName(root), "nodes")
        children = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
        nodes = written(found.join(children, ["depth", "key"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted-nodes")
        below = written(_subtrees(pieces, nodes.where("depth > 0"), size), "subtrees")
        # All under the root: every node is handed to one member once.
        totals = nodes.where("depth > 0").agg(
            F.greatest(F.count_if(F.col("n_children") == 0), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum((F.col("n") - 1).cast("decimal(20,0)") * F.col("bytes")), F.lit(0)).cast("decimal(38,0)").alias("saved_tokens")
        )
        below = below.unionByName(totals.select(F.lit(0).cast("long").alias("depth"), root_key.alias("key"), "n_leaves", "saved_tokens"))
        hashes = _end_hashes(_ends(pieces, convs, size))
        out = nodes.join(below, ["depth", "key"]).join(hashes, ["depth", "key"], "left")
        up = F.concat((F.col("depth") - 1).cast("string"), F.lit(":"), F.hex("parent")).alias("up")
        me = F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("key")).alias("up")
        out = written(out.select("conv", "depth", up, "n", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "summed-nodes", keep=True)
        parents = written(nodes.where("n_children > 0").select(me, F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("kids")), "parents", keep=True)
    with_parent = looked_up(out.where("depth > 0"), parents, "up", "kids").unionByName(out.where("depth = 0"), allowMissingColumns=True)
    return with_parent.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), long("n_children").alias("n_children"),
        long("n_leaves").alias("n_leaves"), long("saved_tokens").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NO_TURNS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", size: int = PIECE) -> DataFrame:
    """The trie of the conversations rebuilt on each other."""
    with temporary(conversations.sparkSession):
        turns, convs = rebuilt(turns_of(conversations, conv, turn, role, text))
        return trie(turns, convs, size)


def _oracle() -> str:
    return f"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
                   FROM conversations WHERE conv_id IS NOT NULL),
        s AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY p) AS own FROM t GROUP BY c),
        h AS (SELECT c, own, c - c % {SHARED_BY} AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % {SHARED_MOST} AS h FROM s),
        q AS MATERIALIZED (SELECT h.c, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS seq FROM h LEFT JOIN s b ON b.c = h.base),
        m AS MATERIALIZED (SELECT c, len(seq) AS len, d, seq[1:d] AS k, CASE WHEN d > 0 THEN strlen(seq[d].text) ELSE 0 END AS bytes FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM q)),
        n AS MATERIALIZED (SELECT d, k, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes, max(len) AS deepest, coalesce(sha256(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d)), sha256('')) AS e FROM m GROUP BY d, k),
        up AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
        w AS (SELECT d, k, (n - 1) * bytes AS saved, (deepest = d)::BIGINT AS leaf FROM n),
        z AS (SELECT a AS d, k[1:a] AS k, sum(saved) AS saved, sum(leaf) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM w) GROUP BY ALL)
        SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(up.n_children, 0) AS n_children, z.leaves::BIGINT AS n_leaves, z.saved::BIGINT AS saved_tokens, n.e AS ends_sha256
        FROM n JOIN z ON n.d = z.d AND n.k = z.k LEFT JOIN up ON up.d = n.d AND up.k = n.k LEFT JOIN n p ON p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]"""


ORACLE_SQL = _oracle()
