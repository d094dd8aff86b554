"""Sharding by extendible hashing.

A shard is a prefix of a document's hash bits. The directory starts with the empty prefix; a
bucket whose documents are larger than the byte limit is split on its next bit, others stay as
they are. All splits of up to ``width`` bits are found at once: bytes are summed by prefix of
that width (combined in every task before the shuffle), then for each shorter prefix. As every
bucket above a bucket that is too large is too large as well, the number of too large buckets on
a cell's way down is the depth of its shard. Buckets still too large go on with the next bits,
alone. Only (hash, bytes) are shuffled, never texts.

The hash is of the id. Rows of one id can't be told apart by it; where they alone exceed the
limit, further bits come from the row's place, so repeated rows are spread as well. A single
document over the limit is a shard of its own, marked ``oversize``. Null ids are one id, null
texts have no bytes. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandspark.llm.store import free_name, written

LIMIT = 16 << 20
#: Bits of the id's hash, and of the place's.
BITS = 60
#: A directory of at most so many rows is broadcast, about 40 bytes each.
BROADCAST_ROWS = 200_000


def _hash(id_col: Column) -> Column:
    """The first 60 bits of the id's MD5."""
    digits = F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def _place() -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS)


def _bits(word: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(word, BITS - start - width).bitwiseAND(F.lit((1 << width) - 1))


def _name(prefix: Column, depth: Column | int) -> Column:
    """A prefix of ``depth`` bits as text."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, "").otherwise(F.lpad(F.conv(prefix.cast("string"), 10, 2), depth, "0"))


def directory(keyed: DataFrame, limit: int = LIMIT) -> tuple[list[tuple[str, int, int, DataFrame]], int]:
    """Rounds of (word, first bit, width, cells) for rows of (h, place, bytes).

    ``cells``: (bucket, cell, depth, open): what a round's bits (``cell``) of the rows in an open
    bucket of the round before lead to: a shard of ``depth`` of these bits, or the next round.
    """
    total = keyed.agg(F.sum("bytes")).first()[0] or 0
    width = min(20, max(8, math.ceil(math.log2(max(total / limit, 1))) + 6))
    rounds: list[tuple[str, int, int, DataFrame]] = []
    rest = keyed.withColumn("bucket", F.lit(""))
    for word in ("h", "place"):
        for start in range(0, BITS - width + 1, width):
            cell = _bits(F.col(word), start, width).alias("cell")
            sums = written(rest.groupBy("bucket", cell).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "cells")
            depths = F.explode(F.sequence(F.lit(0), F.lit(width))).alias("d")
            at = F.expr(f"shiftrightunsigned(cell, {width} - d)").alias("prefix")
            ways = sums.select("*", depths).select("*", at)
            large = ways.groupBy("bucket", "d", "prefix").agg(F.sum("bytes").alias("all"), F.sum("n").alias("rows"))
            large = large.where((F.col("all") > limit) & (F.col("rows") > 1)).select("bucket", "d", "prefix")
            depth = ways.join(large, ["bucket", "d", "prefix"], "left_semi").groupBy("bucket", "cell").agg(F.count("*").cast("int").alias("depth"))
            cells = sums.join(depth, ["bucket", "cell"], "left").select(
                "bucket", "cell", F.least(F.coalesce("depth", F.lit(0)), F.lit(width)).alias("depth"), (F.coalesce("depth", F.lit(0)) > width).alias("open")
            )
            cells = written(cells, "directory")
            rounds.append((word, start, width, cells))
            opened = cells.where("open").select("bucket", "cell")
            if not opened.head(1):
                return rounds, total
            rest = rest.withColumn("cell", cell).join(opened, ["bucket", "cell"])
            rest = written(rest.withColumn("bucket", F.concat("bucket", _name(F.col("cell"), width))).drop("cell"), "open-rows")
    return rounds, total


def _placed(rows: DataFrame, rounds: list[tuple[str, int, int, DataFrame]], h: str, place: str, shard: str) -> DataFrame:
    """``rows`` with their shard's name."""
    bucket, cell = free_name(rows, "bucket"), free_name(rows, "cell")
    is_open, depth, found, later = (free_name(rows, x) for x in ("is_open", "depth", "found_open", "later_round"))
    out = rows.withColumn(shard, F.lit("")).withColumn(is_open, F.lit(True))
    for word, start, width, cells in rounds:
        here = cells.select(F.col("bucket").alias(bucket), F.col("cell").alias(cell), F.col("depth").alias(depth), F.col("open").alias(found))
        if start or word != "h":  # later rounds hold only open buckets
            here = here.withColumn(later, F.lit(True))
        if cells.count() <= BROADCAST_ROWS:
            here = F.broadcast(here)
        bits = _bits(F.col(h if word == "h" else place), start, width)
        out = out.withColumn(bucket, F.when(F.col(is_open), F.col(shard))).withColumn(cell, F.when(F.col(is_open), bits))
        out = out.join(here, [bucket, cell], "left")
        step = _name(F.expr(f"shiftrightunsigned(`{cell}`, {width} - `{depth}`)"), F.col(depth))
        out = out.withColumn(shard, F.when(F.col(depth).isNull(), F.col(shard)).otherwise(F.concat(shard, step)))
        out = out.withColumn(is_open, F.coalesce(F.col(found), F.lit(False))).drop(bucket, cell, depth, found, later)
    return out.drop(is_open)


def _keyed(docs: DataFrame, id_col: str, text: str, h: str, place: str, n: str) -> DataFrame:
    return docs.withColumns({h: _hash(F.col(id_col)), place: _place(), n: F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})


def shards(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, shard, depth, shard_bytes, shard_docs, oversize) for every row."""
    keyed = written(_keyed(docs.select(id_col, text), id_col, text, "h", "place", "bytes").select(F.col(id_col).alias("id"), "h", "place", "bytes"), "keys")
    rounds, _ = directory(keyed.select("h", "place", "bytes"), limit)
    placed = _placed(keyed, rounds, "h", "place", "shard")
    placed = written(placed.select("id", "bytes", "shard"), "placed")
    size = placed.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    size = written(size, "shard-sizes")
    # One row per shard: the input's bytes over the limit.
    size = F.broadcast(size) if size.count() <= BROADCAST_ROWS else size
    return placed.join(size, "shard").select(
        F.col("id").alias(id_col), F.col("bytes").alias("n_bytes"), "shard", F.length("shard").alias("depth"),
        "shard_bytes", "shard_docs", (F.col("shard_bytes") > limit).alias("oversize"),
    )


def with_shard(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT, name: str | None = None) -> DataFrame:
    """``docs`` and a column ``name`` with each row's shard; texts aren't moved unless the
    directory is too large to broadcast. By default the name is shard, with as many leading
    underscores as no column of ``docs`` has."""
    name = name or free_name(docs, "shard")
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the table has a column {name!r} already; give the shard another name")
    h, place, n = (free_name(docs, x) for x in ("h", "place", "n_bytes"))
    rows = _keyed(docs, id_col, text, h, place, n)
    keyed = written(rows.select(F.col(h).alias("h"), F.col(place).alias("place"), F.col(n).alias("bytes")), "keys")
    rounds, _ = directory(keyed, limit)
    return _placed(rows, rounds, h, place, name).drop(h, place, n)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """One folder of Parquet files for each shard."""
    placed = with_shard(docs, id_col, text, limit, free_name(docs, "shard"))
    name = placed.columns[-1]
    placed.repartition(name).write.partitionBy(name).parquet(path)


def oracle(limit: int = LIMIT) -> str:
    return f"""
        WITH k AS (SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0)::BIGINT AS n,
                     ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT AS h FROM documents),
        way AS (SELECT r, n, d, h >> ({BITS} - d) AS p FROM k, (SELECT unnest(range(0, {BITS} + 1))::INTEGER AS d)),
        node AS (SELECT d, p, sum(n)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM way GROUP BY d, p),
        leaf AS (SELECT r, min(d) AS d FROM way JOIN node USING (d, p) WHERE shard_bytes <= {limit} OR shard_docs = 1 GROUP BY r)
        SELECT doc_id, n AS n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), d, '0') END AS shard, d::INTEGER AS depth, shard_bytes, shard_docs,
               shard_bytes > {limit} AS oversize
        FROM k JOIN leaf USING (r) JOIN way USING (r, d, n) JOIN node USING (d, p)"""


ORACLE_SQL = oracle()
