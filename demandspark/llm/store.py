"""Tables of the test folder, intermediate tables in the shared folder, row identity."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandspark.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths written since each open ``temporary`` began.
_open: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut.

    Inside ``temporary`` the table is removed at its end, unless it is to ``keep``.
    """
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    if _open and not keep:
        _open[-1].append(path)
    return df.sparkSession.read.schema(schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes the tables written inside when it ends; nothing may read them afterwards."""
    _open.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _open.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


#: A key of more rows is looked up by broadcast: at most one for so many rows.
HOT = 1 << 18
#: Tables of so many short rows are broadcast whole.
FEW_KEYS = 100_000


def looked_up(rows: DataFrame, found: DataFrame, key: str, n: str, hot: int = HOT) -> DataFrame:
    """``rows`` joined with a written table of one row a key, where ``n`` is the key's rows.

    Rows of hot keys stay where they are; the others are shuffled by their key, if there are more
    than ``FEW_KEYS`` keys.
    """
    if found.count() <= FEW_KEYS:
        return rows.join(F.broadcast(found), key)
    many = found.where(F.col(n) > hot)
    if not many.head(1):
        return rows.join(found, key)
    many = F.broadcast(many)
    rest = rows.join(many.select(key), key, "left_anti").join(found.where(F.col(n) <= hot), key)
    return rows.join(many, key).unionByName(rest)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % n


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many leading underscores as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(df: DataFrame) -> Column:
    """A struct naming each row of ``df``: its file and place there, alike in every scan.

    A table that isn't read from files gets Spark's row numbers, which are alike in every run
    of the same plan.
    """
    try:
        df.select("_metadata.row_index")
        return F.struct(
            F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
        )
    except AnalysisException:
        return F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))
