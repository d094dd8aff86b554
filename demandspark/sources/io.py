"""Readers and writers: parquet, CSV, JSON records, typed load, previews, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# The hourly table; types follow the published data dictionary.
HOURLY_TYPES = {
    "datetime": "timestamp",
    "season": "bigint",
    "yr": "bigint",
    "mnth": "bigint",
    "hr": "bigint",
    "holiday": "bigint",
    "weekday": "bigint",
    "workingday": "bigint",
    "weathersit": "bigint",
    "temp": "double",
    "atemp": "double",
    "hum": "double",
    "windspeed": "double",
    "casual": "bigint",
    "registered": "bigint",
    "cnt": "bigint",
}
REQUEST_SCHEMA = (
    "data array<struct<datetime string, season bigint, yr bigint, mnth bigint, hr bigint, holiday bigint, "
    "weekday bigint, workingday bigint, weathersit bigint, temp double, hum double, windspeed double, cnt bigint>>, "
    "currency string"
)


def read_parquet(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Parquet scan; a given schema saves the footer read and prunes to its columns."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON records (one per line) with a fixed schema: no inference pass."""
    return spark.read.schema(schema).json(path)


def from_records(spark: SparkSession, rows: Sequence[dict], schema: str | T.StructType) -> DataFrame:
    """A small list of dictionaries, such as one request, as a table."""
    return spark.createDataFrame(list(rows), schema)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def request_rows(requests: DataFrame) -> DataFrame:
    """Requests (``data`` list + currency) to one row per record, currency default NGN."""
    return requests.select(
        F.coalesce("currency", F.lit("NGN")).alias("currency"), F.inline("data")
    )


def _parse(name: str, dtype: str, source: T.DataType) -> Column:
    if dtype == "timestamp" and isinstance(source, T.StringType):
        return F.try_to_timestamp(F.col(name), F.lit(TIME_FORMAT))
    return F.col(name).try_cast(dtype)


def typed(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Cast columns; text that cannot be cast becomes null and is named in ``bad_columns``."""
    types = types or {c: t for c, t in HOURLY_TYPES.items() if c in df.columns}
    parsed = {c: _parse(c, t, df.schema[c].dataType) for c, t in types.items()}
    bad = F.array_compact(
        F.array(*[F.when(F.col(c).isNotNull() & p.isNull(), F.lit(c)) for c, p in parsed.items()])
    )
    return df.select(
        *[parsed[c].alias(c) if c in parsed else F.col(c) for c in df.columns], bad.alias("bad_columns")
    )


def split_rejected(df: DataFrame, errors: str = "bad_columns") -> tuple[DataFrame, DataFrame]:
    """(clean rows without the error column, rejected rows with it)."""
    ok = F.size(errors) == 0
    return df.where(ok).drop(errors), df.where(~ok)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    """Write by suffix: ``.csv`` with header, else parquet; returns the path used.

    Any suffix other than ``.parquet`` and ``.csv`` is replaced by ``.parquet``.
    """
    head, _, last = path.rpartition("/")
    stem, dot, suffix = last.rpartition(".")
    if dot and suffix == "csv":
        df.write.mode(mode).option("header", True).csv(path)
        return path
    if not (dot and suffix == "parquet"):
        name = f"{stem if dot else last}.parquet"
        path = f"{head}/{name}" if head else name
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested report rows as JSON."""
    report.write.mode(mode).json(path)


def head(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows of an explicit order."""
    return df.orderBy(*order).limit(n)
