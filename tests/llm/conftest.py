from __future__ import annotations

import zlib

import pytest

#: Columns whose names the operators use themselves.
CLASHING = ("score", "row_key", "shard", "probability", "bucket", "fp", "file", "n_bytes")

WORDS = "the of and house river stone walking green under light winter paper seven morning letter".split()


def text_of(n: int, seed: int = 0) -> str:
    out, x = [], seed * 7919 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)])
    return " ".join(out)


def held(doc_id, n: int, value: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == value


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from rows (doc_id, text, lang, source), with clashing columns beside them."""

    def make(rows, clash: bool = False):
        rows = [tuple([*r, *[None] * (4 - len(r))]) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        if clash:
            for name in CLASHING:
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit("x"))
        return df

    return make


EDGES = [
    (None, None), (None, "a null id"), (1, ""), (1, ""), (2, " \t\n"), (3, "twice the same"), (3, "twice the same"),
    (4, "w" * 30_000), (5, text_of(20_000, 3)), (6, "é ß ñ ü"), (7, "\x00\x01 !!! ..."),
]


@pytest.fixture(scope="session")
def edges():
    return EDGES
