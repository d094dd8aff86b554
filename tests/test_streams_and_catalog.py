"""Streams over several micro-batches, and the query registry."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry
from demandspark.catalog.base import table
from demandspark.operators import ordered as o
from demandspark.operators.ordered import OrderedFrame, SeriesSpec
from demandspark.streaming import jobs

SCHEMA = "k string, datetime timestamp, cnt bigint"


def test_lag_features_across_batches(spark, tmp_path):
    rows = spark.range(60).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"),
        F.timestamp_seconds(F.col("id") * 3600).alias("datetime"),
        (F.col("id") * 7 % 11).alias("cnt"),
    )
    src = f"{tmp_path}/src"
    for i in range(4):  # four files, one per micro-batch, in time order
        part = rows.where((F.hour("datetime") + F.dayofmonth("datetime") * 24 - 24 >= i * 15) & (F.hour("datetime") + F.dayofmonth("datetime") * 24 - 24 < (i + 1) * 15))
        part.coalesce(1).write.mode("append").parquet(src)
    spec = SeriesSpec(("datetime",), ("k",), mode="plain")
    ops = [o.lag("cnt", 1, "l1"), o.lag("cnt", 9, "l9"), o.difference("cnt", 2, "d2"), o.rolling_mean("cnt", 5, "m5")]
    stream = jobs.read_stream(spark, src, SCHEMA, files_per_batch=1)
    out = f"{tmp_path}/out"
    q = jobs.lag_feature_stream(stream, spec, ops, out, f"{tmp_path}/state", f"{tmp_path}/chk")
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.select("epoch").distinct().count() == 4
    want = OrderedFrame(rows, spec).with_ops(ops).df
    cols = want.columns
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))


def test_only_touched_state_buckets_are_written(spark, tmp_path):
    keys = [f"k{i}" for i in range(12)]
    hours = [(k, h) for h in range(6) for k in keys if h % 2 == 0 or k in ("k0", "k1")]
    src, state = f"{tmp_path}/src", f"{tmp_path}/state"
    rows = spark.createDataFrame(hours, "k string, h int").select(
        "k", F.timestamp_seconds(F.col("h") * 3600).alias("datetime"), (F.col("h") * 5 + F.length("k")).cast("long").alias("cnt")
    )
    for h in range(6):
        rows.where(F.hour("datetime") == h).coalesce(1).write.mode("append").parquet(src)
    spec = SeriesSpec(("datetime",), ("k",), mode="plain")
    ops = [o.lag("cnt", 2, "l2"), o.rolling_mean("cnt", 3, "m3")]
    stream = jobs.read_stream(spark, src, SCHEMA, files_per_batch=1)
    jobs.lag_feature_stream(stream, spec, ops, f"{tmp_path}/out", state, f"{tmp_path}/chk", buckets=16).awaitTermination()
    want = OrderedFrame(rows, spec).with_ops(ops).df
    got = spark.read.parquet(f"{tmp_path}/out").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    # Last batch: k0 and k1 only. Buckets of others were last written one batch before.
    folders = {p.parent.parent.name: p.parent.parent for p in (tmp_path / "state" / "rows").glob("*/*/*.parquet")}
    newest = {name: max(f.stat().st_mtime for f in folder.glob("*/*.parquet")) for name, folder in folders.items()}
    touched = {f"__bucket={r[0]}" for r in rows.where(F.col("k").isin("k0", "k1")).select(F.pmod(F.xxhash64("k"), F.lit(16))).collect()}
    assert len(newest) > len(touched)
    assert max(t for n, t in newest.items() if n not in touched) < min(newest[n] for n in touched)


def test_late_and_open_hours_are_accounted_for(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    for minutes in ([0, 70, 130], [400, 410], [415], [10, 420, 430]):  # the 10 comes after hour 0 is closed
        part = spark.createDataFrame([(m,) for m in minutes], "m int").select(F.timestamp_seconds(F.col("m") * 60).alias("ts"))
        part.coalesce(1).write.mode("append").parquet(src)
    aggs = {"n": F.count(F.lit(1))}
    events = jobs.read_stream(spark, src, "ts timestamp", files_per_batch=1)
    q = jobs.write_files(jobs.hourly_stream(events, "ts", aggs), out, f"{tmp_path}/chk")
    q.awaitTermination()
    closed = spark.read.schema("datetime timestamp, n bigint").parquet(out)
    rest = jobs.open_hours(spark.read.parquet(src), closed, "ts", aggs)
    hours = {r.datetime.hour: r.n for r in closed.unionByName(rest).collect()}
    assert hours == {0: 1, 1: 1, 2: 1, 6: 3, 7: 2} and rest.count() == 2


def test_every_event_is_closed_open_or_late(spark, tmp_path):
    """Over more batches than Spark keeps the progress of."""
    src, n = f"{tmp_path}/src", 8
    for b in range(n):
        # Hours 3b to 3b + 2, one event of the first hour again once that is closed, one without a time.
        minutes = [180 * b, 180 * b + 70, 180 * b + 130, *([0] if b > 1 else []), *([None] if b == 4 else [])]
        spark.createDataFrame([(m,) for m in minutes], "m int").select(F.timestamp_seconds(F.col("m") * 60).alias("ts"), "m").coalesce(1).write.mode("append").parquet(src)
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        tables = jobs.HourlyTables(f"{tmp_path}/out")
        aggs = {"n": ("count", "m"), "least": ("min", "m")}
        run = lambda: jobs.accounted_hours(jobs.read_stream(spark, src, "ts timestamp, m int", files_per_batch=1), "ts", aggs, [], tables, f"{tmp_path}/chk")
        q = run()
        q.awaitTermination()
        run().awaitTermination()  # nothing new: nothing changes
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    assert len(q.recentProgress) <= 2
    closed, opened, late = (x.collect() for x in (tables.closed(spark), tables.open(spark), tables.late(spark)))
    assert sorted(r.m for r in late if r.m is not None) == [0] * (n - 2) and sum(r.m is None for r in late) == 1
    hours = {r.datetime: (r.n, r.least) for r in closed + opened}
    assert len(hours) == len(closed) + len(opened) == 3 * n and all(v[0] == 1 for v in hours.values())
    assert sum(v[0] for v in hours.values()) + len(late) == spark.read.parquet(src).count()
    assert {v[1] for v in hours.values()} == {180 * b + m for b in range(n) for m in (0, 70, 130)}


def test_late_hours_are_held_back(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    assert ev.count() > 0
    hours = jobs.hourly_stream(ev, "ts", {"cnt": F.count(F.lit(1))})  # batch: watermark is ignored
    assert hours.agg(F.sum("cnt")).first()[0] == ev.count()


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 110 and len(queries) - len(sql) < 20


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "price" in df.columns


def test_plans_have_no_python_and_push_down(spark, sf_dir):
    for name in ("r13_price_table", "f14_features", "e05_pearson", "v10_top_values", "m01_metrics"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name
    scan = entry.queries()["s01_parquet_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,200000.0)]" in scan
    assert "o_orderdate" not in scan


def test_describe_matches_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{sf_dir}/lineitem.parquet')")
    want = sorted(con.sql(entry.oracle_sql()["s11_describe"]).fetchall())
    got = sorted(tuple(r) for r in entry.queries()["s11_describe"](spark, sf_dir).collect())
    assert got == want


def test_files_by_batch_scans_once_and_writes_one_file_per_batch_in_order(spark, tmp_path):
    import glob
    import os

    rows = [(i, i % 3 if i % 7 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "v long, batch long")
    out = jobs.files_by_batch(df, "batch", f"{tmp_path}/staged", f"{tmp_path}/out")
    files = sorted(glob.glob(f"{out}/batch=*/*.parquet"), key=os.path.getmtime)
    assert [os.path.basename(os.path.dirname(f)) for f in files] == ["batch=000", "batch=001", "batch=002"]
    for b, f in enumerate(files):
        assert sorted(r.v for r in spark.read.parquet(f).collect()) == [v for v, k in rows if k == b]
