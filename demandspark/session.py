"""Session helpers: settings, reliable checkpoints, materialised intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "demandspark", cpus: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster use the cluster's own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        # HotSpot does not compile methods above 8000 bytes of bytecode: long rule chains
        # run faster as separately compiled projections than as one interpreted stage.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Call-site capture for every Column call doubles the time to build long plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster's executors
    would each write to their own disk, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="demandspark-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and cut its lineage.

    Later passes read the files, so a lost executor costs one re-read, not the plan.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, for tables that outlive one plan."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
