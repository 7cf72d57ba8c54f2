"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.errors import PySparkNotImplementedError
from pyspark.sql import SparkSession


JIT_OPTIONS = "-XX:-DontCompileHugeMethods"


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "covgrid", extra: dict | None = None) -> SparkSession:
    """A local session tuned like a small cluster: AQE on, UI off, UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("COVGRID_DRIVER_MEMORY", "16g"))
        # Geometry stages generate long methods (segment/edge tests); let the
        # JIT compile them instead of interpreting anything over 8 KB.
        .config("spark.driver.extraJavaOptions", JIT_OPTIONS)
        .config("spark.executor.extraJavaOptions", JIT_OPTIONS)
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Does this session run inside one JVM on one machine?"""
    master = spark.conf.get("spark.master", None) or ""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; without it this raises, because executors cannot see each other's
    private folders.  Only a local session (tests) gets a private one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except PySparkNotImplementedError:  # no SparkContext behind a Spark Connect session
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        configured = configured or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="covgrid-ckpt-", dir="/tmp")
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    return configured


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A new path under the shared checkpoint folder, removed by the JVM
    when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/covgrid-{name}-{uuid.uuid4().hex}"
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialize(df, name: str = "stage"):
    """Cut lineage: write ``df`` as Parquet under the shared checkpoint folder
    and read it back.  The written table survives executor loss, is
    computed exactly once, and later reads prune columns.  Used where one
    expensive intermediate feeds several branches of a plan."""
    path = stage_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_slots(spark: SparkSession) -> int:
    """Task slots of the cluster (default parallelism), or the shuffle
    partition count when no SparkContext is reachable."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df):
    """Repartition a scan-rooted DataFrame that has fewer partitions than the
    cluster has task slots.  Geometry rows are compute-heavy, so a small
    input read from one file must not stay in one task.  Inputs that are
    already the output of a shuffle, or large tables with enough file
    splits, are returned unchanged (the check plans the query but runs no
    job: only exchange-free plans are asked for their partition count)."""
    slots = task_slots(df.sparkSession)
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
        if "Exchange" in plan:
            return df
        parts = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - plan not inspectable (e.g. Spark Connect)
        return df
    return df.repartition(slots) if parts < slots else df


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``covgrid`` importable by the Python workers (which run the
    Arrow functions) wherever the driver was started from: zip the package
    once per application and register it with ``addPyFile``, as
    ``spark-submit --py-files`` would."""
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect: ship as an artifact
        sc, app = None, "connect"
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="covgrid-pkg-"), "covgrid.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(path)
    else:
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(app)
