"""Session helper and the shared checkpoint folder.

On a cluster the session is created by the platform; ``get_session`` only fills in settings
that are unset, so a cluster's own values (shuffle partitions, checkpoint dir) win.
"""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE coalesces small shuffle partitions and splits skewed
# join partitions at runtime; UTC keeps day() stable across engines.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Python json.loads keeps the last of duplicate keys; the variant parser can do the same.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "critica") -> SparkSession:
    """Return the active session, creating a local one (tests, bench) if none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        apply_defaults(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false")
    if master and master.startswith("local"):
        # Local mode runs every task in the driver JVM; the 1g default is too small.
        builder = builder.config("spark.driver.memory", os.environ.get("CRITICA_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``critica`` importable in Python workers (what ``--py-files`` does at submit time).

    Pandas UDFs, the streaming state function and pandas backends are pickled by reference to
    this package, so executors need it. The package is zipped once per SparkContext and added
    with ``addPyFile``; Spark's file server distributes it to every executor."""
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001 - no SparkContext (remote session): nothing to ship
        return
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    zf.write(full, os.path.relpath(full, root))
    path = os.path.join(tempfile.mkdtemp(prefix="critica-pyfiles-"), "critica.zip")
    with open(path, "wb") as fh:
        fh.write(buf.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(app)


def apply_defaults(spark: SparkSession) -> None:
    """Set the two runtime SQL options that change results: UTC for day(ts) and last-wins
    duplicate JSON keys (as Python's json.loads)."""
    for key in ("spark.sql.session.timeZone", "spark.sql.variant.allowDuplicateKeys"):
        try:
            spark.conf.set(key, _DEFAULTS[key])
        except Exception:  # noqa: BLE001 - a session that forbids it keeps its own value
            pass
    ship_package(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may leave it unset (tests): it gets a fresh temp folder. Elsewhere executors could
    not share such a folder, so that is an error."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not is_local(sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="critica-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def is_local(master: str) -> bool:
    """One JVM: ``local`` and ``local[...]``, not ``local-cluster``."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-folder of the shared checkpoint folder for a written intermediate table; deleted when the driver ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def shuffle_partitions(spark: SparkSession) -> int:
    """``spark.sql.shuffle.partitions``, or the default parallelism where a platform has no number there."""
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except (TypeError, ValueError):
        return spark.sparkContext.defaultParallelism


def stored(df, name: str):
    """Write the rows once under the shared folder and go on from the written table: lineage is cut there, and every
    branch reads the same rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session ended first; the folder is the cluster's to clean
        pass
