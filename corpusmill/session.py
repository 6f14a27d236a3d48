"""Session defaults and the shared checkpoint folder.

Operators never create a session themselves; they take DataFrames.  This module
gives tests and the bench a session with the settings the operators are tuned
for (AQE, skew-join splitting, Arrow), and resolves the checkpoint folder used
to cut lineage.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "corpusmill",
                extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    The cluster names it in ``spark.checkpoint.dir``; that value always wins.
    Only a local-mode session without the setting (tests, the bench) gets a
    fresh folder under the system temp directory; on a cluster an unset value is
    an error, because a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="corpusmill-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


_WRITTEN: dict[str, list[str]] = {}


def materialize(df, tag: str = "t"):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` but computes the input exactly once (an
    eager RDD checkpoint runs its input twice) and stores it columnar.  The
    folder is the cluster's ``spark.checkpoint.dir``, so a lost executor does
    not lose the table.  ``release`` deletes one table that no plan reads any
    more, ``release_all`` every one of the application.
    """
    import uuid

    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/cm-{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.parquet(path)
    out._cm_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(table) -> None:
    """Delete what ``materialize`` wrote for this very frame; do it only when no later action reads it."""
    path = getattr(table, "_cm_path", None)
    written = _WRITTEN.get(table.sparkSession.sparkContext.applicationId, [])
    if path in written:
        written.remove(path)
        _delete(table.sparkSession, path)


def release_all(spark: SparkSession) -> int:
    """Delete every temporary table of this application, once its results are stored; returns how many there were."""
    written = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in written:
        _delete(spark, path)
    return len(written)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpusmill`` importable in Python workers (once per application).

    Pandas UDFs and ``mapInPandas`` / ``applyInPandas`` functions refer to
    helpers of this package; executors get the package as a zip through
    ``addPyFile``, the standard way to distribute job code to a cluster.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="corpusmill-pkg-"), "corpusmill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
