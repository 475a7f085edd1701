"""Session helpers: a local session for tests and bench, and the shared scratch folder.

On a cluster the session comes from the platform; nothing here changes its settings except
where a value is unset (checkpoint folder in local tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", app: str = "rateflow") -> SparkSession:
    """A local[N] session for tests and the benchmark (UI off, AQE on, Arrow on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # one row holds a whole message: bound Arrow batches by count and by bytes
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None for a remote (Spark Connect) session, which has none."""
    try:
        return spark.sparkContext
    except Exception:
        return None


def cores(spark: SparkSession) -> int:
    """Task slots of the cluster; without a SparkContext, the session's shuffle partitions."""
    sc = _context(spark)
    return sc.defaultParallelism if sc is not None else int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the shared folder on a cluster. A local session (one machine,
    as in tests) without it gets a folder under the system temp; any other session must name one,
    since executors would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = _context(spark)
    if not base and sc is not None:
        base = sc.getCheckpointDir()
    if not base:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rateflow-ckpt-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``rateflow`` importable in Python workers (once per application).

    The Python stages (markup, MIME, UDFs) run functions of this package on executors, which do
    not have the repository on their path. The package is zipped once and added with
    ``addPyFile``; Spark distributes it to every executor and puts it on the workers' path.
    """
    import zipfile

    import rateflow

    sc = _context(spark)
    app = sc.applicationId if sc is not None else f"remote-{id(spark)}"
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(rateflow.__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="rateflow-pkg-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, names in os.walk(pkg):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(path)
    else:  # Spark Connect: python files are shipped as session artifacts
        spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(app)
