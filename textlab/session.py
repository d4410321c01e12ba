"""Session helpers: one place for the configs every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Configs that decide correctness (UTC wall clock, ANSI casts) or scale behaviour (AQE re-plans joins,
# splits skewed partitions and coalesces small ones at runtime).
BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

# Starting point for a large cluster reading ~100 TB: many shuffle partitions that AQE coalesces to
# ~256 MB at runtime, 256 MB input splits, skew splitting from 512 MB, broadcasts up to 64 MB (the
# bounded tables here are far smaller), and the sort-free local shuffle reader.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "textlab",
              extra: dict | None = None, profile: str = "local") -> SparkSession:
    """Build (or reuse) a session with the configs above (``profile='cluster'`` adds ``CLUSTER_CONF``).

    ``master`` defaults to whatever the launcher provides (cluster) or ``local[*]``.
    """
    b = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        b = b.master(master or "local[*]")
    conf = {**BASE_CONF, **(CLUSTER_CONF if profile == "cluster" else {})}
    for k, v in conf.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``textlab`` importable in Python workers (pandas UDFs, ``applyInPandas``, ``mapInPandas``).

    The package is zipped once per process next to its source and added with ``addPyFile``, which
    serves it from the driver to every executor of this application (also executors added later).
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import hashlib
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    files = sorted(os.path.join(d, f) for d, _dirs, fs in os.walk(pkg) for f in fs if f.endswith(".py"))
    digest = hashlib.sha1()
    for full in files:
        digest.update(os.path.relpath(full, root).encode())
        with open(full, "rb") as fh:
            digest.update(fh.read())
    dist = os.path.join(root, ".dist")
    try:
        os.makedirs(dist, exist_ok=True)
    except OSError:
        dist = tempfile.mkdtemp(prefix="textlab-dist-")
    path = os.path.join(dist, f"textlab-{digest.hexdigest()[:16]}.zip")   # same sources -> same file
    if not os.path.exists(path):
        part = f"{path}.{os.getpid()}.part"
        with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
            for full in files:
                z.write(full, os.path.relpath(full, root))
        os.replace(part, path)                                           # atomic for concurrent drivers
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    When it is unset a scratch folder is created and registered, but only if driver and executors are
    one process (``local[...]``): executors elsewhere could not see it, so there an error is raised.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="textlab-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d
