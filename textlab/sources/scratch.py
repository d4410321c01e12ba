"""Scratch locations for intermediate tables: always under the shared checkpoint folder of the session."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

from textlab.session import ensure_checkpoint_dir


_scopes = threading.local()


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the scratch tables that this thread made inside it.

    For work whose results are written inside: a DataFrame that still reads a scratch table must not be used after it.
    """
    stack = _scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        conf, new_path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
        for path in stack.pop():
            p = new_path(path)
            p.getFileSystem(conf).delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir`` (shared storage on a cluster, never machine-local)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/textlab-scratch/{name}-{uuid.uuid4().hex[:12]}"
    if getattr(_scopes, "stack", None):
        _scopes.stack[-1].append(path)
    return path


def materialize(df, name: str):
    """Write ``df`` as Parquet under the shared scratch folder and read it back.

    Cuts lineage like ``checkpoint()`` but also resets plan statistics to the file size, which matters
    in iterative jobs (a checkpointed plan keeps its origin's estimates, and join estimates multiply).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
