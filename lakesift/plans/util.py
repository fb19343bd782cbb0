"""Small plan helpers shared by the operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def maybe_broadcast(df: DataFrame, est_bytes: int, limit_bytes: int) -> DataFrame:
    """Broadcast ``df`` only when its (known) size estimate is under the limit.

    Callers pass an estimate derived from an exact row count of a metadata
    dimension (tables, columns), never from data that grows with the lake
    rows.  Above the limit the join stays a shuffle join.
    """
    return F.broadcast(df) if est_bytes <= limit_bytes else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, ``spark.checkpoint.dir``.

    Where the setting is absent, a folder of the cluster's default file system
    is taken; a machine-local one only if the executors run on this machine
    (``local`` masters: tests, bench).  Otherwise the job stops here, as other
    machines would not see the files."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        d = tempfile.mkdtemp(prefix="lakesift-ckpt-")
    elif not d:
        home = sc._jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration())
        if home.getUri().getScheme() == "file":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = home.getHomeDirectory().toString() + "/lakesift-checkpoints"
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that :func:`scratch_path` named."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()

#: Spark's bound on the bytes of a batch for a Python worker, and the one set
#: where the session sets none.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship_package(spark: SparkSession) -> None:
    """Make ``lakesift`` importable in Python workers (like ``--py-files``).

    Needed for the grouped pandas kernels; done once per application.  The
    package is zipped in memory and written to the session's checkpoint
    folder (shared storage on a cluster), from where Spark distributes it."""
    import io
    import os
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if spark.conf.get(BATCH, None) is None:
        # rows may be packed blocks: batches are bounded by bytes, not only by rows
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    dst = scratch_path(spark, "pyfiles") + "/lakesift.zip"
    jvm = sc._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(dst)
    out = hpath.getFileSystem(sc._jsc.hadoopConfiguration()).create(hpath, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(dst)
    _SHIPPED.add(app)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder for a written stage table."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/lakesift-{name}-{uuid.uuid4().hex}"
