"""Session helpers.

Library code never creates its own session; it works on the session of the
DataFrames it is given.  ``local_session`` is for tests, the bench and examples.
"""

from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import SparkSession


_SHIP_LOCK = threading.Lock()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "riskframe") -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the configured ``spark.checkpoint.dir``; only a local master with no
    setting gets a private scratch folder (tests, bench)."""
    sc = spark.sparkContext
    configured = checkpoint_dir(spark)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster job needs a shared folder")
    path = tempfile.mkdtemp(prefix="riskframe-ckpt-",
                            dir=os.environ.get("RISKFRAME_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df, partition_by=()):
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and return the re-read frame; ``partition_by`` names columns whose values
    get a folder each.

    One computation plus one write (``Dataset.checkpoint`` would compute the
    plan a second time to save it); the files survive executor loss, unlike a
    local checkpoint, and later readers get column pruning and pushdown."""
    import uuid
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/riskframe-tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._riskframe_table = path
    return out


def drop_table(df) -> None:
    """Delete the table that :func:`cut_lineage` wrote for ``df``, once nothing
    will read it again.  Frames of other origin are left alone."""
    path = getattr(df, "_riskframe_table", None)
    if path:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def input_bytes(df) -> int | None:
    """Bytes of the relations ``df`` scans, from the optimizer's leaf
    statistics (file sizes; no job runs).  Joins are not multiplied out as in
    the plan-level estimate without cost-based statistics."""
    try:
        it = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
        total = 0
        while it.hasNext():
            size = it.next().stats().sizeInBytes()
            total += size if isinstance(size, int) else int(size.toString())
        return total
    except Exception:  # noqa: BLE001 - statistics unavailable
        return None


def spread(df, min_partitions: int | None = None, max_bytes: int = 1 << 30):
    """Spread a *small* input over every core before CPU-heavy per-row work.

    A small table often arrives as one scan split; a large one already
    arrives in many partitions and is returned unchanged (no shuffle).  The
    decision uses the optimizer's size estimate only.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    size = input_bytes(df)
    if size is not None and size <= max_bytes:
        return df.repartition(target)
    return df


def ship_package(spark) -> None:
    """Make ``riskframe`` importable in Python workers (like ``--py-files``).

    Operators that run Python inside tasks (``mapInPandas`` gradients, the
    p-value UDF) pickle functions by module reference; the workers must be
    able to import the package.  A zip of the package is added to the
    context once; Spark ships it to every executor."""
    import shutil

    sc = spark.sparkContext
    with _SHIP_LOCK:                  # sweeps train from several driver threads
        if getattr(sc, "_riskframe_shipped", False):
            return
        import riskframe
        pkg_dir = os.path.dirname(os.path.abspath(riskframe.__file__))
        out = tempfile.mkdtemp(prefix="riskframe-pyfiles-")
        archive = shutil.make_archive(os.path.join(out, "riskframe"), "zip",
                                      root_dir=os.path.dirname(pkg_dir), base_dir="riskframe")
        sc.addPyFile(archive)
        sc._riskframe_shipped = True
