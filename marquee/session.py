"""Session helpers: build a session for local runs and resolve the shared
checkpoint folder.

On a cluster the session is created by the platform; the library only reads
``spark.checkpoint.dir`` from it.  A machine-local folder is used only when
the master is ``local`` and nothing is configured (tests, bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "marquee") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring the context once.

    Order: the context's folder, then ``spark.checkpoint.dir`` from the
    session; only for a ``local`` master is a fresh temp folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder")
        conf = tempfile.mkdtemp(prefix="marquee-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def materialize(df, name: str = "t"):
    """Stage boundary: write ``df`` once as Parquet under the shared
    checkpoint folder and read it back.

    One job (a reliable ``checkpoint()`` computes its input twice), lineage
    cut, files survive executor loss, and AQE gets real statistics.  The
    table stays until ``drop_tables``.
    """
    import uuid

    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _tables(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over.  It does so
    when the driver's JVM collects what stands for them, which with a large
    heap is long after; between the stages of a long chain they would add up."""
    spark.sparkContext._jvm.System.gc()


def drop_tables(spark: SparkSession) -> bool:
    """Delete the stage tables of this application; results that still read
    them end.  For the end of a job, or between jobs of a long session whose
    results have been written elsewhere."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


_SHIPPED: set = set()


def ship_package(spark) -> None:
    """Make ``marquee`` importable on executors: zip the package once and
    add it with ``addPyFile`` (Spark distributes it to every executor)."""
    import os
    import shutil

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="marquee-pyfiles-")
    archive = shutil.make_archive(os.path.join(out, "marquee"), "zip", os.path.dirname(pkg), "marquee")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
