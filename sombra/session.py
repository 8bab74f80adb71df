"""Session helpers.

Library code never creates or reconfigures a session; it reads settings from
the one it is given.  ``local_session`` is for tests, the bench and examples.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "sombra") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return ``spark.checkpoint.dir``; set a scratch one only when unset and
    Spark runs in one local process.  A cluster must name a shared folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="sombra-ckpt-")
    sc.setCheckpointDir(path)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sombra`` importable in Python workers (for ``mapInPandas``
    hooks): zip the package once per SparkContext, copy it into the shared
    ``spark.checkpoint.dir`` and ``addPyFile`` it from there."""
    import os
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="sombra-pkg-"), "sombra.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    # stage the zip in the shared checkpoint folder the cluster names, so
    # executors fetch it from shared storage rather than the driver's disk
    shared = ensure_checkpoint_dir(spark).rstrip("/") + "/sombra-pkg/" + app + "/sombra.zip"
    jvm = sc._jvm
    dst = jvm.org.apache.hadoop.fs.Path(shared)
    fs = dst.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path("file://" + out), dst)
    sc.addPyFile(dst.toString())
    _SHIPPED.add(app)
