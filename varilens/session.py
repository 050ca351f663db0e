"""Session helpers: a local session for tests/bench and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Partitions over which the test tables are dealt; set by ``local_session`` only.
INPUT_PARTITIONS = "spark.varilens.inputPartitions"

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "varilens", extra: dict | None = None) -> SparkSession:
    """Local session used by tests and the bench (never on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("VARILENS_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set(INPUT_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must name shared storage and is used as is; a
    missing setting is an error there.  Only a local-mode session without the
    setting (tests, bench) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster file system)")
        d = tempfile.mkdtemp(prefix="varilens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder (for written intermediate tables)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (Arrow UDFs, mapInPandas).

    A local-mode session gets a zip of the package through ``addPyFile`` (once
    per context), so UDF queries work whatever the driver's working folder
    is.  On a cluster the package is deployed with the job
    (``spark-submit --py-files`` / ``spark.submit.pyFiles``), so nothing is
    written here.
    """
    import shutil
    sc = spark.sparkContext
    if not sc.master.startswith("local") or getattr(sc, "_varilens_zip", None):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    base = tempfile.mkdtemp(prefix="varilens-pkg-")
    zpath = shutil.make_archive(os.path.join(base, "varilens"), "zip", root_dir=os.path.dirname(pkg_dir),
                                base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(zpath)
    sc._varilens_zip = zpath
