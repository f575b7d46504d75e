"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.enabled": "false",
    # of a repeated key the last value holds
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(master: str | None = None, app: str = "rosterlake", **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS)
    if master:
        builder = builder.master(master)
    return builder.config(map={k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read, from ``spark.checkpoint.dir``.

    Only where none is named and the session runs on one machine, as in tests,
    is a temporary folder chosen and set as the checkpoint folder. On a cluster
    executors could not read it, so there its lack is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can read")
        found = "file://" + tempfile.mkdtemp(prefix="rosterlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def materialise(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    It cuts the lineage like ``checkpoint()`` but keeps columns compressed and
    prunable. Nothing is held in executors, so a lost executor loses no data.
    The folder is removed when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/rosterlake/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, and set what JSON with repeated keys needs."""
    context = spark.sparkContext
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="rosterlake-code-")) / "rosterlake.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(Path("rosterlake") / source.relative_to(package)))
    context.addPyFile(str(target))
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
