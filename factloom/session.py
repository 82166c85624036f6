"""Session defaults and the shared scratch folder that every operator writes to."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.jsonGenerator.ignoreNullFields": "false",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and the JSON settings that fingerprints rely on."""
    builder = SparkSession.builder.master(master).appName("factloom")
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local
    session (tests) takes a temporary folder, chosen once; a cluster is refused.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.factloom.scratch", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="factloom-")
    spark.conf.set("spark.factloom.scratch", own)
    atexit.register(_remove, spark, own)
    return own


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``checkpoint()`` at the shared folder unless the context already has one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/factloom/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM may have ended first
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch where the session has Spark's defaults: whole texts travel in them.
ARROW_ROWS, ARROW_BYTES = 2_000, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, where the session has Spark's defaults."""
    for key, usual, value in (("maxRecordsPerBatch", 10_000, ARROW_ROWS), ("maxBytesPerBatch", None, ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.sparkContext.getConf().get(name) is None and (usual is None or spark.conf.get(name) == str(usual)):
            spark.conf.set(name, str(value))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each context, and bound the batches they get."""
    bound_batches(spark)
    context = spark.sparkContext
    if getattr(context, "_factloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="factloom-zip-")) / "factloom_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    context._factloom_shipped = True
