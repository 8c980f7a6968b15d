"""Session defaults and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "kledger", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow). A cluster keeps its own sizing."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("KLEDGER_DRIVER_MEMORY", "12g"))
    spark = b.getOrCreate()
    ship_code(spark)
    bound_batches(spark)
    return spark


MAX_BATCH_BYTES = 8 << 20
"""An Arrow batch sent to Python holds no more than this (or one row), however long the texts are."""


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to ``MAX_BATCH_BYTES``; a lower limit stays.

    Spark fills a batch with 10,000 rows or 64 MB, and Python holds several copies of it in every task.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now > MAX_BATCH_BYTES:
        spark.conf.set(name, f"{MAX_BATCH_BYTES}b")


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send the package to the executors (once per application), so that tasks can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="kledger-code-")) / "kledger_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Only a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kledger-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder, so lost executors never replay a long plan.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session without one
    gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    # a checkpoint runs its input once to count it and once to write it; held rows make the second run a copy
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()


_PLACES: dict[int, tuple[weakref.ref, str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder: computed once, and read again from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[id(out)] = (weakref.ref(out), path)
    return out


def place(df: DataFrame) -> str:
    """The folder of a written table."""
    ref, path = _PLACES[id(df)]
    if ref() is not df:
        raise KeyError("not a written table")
    return path


def arrow_uri(path: str) -> str:
    """Hadoop writes ``file:/x``; Arrow's file systems want ``file:///x``."""
    return re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}"


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        ref, path = _PLACES.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
