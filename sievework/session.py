"""Session construction and the shared scratch area."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", shuffle_partitions: int = 8, app: str = "sievework") -> SparkSession:
    """A local session with the settings the engine is written for: UTC and AQE."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SIEVEWORK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    Where that is unset a local master, as in tests, gets a temporary folder for the life of the application; any
    other master is an error, for its machines share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="sievework-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        base = _LOCAL[app]
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the scratch folder; what is there when the application ends is deleted then."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


_MADE = threading.local()


def _made() -> list[str]:
    if not hasattr(_MADE, "paths"):
        _MADE.paths = []
    return _MADE.paths


def written(df: DataFrame, name: str = "table", keep: bool = False) -> DataFrame:
    """Cut the lineage of df: write it as Parquet to the shared scratch folder and read it back.

    keep: release() leaves the table alone.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if not keep:
        _made().append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for made_since()."""
    return len(_made())


def made_since(began: int) -> list[str]:
    """The scratch tables that this thread has written since a mark and not released."""
    return _made()[began:]


def release(spark: SparkSession, paths: list[str], but: DataFrame | None = None) -> None:
    """Delete scratch tables, but for those that a DataFrame still reads.

    Whoever calls it knows that nothing else will read them, and names what it wrote itself: an operator that has
    written its result's inputs, or a stage whose predecessor's result is stored.
    """
    held = {f.rsplit("/", 2)[-2] for f in but.inputFiles()} if but is not None else set()
    made = _made()
    for path in paths:
        if path.rsplit("/", 1)[-1] in held:
            continue
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in made:
            made.remove(path)


def keep_only(spark: SparkSession, began: int, *frames: DataFrame) -> None:
    """Delete the scratch tables written since a mark, but for those that these DataFrames read."""
    held = {f.rsplit("/", 2)[-2] for df in frames for f in df.inputFiles()}
    release(spark, [p for p in made_since(began) if p.rsplit("/", 1)[-1] not in held])


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver forget plans that nothing refers to, and with them their shuffle files on the executors' disks.

    Spark deletes these when the driver's garbage collector finds a plan unused, which on a large heap may be hours later.
    """
    for _ in range(2):  # the first round finds the plans, the second what they held
        gc.collect()
        spark._jvm.java.lang.System.gc()
        time.sleep(0.3)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Names like the given ones that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        while base.lower() in taken:
            base = f"_{base}"
        taken.add(base.lower())
        out.append(base)
    return out


#: Rows of whole texts that pass to a Python worker at a time.
TEXT_ROWS = 2000


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts, which hold 10,000 rows by default, so that a worker holds some MB of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))
