"""Structured Streaming forms of the incremental paths: keyed dedup, windows with late data, change ledgers, sessions.

Each function takes a streaming DataFrame and returns one; run() drives any of them over what is there now and gives
the result as a table, so that a scheduled job and a test use the same code.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievework.operators.merge import upsert
from sievework.session import scratch_path


def read_files(spark: SparkSession, path: str, files_each: int | None = None) -> DataFrame:
    """A stream over a folder or file of Parquet, its schema read once; files arrive in batches of so many."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    """Ask the path's own file system, whatever it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def dedup(stream: DataFrame, keys: list[str], at: str, delay: str = "2 days") -> DataFrame:
    """The first arrival of each key within the watermark; state older than it is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, source: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows and sum of value by tumbling window and source."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, width).alias("w"), source).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts of a key's rows that lie no further apart than the gap."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))


def ledger(stream: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """key, seen, changes: how often a key came and how often its state differed from the one before.

    Arbitrary state by key: the last state and two counters, updated in arrival order inside each batch.
    """
    kind = dict(stream.dtypes)[key]

    def fold(name: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, changes = held.get if held.exists else (None, 0, 0)
        for v in pd.concat(list(parts)).sort_values(order)[state]:
            changes += last is not None and v != last
            last, seen = v, seen + 1
        held.update((last, seen, changes))
        yield pd.DataFrame({key: [name[0]], "seen": [seen], "changes": [changes]})

    rows = stream.select(key, order, F.col(state).cast("string").alias(state))
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, seen long, changes long", "last string, seen long, changes long", "update", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drive a stream over all that is there, then stop; the result is read back from the shared folder.

    append and complete results are written as Parquet, update results batch by batch with the batch number.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, "stream")
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(f"{base}/out")
    else:

        def put(batch: DataFrame, number: int) -> None:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/_no={number}")

        query = writer.outputMode(mode).foreachBatch(put).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    schema = stream.schema if mode == "append" else StructType([*stream.schema, StructField("_batch", IntegerType())])
    out = spark.read.schema(schema).parquet(f"{base}/out")
    if mode == "complete":
        last = out.agg(F.max("_batch")).first()[0]
        return out.where(F.col("_batch") == last).drop("_batch")
    return out


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole versions v=N of a table: those whose write has ended."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in found or [])


def upsert_stream(stream: DataFrame, path: str, keys: list[str], overwrite: list[str], keep: list[str], order: str) -> None:
    """Merge every batch into a Parquet table by key: versions are folders, and the newest whole one counts.

    A batch that is run again after a failure writes the same version again, so the merge is idempotent.
    """
    from sievework.operators.merge import collapse_batch

    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        new = collapse_batch(batch, keys, order, overwrite, keep)
        before = max((n for n in versions(spark, path) if n < number), default=None)
        old = new.limit(0) if before is None else spark.read.parquet(f"{path}/v={before}")
        upsert(old, new, keys, overwrite, keep).write.mode("overwrite").parquet(f"{path}/v={number}")

    query = stream.writeStream.option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
