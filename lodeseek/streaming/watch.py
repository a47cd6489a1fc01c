"""Keeping the table fresh from a stream of file changes.

A change log is a directory of JSON files with (change, path, ts, seq). It is
written by `record_changes`, which compares two listings of the tree, or by
any other notifier. `watch_changes` reads it as a file stream, so progress is
checkpointed and changes made while nobody was watching are caught up.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodeseek.config import Config
from lodeseek.functions.globs import selected
from lodeseek.plans.index import chunk_table, discover_files, index_contents
from lodeseek.schemas import CHANGE_SCHEMA, FILE_SCHEMA
from lodeseek.sources.repo import read_contents, submodule_globs
from lodeseek.workspace import discard, saved, work_path

# Fixed value: seconds between two batches.
DEBOUNCE_SECONDS = 2.0


def latest_changes(changes: DataFrame) -> DataFrame:
    """(path, change) of the last event of every path.

    The maximum is combined map-side, so a path with very many events sends
    one row per task.
    """
    return changes.groupBy("path").agg(
        F.max_by("change", F.struct("ts", "seq")).alias("change")
    )


def listing_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, path) between two (path, size, mtime) listings."""
    old = before.select("path", F.struct("size", "mtime").alias("_old"))
    new = after.select("path", F.struct("size", "mtime").alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "deleted")
        .when(F.col("_old") != F.col("_new"), "modified")
    )
    return (
        old.join(new, "path", "full_outer")
        .select(change.alias("change"), "path")
        .where(F.col("change").isNotNull())
    )


def states(spark: SparkSession, state_path: str) -> list[int]:
    """Steps of the complete listings that are kept, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for entry in fs.listStatus(path) if fs.exists(path) else []:
        name = entry.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
        if name.startswith("step=") and fs.exists(done):
            found.append(int(name[5:]))
    return sorted(found)


def record_changes(
    spark: SparkSession, cfg: Config, log_path: str, state_path: str, step: int
) -> DataFrame:
    """List the tree, append its changes to the log, keep the listing as state N.

    Changes count from the oldest state that is there. It goes once they are in the
    log, so what a stopped run had not logged is logged by the next one.
    """
    older = [n for n in states(spark, state_path) if n < step]
    listing = discover_files(spark, cfg)
    listing.write.mode("overwrite").parquet(f"{state_path}/step={step}")
    after = spark.read.schema(FILE_SCHEMA).parquet(f"{state_path}/step={step}")
    if older:
        before = spark.read.schema(FILE_SCHEMA).parquet(f"{state_path}/step={older[0]}")
    else:
        before = spark.createDataFrame([], FILE_SCHEMA)
    changes = listing_changes(before, after).select(
        "change",
        "path",
        F.current_timestamp().alias("ts"),
        F.lit(step).cast("bigint").alias("seq"),
    )
    changes.write.mode("append").json(log_path)
    for n in older:
        discard(spark, f"{state_path}/step={n}")
    return spark.read.schema(CHANGE_SCHEMA).json(log_path).where(F.col("seq") == step)


def apply_changes(
    spark: SparkSession,
    cfg: Config,
    changes: DataFrame,
    batch: tuple[str, int] | None = None,
    read: Callable[[DataFrame], DataFrame] | None = None,
) -> bool:
    """Bring the table up to date with one batch of changes; whether it was not there yet.

    Deleted and vanished files lose their rows and the others are replaced, in
    one commit; files over `index.max_file_bytes` keep theirs and are not opened. A commit
    records the `batch` (stream, number), so that a replayed one is left out whole. `read`
    gives (path, size, content) of (path, ..), by default from the source tree.
    """
    if batch and chunk_table(spark, cfg).has_batch(batch):
        return False
    limit = cfg.index.max_file_bytes
    read = read or (lambda live: read_contents(live, cfg.target, limit))
    include = cfg.index.include_globs
    exclude = [*cfg.index.exclude_globs, *submodule_globs(cfg.target)]
    ours = changes.where(selected(F.col("path"), include, exclude))
    work = work_path(spark, "changes")
    try:
        latest = saved(latest_changes(ours), f"{work}/latest")
        live = latest.where(F.col("change") != "deleted")
        found = saved(read(live), f"{work}/contents")
        contents = found.where(F.col("size") <= limit)
        over = found.where(F.col("size") > limit).select("path")
        latest = latest.join(over, "path", "left_anti")
        # A restart or a touched file asks for no vector again where the content is the same.
        index_contents(
            spark, cfg, latest, contents, use_cache=True, work=f"{work}/run", batch=batch
        )
        return True
    finally:
        discard(spark, work)


def watch_changes(
    spark: SparkSession,
    cfg: Config,
    log_path: str,
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Start following the change log. Stop it with `query.stop()`.

    Each batch is applied once: its number goes into the commit, beside the checkpoint's
    place, which names the stream.
    """
    stream = spark.readStream.schema(CHANGE_SCHEMA).json(log_path)

    def apply(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            apply_changes(batch.sparkSession, cfg, batch, (checkpoint, batch_id))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{DEBOUNCE_SECONDS} seconds").start()


def watch(spark: SparkSession, cfg: Config, work: str, rounds: int | None = None) -> None:
    """Poll the tree and follow its changes until interrupted.

    A run goes on from the state that an earlier one in the same folder left, so files
    that went while none ran are reported and unchanged ones are not. Polling lists the
    whole tree; where a change log exists, feed ``watch_changes`` with it instead.
    """
    first = step = max(states(spark, f"{work}/state"), default=-1) + 1
    record_changes(spark, cfg, f"{work}/log", f"{work}/state", step)
    query = watch_changes(spark, cfg, f"{work}/log", f"{work}/checkpoint")
    try:
        while rounds is None or step < first + rounds:
            time.sleep(DEBOUNCE_SECONDS)
            step += 1
            record_changes(spark, cfg, f"{work}/log", f"{work}/state", step)
        query.processAllAvailable()
    except KeyboardInterrupt:
        pass
    finally:
        query.stop()


def stream_latest_changes(stream: DataFrame, work: str) -> DataFrame:
    """Run a change stream to its end and return the last change of every path.

    Each micro-batch is reduced to one row per path and written; the maximum
    over these is the maximum over all events, so no state is held between
    batches and a replayed batch overwrites its own file.
    """
    spark = stream.sparkSession

    def reduce_batch(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("path").agg(
            F.max_by(F.struct("change", "ts", "seq"), F.struct("ts", "seq")).alias("last")
        )
        last.select("path", "last.*").write.mode("overwrite").parquet(
            f"{work}/batches/batch={batch_id}"
        )

    query = (
        stream.writeStream.foreachBatch(reduce_batch)
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return latest_changes(spark.read.schema(CHANGE_SCHEMA).parquet(f"{work}/batches"))
