"""Row-level changes of a chunk table as joins: replace, delete, prune, reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.ident import chunk_id

CACHE_KEY = ["path", "symbol", "start_line"]


def replace_by_path(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows of other paths and all incoming rows.

    The distinct paths are combined map-side before they are shuffled. Whether
    they are broadcast is left to their measured size; otherwise adaptive
    execution splits the partition of a path that holds many stored rows.
    """
    paths = incoming.select("path").distinct()
    return stored.join(paths, "path", "left_anti").unionByName(incoming)


def replace_by_id(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    ids = incoming.select("id").distinct()
    return stored.join(ids, "id", "left_anti").unionByName(incoming)


def delete_path(stored: DataFrame, path: str) -> DataFrame:
    return stored.where(F.col("path") != path)


def live_rows(rows: DataFrame, deletes: DataFrame, small: bool = True) -> DataFrame:
    """Rows (path, id, commit, ..) that no later delete (path, id, commit) names.

    A delete without an id names all rows of its path. Where the deletes are known to be
    few they are broadcast, and the rows are filtered where they lie.
    """
    hint = F.broadcast if small else (lambda df: df)
    last = F.max("commit")
    paths = deletes.where("id IS NULL").groupBy("path").agg(last.alias("_path_gone"))
    ids = deletes.where("id IS NOT NULL").groupBy("id").agg(last.alias("_id_gone"))
    gone = F.greatest(F.coalesce("_path_gone", F.lit(-1)), F.coalesce("_id_gone", F.lit(-1)))
    return (
        rows.join(hint(paths), "path", "left")
        .join(hint(ids), "id", "left")
        .where(F.col("commit") >= gone)
        .select(*rows.columns)
    )


def stale_keys(stored: DataFrame, touched: DataFrame, run: DataFrame) -> DataFrame:
    """(path, id) of stored rows that go after a run over the `touched` paths.

    `run` has id, `cached` and `skip_reason`. Of touched paths, stored rows stay whose
    content is unchanged or whose new embedding failed. Only names are joined.
    """
    kept = run.where(F.col("cached") | F.col("skip_reason").isNotNull()).select("id").distinct()
    return (
        stored.select("path", "id")
        .join(touched.select("path").distinct(), "path", "left_semi")
        .join(kept, "id", "left_anti")
        .select("path", "id")
    )


def indexed_paths(stored: DataFrame) -> DataFrame:
    return stored.select("path").distinct()


def orphan_paths(stored: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Indexed paths that no file stands for any more."""
    return indexed_paths(stored).join(on_disk.select("path"), "path", "left_anti")


def prune_orphans(stored: DataFrame, on_disk: DataFrame) -> DataFrame:
    return stored.join(on_disk.select("path").distinct(), "path", "left_semi")


def existing_hashes(stored: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, symbol, start_line, content_hash) of stored rows of the given paths.

    Rows without a hash are left out, so that they count as changed; of rows
    with equal keys one is kept.
    """
    return (
        stored.where(F.coalesce(F.length("content_hash"), F.lit(0)) > 0)
        .select(*CACHE_KEY, "content_hash", "indexed_at")
        .join(paths.select("path").distinct(), "path", "left_semi")
        .groupBy(*CACHE_KEY)
        .agg(F.max_by("content_hash", F.struct("indexed_at", "content_hash")).alias("content_hash"))
    )


def flag_cached(chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    """Add `cached`: the stored row of the same key has the same content hash."""
    known = hashes.select(*CACHE_KEY, F.col("content_hash").alias("_known"))
    return (
        chunks.join(known, CACHE_KEY, "left")
        .withColumn("cached", F.coalesce(F.col("_known") == F.col("content_hash"), F.lit(False)))
        .drop("_known")
    )


def cache_hits(chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    return chunks.join(hashes, [*CACHE_KEY, "content_hash"], "left_semi")


def cache_misses(chunks: DataFrame, hashes: DataFrame) -> DataFrame:
    return chunks.join(hashes, [*CACHE_KEY, "content_hash"], "left_anti")


def with_identity(chunks: DataFrame, model: str) -> DataFrame:
    """Add id, embedding model and one timestamp for the whole run."""
    return (
        chunks.withColumn("id", chunk_id(F.col("path"), F.col("symbol"), F.col("start_line")))
        .withColumn("embedding_model", F.lit(model))
        .withColumn("indexed_at", F.current_timestamp())
    )


def reconcile(stored: DataFrame, touched: DataFrame, run: DataFrame) -> DataFrame:
    """The table after a run over the `touched` paths.

    `run` has the stored columns plus `cached` and `skip_reason`. Of touched
    paths only these rows remain: new vectors, stored rows whose content is
    unchanged, and stored rows whose new embedding failed. Symbols that are
    gone lose their rows.
    """
    gone = stale_keys(stored, touched, run).select("id")
    return stored.join(gone, "id", "left_anti").unionByName(
        fresh_rows(run).select(*stored.columns)
    )


def fresh_rows(run: DataFrame) -> DataFrame:
    """The rows of a run that were embedded."""
    return run.where(~F.col("cached") & F.col("skip_reason").isNull())


def run_stats(files: DataFrame, run: DataFrame, max_file_bytes: int) -> DataFrame:
    """One row of the six counters of an index run, from one aggregation."""
    names = ["files", "chunks", "embedded", "skipped", "cache_hits", "chunker_skipped_files"]
    one, none = F.lit(1), F.lit(0)
    per_file = files.select(
        one.alias("files"),
        *[none.alias(n) for n in names[1:5]],
        (F.col("size") > max_file_bytes).cast("int").alias("chunker_skipped_files"),
    )
    per_chunk = run.select(
        none.alias("files"),
        one.alias("chunks"),
        (F.col("vector").isNotNull() & ~F.col("cached")).cast("int").alias("embedded"),
        F.col("skip_reason").isNotNull().cast("int").alias("skipped"),
        F.col("cached").cast("int").alias("cache_hits"),
        none.alias("chunker_skipped_files"),
    )
    both = per_file.unionByName(per_chunk)
    return both.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
