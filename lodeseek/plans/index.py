"""Index runs: files to chunks to vectors to the table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.config import CONFIG_DIR, Config, save_config
from lodeseek.functions.globs import selected
from lodeseek.functions.ident import path_bucket
from lodeseek.operators.chunk import chunk_files
from lodeseek.operators.embed import (
    embed_distinct,
    embed_rows,
    provider_factory,
    skipped_rows,
)
from lodeseek.operators.merge import (
    existing_hashes,
    flag_cached,
    fresh_rows,
    run_stats,
    stale_keys,
    with_identity,
)
from lodeseek.plans.store import ChunkTable
from lodeseek.sources.git import changed_files
from lodeseek.sources.repo import read_contents, repo_files, submodule_globs
from lodeseek.workspace import discard, saved, work_path


def chunk_table(spark: SparkSession, cfg: Config) -> ChunkTable:
    return ChunkTable(spark, cfg.table_path, cfg.store.buckets, cfg.store.bucket_rows)


def discover_files(spark: SparkSession, cfg: Config, since: str | None = None) -> DataFrame:
    """(path, size, mtime) of all selected files, or of those changed since a git ref."""
    include, exclude = cfg.index.include_globs, cfg.index.exclude_globs
    if since is None:
        return repo_files(spark, cfg.target, include, exclude)
    exclude = [*exclude, *submodule_globs(cfg.target)]
    return changed_files(spark, cfg.target, since).where(
        selected(F.col("path"), include, exclude)
    )


def prune_index(spark: SparkSession, cfg: Config) -> int:
    return chunk_table(spark, cfg).prune(discover_files(spark, cfg))


def embed_chunks(
    chunks: DataFrame,
    table: ChunkTable,
    paths: DataFrame,
    cfg: Config,
    use_cache: bool,
    work: str,
) -> DataFrame:
    """Chunks with identity, vector, skip_reason and whether they were cached."""
    if use_cache:
        known = existing_hashes(table.of_paths(paths), paths)
        chunks = flag_cached(chunks, known)
    else:
        chunks = chunks.withColumn("cached", F.lit(False))
    if cfg.embedding.distinct or cfg.embedding.provider.lower() == "precomputed":
        chunks = saved(chunks, f"{work}/chunks")
        run = embed_distinct(chunks, cfg.embedding, work, where=~F.col("cached"))
    else:
        run = embed_rows(chunks, cfg.embedding, where=~F.col("cached"))
    model = f"{cfg.embedding.provider}/{cfg.embedding.model}/{cfg.embedding.dim}"
    return with_identity(run, model)


def index_contents(
    spark: SparkSession,
    cfg: Config,
    files: DataFrame,
    contents: DataFrame,
    use_cache: bool = False,
    work: str | None = None,
    batch: tuple[str, int] | None = None,
) -> DataFrame:
    """Index (path, size, content) rows and commit them; returns the saved run.

    All paths in `files` count as touched: rows of those that now give no
    chunk are dropped. Contents of any size are taken; a caller with a limit
    leaves larger files out of both tables, so that these keep their rows.
    """
    table = chunk_table(spark, cfg)
    chunks = chunk_files(contents, None, cfg.index.max_chunk_chars)
    work = work or work_path(spark, "run")
    run = saved(
        embed_chunks(chunks, table, files.select("path"), cfg, use_cache, f"{work}-steps"), work
    )
    discard(spark, f"{work}-steps")
    stored = table.read(table.touched(files)).select("path", "id")
    table.change(fresh_rows(run), stale_keys(stored, files.select("path"), run), batch)
    return run


def index_in_parts(
    spark: SparkSession,
    cfg: Config,
    files: DataFrame,
    contents: Callable[[DataFrame], DataFrame],
    use_cache: bool,
    work: str,
) -> DataFrame:
    """Index in `index.commits` parts by path, each complete in itself; returns all their rows."""
    parts = max(1, cfg.index.commits)
    runs = []
    for i in range(parts):
        mine = files.where(path_bucket(F.col("path"), parts) == i) if parts > 1 else files
        runs.append(index_contents(spark, cfg, mine, contents(mine), use_cache, f"{work}/run-{i}"))
    return reduce(DataFrame.unionByName, runs)


def write_skip_log(run: DataFrame, path: str) -> bool:
    """Overwrite the skip log with this run's skips; leaves it alone without any."""
    skips = skipped_rows(run)
    if skips.isEmpty():
        return False
    skips.write.mode("overwrite").json(path)
    return True


def index_repo(
    spark: SparkSession, cfg: Config, since: str | None = None, force: bool = False
) -> dict[str, int]:
    """Index a source tree; the counters of the run are returned.

    With `since`, only files changed after that git ref are read, and chunks
    whose content is unchanged keep their vectors unless `force` is set. The
    run is committed in `index.commits` parts by path, each complete in itself.
    """
    provider_factory(cfg.embedding)
    table = chunk_table(spark, cfg)
    table.check_writable()
    table.create()
    work = work_path(spark, "index")
    try:
        files = saved(discover_files(spark, cfg, since), f"{work}/files")
        use_cache = since is not None and not force
        # Files over the limit are counted and keep the rows that they have.
        over = F.coalesce(F.col("size") > cfg.index.max_file_bytes, F.lit(False))
        run = index_in_parts(
            spark, cfg, files.where(~over), lambda f: read_contents(f, cfg.target), use_cache, work
        )
        write_skip_log(run, cfg.skip_log_path)
        return run_stats(files, run, cfg.index.max_file_bytes).first().asDict()
    finally:
        discard(spark, work)


def init_project(cfg: Config, force: bool = False) -> Path:
    """Write a default config and ignore its directory; an existing one is kept."""
    if cfg.config_path.exists() and not force:
        raise FileExistsError(str(cfg.config_path))
    path = save_config(cfg)
    (cfg.config_dir / "digests").mkdir(exist_ok=True)
    ignore = Path(cfg.target) / ".gitignore"
    old = ignore.read_text(encoding="utf-8", errors="replace") if ignore.exists() else ""
    if f"{CONFIG_DIR}/" not in old:
        kept = f"{old.rstrip()}\n" if old.strip() else ""
        ignore.write_text(f"{kept}# index and settings\n{CONFIG_DIR}/\n", encoding="utf-8")
    return path
