"""Files of a source tree as DataFrames.

Spark's file sources drop names that begin with `_` or `.`; sources such as
`__init__.py` must be seen, so the tree is listed by a data source of its own.
The tree must be visible to the executors under the same path.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator, Sequence
from pathlib import Path
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodeseek.functions import text as tx
from lodeseek.functions.globs import glob_matcher, matches_globs, selected
from lodeseek.schemas import CONTENT_SCHEMA, FILE_SCHEMA

# Names listed per task in one directory before the directory is shared out.
NAMES_PER_TASK = 20_000
# Bytes of file content per Arrow batch.
BATCH_BYTES = 32 << 20
# What one task reads: so many bytes or so many files, in at most so many tasks.
BYTES_PER_TASK, FILES_PER_TASK, MAX_TASKS = 256 << 20, 500, 100_000


def submodule_globs(root: str | Path) -> list[str]:
    """Exclude globs for the submodules that `.gitmodules` declares, as git itself reads it.

    Without the file, with one that git refuses, or without git, nothing is excluded.
    """
    listed = ["git", "config", "-f", str(Path(root) / ".gitmodules"), "-z"]
    listed += ["--get-regexp", r"^submodule\..*\.path$"]
    try:
        done = subprocess.run(listed, capture_output=True, check=False)
    except OSError:
        return []
    # One entry is the key, a line break, the value and a null.
    entries = done.stdout.decode(errors="surrogateescape").split("\0") if not done.returncode else []
    values = (e.partition("\n")[2].strip(" /") for e in entries)
    return sorted({f"{v}/**" for v in values if v})


class _Shard(InputPartition):
    """A directory to list: with all below it, or one share of its own names."""

    def __init__(self, rel: str, recursive: bool, share: int = 0, shares: int = 1):
        self.rel, self.recursive, self.share, self.shares = rel, recursive, share, shares


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self._root = options["path"].rstrip("/")
        self._excludes = [g for g in options.get("excludes", "").split("\n") if g]
        self._tasks = int(options.get("tasks", "64"))

    def _entries(self, rel: str) -> list[os.DirEntry]:
        try:
            with os.scandir(os.path.join(self._root, rel)) as found:
                return list(found)
        except (FileNotFoundError, NotADirectoryError):
            # Gone since its name was read; any other fault must not look like deletions.
            return []

    def partitions(self) -> Sequence[InputPartition]:
        """Open directories from the top until there is work for every task.

        Directories are only opened here until enough are known; the rest of
        the tree is walked by the tasks. A directory with very many names is
        shared out by a hash of the name.
        """
        excluded = glob_matcher(self._excludes)
        shards: list[InputPartition] = []
        level = [""]
        while level and len(level) < self._tasks:
            below = []
            for rel in level:
                entries = self._entries(rel)
                shares = max(1, -(-len(entries) // NAMES_PER_TASK))
                shards += [_Shard(rel, False, i, shares) for i in range(shares)]
                for e in entries:
                    child = f"{rel}{e.name}/"
                    if e.is_dir(follow_symlinks=False) and not excluded(child):
                        below.append(child)
            level = below
        return shards + [_Shard(rel, True) for rel in level]

    def read(self, shard: _Shard) -> Iterator[tuple]:
        excluded = glob_matcher(self._excludes)
        stack = [shard.rel]
        while stack:
            rel = stack.pop()
            for e in self._entries(rel):
                path = f"{rel}{e.name}"
                if e.is_dir(follow_symlinks=False):
                    if shard.recursive and not excluded(path + "/"):
                        stack.append(path + "/")
                    continue
                if shard.shares > 1 and crc32(e.name.encode()) % shard.shares != shard.share:
                    continue
                try:
                    if not e.is_file():
                        continue
                    stat = e.stat()
                except FileNotFoundError:
                    continue
                yield path, stat.st_size, stat.st_mtime


class TreeSource(DataSource):
    """`spark.read.format("repo_files").load(root)` lists (path, size, mtime)."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self):
        return FILE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(dict(self.options))


def list_tree(spark: SparkSession, root: str | Path, excludes: Sequence[str] = ()) -> DataFrame:
    """Every file below root but those in excluded directories."""
    spark.dataSource.register(TreeSource)
    return (
        spark.read.format("repo_files")
        .option("excludes", "\n".join(excludes))
        # Several directories per core even out subtrees of unlike size.
        .option("tasks", str(8 * spark.sparkContext.defaultParallelism))
        .load(str(root))
    )


def repo_files(
    spark: SparkSession, root: str | Path, include: Sequence[str], exclude: Sequence[str]
) -> DataFrame:
    """Files that match an include glob and no exclude glob, submodules left out."""
    excludes = [*exclude, *submodule_globs(root)]
    return list_tree(spark, root, excludes).where(selected(F.col("path"), include, excludes))


def read_contents(files: DataFrame, root: str | Path, max_bytes: int | None = None) -> DataFrame:
    """(path, size, content) of a listing; vanished files give no row.

    Only names are shuffled: an even spread of the listing gives every task
    about as many files, however the tree groups them. Files that the listing
    shows as oversize are left out; of a listing without sizes they give their size
    and no content, and are not read either. The listing is measured first, so pass
    one that is cheap to read twice.
    """
    base = str(root)
    wanted = files
    measured = "size" in files.columns
    if max_bytes is not None and measured:
        wanted = files.where(F.col("size") <= max_bytes)
    size = F.sum("size") if measured else F.lit(0)
    total = wanted.agg(F.count("*").alias("n"), F.coalesce(size, F.lit(0)).alias("b")).first()
    need = max(-(-total["b"] // BYTES_PER_TASK), -(-total["n"] // FILES_PER_TASK), 1)
    tasks = min(need, MAX_TASKS)
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open(os.path.join(base, path), "rb") as f:
                        size = os.fstat(f.fileno()).st_size
                        if max_bytes is not None and not measured and size > max_bytes:
                            rows.append({"path": path, "size": size, "content": None})
                            continue
                        content = f.read()
                except FileNotFoundError:
                    continue
                rows.append({"path": path, "size": len(content), "content": content})
                held += len(content)
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return wanted.select("path").repartition(tasks).mapInArrow(read, CONTENT_SCHEMA)


def repo_texts(contents: DataFrame) -> DataFrame:
    """(path, lang, text) of read files; lang is NULL for unknown suffixes."""
    return contents.select(
        "path",
        tx.detect_lang(F.col("path")).alias("lang"),
        tx.decode_utf8(F.col("content")).alias("text"),
    )


def list_modules(files: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """Top-level directories that hold files, without hidden and excluded ones."""
    module = F.substring_index("path", "/", 1)
    return (
        files.where(F.contains("path", F.lit("/")))
        .select(module.alias("module"))
        .distinct()
        .where(~F.col("module").startswith("."))
        .where(~matches_globs(F.concat("module", F.lit("/")), exclude))
        .orderBy("module")
    )
