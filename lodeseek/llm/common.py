"""What several operators share: bounded slices of texts, and lookups that survive hot keys."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1_000_000
HOT_SHARE = 1024


def slices(
    batches: Iterable[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of text, whatever Arrow's batches hold.

    A text longer than that is a slice of its own, so memory follows the longest
    text and not the number of rows of a batch.
    """
    for batch in batches:
        # What earlier slices, batches and tasks of this worker freed goes back to the system.
        release()
        ends = np.cumsum(_lengths(batch.column(batch.schema.get_field_index(text))))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = int(np.searchsorted(ends, before + size, side="right"))
            stop = max(stop, start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def release() -> None:
    """Hand freed memory back, where the C library can: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def _lengths(column: pa.Array) -> np.ndarray:
    lengths = pc.binary_length(column).fill_null(0)
    return lengths.to_numpy(zero_copy_only=False).astype(np.int64)


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The values of a text column, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and its path there; for files that tasks write themselves."""
    if ":" not in uri.split("/")[0]:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of SplitMix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def frequent(groups: DataFrame, count: str, total: int) -> DataFrame:
    """The groups that hold at least ``total / HOT_SHARE`` rows: ``HOT_SHARE`` at most."""
    return groups.where(F.col(count) * HOT_SHARE >= F.lit(total))


def attach(
    rows: DataFrame, groups: DataFrame, key: str, values: list[str], count: str, total: int
) -> DataFrame:
    """``rows`` with the ``values`` of their group; ``groups`` has one row per non-null ``key``.

    The hot groups, at most ``HOT_SHARE`` of them as ``count`` proves, are
    broadcast. The rows that they serve are then dealt out by a random key, so
    that no task of the shuffled join gets more than its share. Rows without a
    group get nulls. Every row is kept.
    """
    hot = frequent(groups, count, total).select(
        F.col(key), F.struct(*values).alias("_hot")
    )
    cold = groups.select(F.col(key).alias("_key"), F.struct(*values).alias("_cold"))
    served = rows.join(F.broadcast(hot), key, "left")
    # Hot rows and rows without a key look for a random key: as nulls they would meet in one
    # task. Should the key exist, its values are not taken.
    lookup = F.col("_hot").isNull() & F.col(key).isNotNull()
    own = F.col(key) if dict(rows.dtypes)[key] == "bigint" else F.xxhash64(key)
    spread = F.when(lookup, own).otherwise((F.rand(11) * float(1 << 62)).cast("long"))
    there = F.col("_key") if dict(groups.dtypes)[key] == "bigint" else F.xxhash64("_key")
    joined = served.withColumn("_at", spread).join(
        cold.withColumn("_there", there),
        (F.col("_at") == F.col("_there")) & (F.col(key) == F.col("_key")),
        "left",
    )
    picked = [
        F.coalesce(F.col(f"_hot.{v}"), F.when(lookup, F.col(f"_cold.{v}"))).alias(v)
        for v in values
    ]
    kept = [F.col(c) for c in rows.columns if c not in values]
    return joined.select(*kept, *picked)


def digest(column: Column) -> Column:
    """A 128-bit name of a text."""
    return F.md5(column)
