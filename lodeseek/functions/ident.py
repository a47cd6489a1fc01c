"""Row identity: content hash and chunk id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(path: Column, symbol: Column, start_line: Column) -> Column:
    """First 32 hex digits of SHA-256 over `path::symbol::start_line`."""
    key = F.concat_ws("::", path, symbol, start_line.cast("string"))
    return F.substring(F.sha2(key, 256), 1, 32)


def linear_bucket(path: Column, base: int, buckets: int) -> Column:
    """The bucket of a path, 0 to ``buckets``, by linear hashing from ``base`` buckets on."""
    wide = _width(base, buckets)
    h = F.xxhash64(path)
    far = F.pmod(h, F.lit(wide))
    near = F.pmod(h, F.lit(wide // 2)) if wide > base else far
    return F.when(far < buckets, far).otherwise(near).cast("int")


def linear_home(bucket: int, base: int, buckets: int) -> int:
    """The bucket, of ``buckets``, that holds what will be in a bucket with a higher number."""
    while bucket >= buckets:
        bucket -= _width(base, bucket + 1) // 2
    return bucket


def _width(base: int, buckets: int) -> int:
    """The first of base, 2 base, 4 base, .. that is no smaller than ``buckets``."""
    wide = base
    while wide < buckets:
        wide *= 2
    return wide


def path_bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")
