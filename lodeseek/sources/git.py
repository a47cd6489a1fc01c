"""Changed files of a git work tree."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHANGED = (
    ("diff", "--relative", "--name-only", "-z", "{since}..HEAD"),
    ("diff", "--relative", "--name-only", "-z"),
    ("diff", "--relative", "--name-only", "-z", "--cached"),
    ("ls-files", "--others", "--exclude-standard", "-z"),
)


def _git(root: str | Path, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", str(root), *args], capture_output=True, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} failed: {done.stderr.decode(errors='replace').strip()}")
    return [n for n in done.stdout.decode(errors="surrogateescape").split("\0") if n]


def union_changes(*name_lists: DataFrame) -> DataFrame:
    """Distinct non-blank paths of several change lists."""
    out = name_lists[0].select("path")
    for names in name_lists[1:]:
        out = out.unionByName(names.select("path"))
    return out.where(F.length("path") > 0).distinct()


def changed_files(spark: SparkSession, root: str | Path, since: str) -> DataFrame:
    """(path, size, mtime) of files changed since a ref, staged or not, or untracked.

    git runs on the driver, as one program over one work tree; its answer is
    a list of names, which then goes through the same plan as a full listing.
    """
    if since.startswith("-"):
        raise ValueError(f"not a git ref: {since!r}")
    rows = []
    for name in {n for args in _CHANGED for n in _git(root, *(a.format(since=since) for a in args))}:
        path = os.path.join(str(root), name)
        if os.path.isfile(path):
            stat = os.stat(path)
            rows.append((name, stat.st_size, stat.st_mtime))
    return spark.createDataFrame(rows, "path string, size bigint, mtime double")
