"""Health checks of a project."""

from __future__ import annotations

import os
import shutil
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodeseek.config import Config, load_config
from lodeseek.operators.embed import PROVIDERS


@dataclass(frozen=True)
class CheckResult:
    name: str
    level: str  # PASS, WARN or FAIL
    detail: str


def check_tool(name: str, hint: str, required: bool) -> CheckResult:
    """Whether a program starts; its first line of output is the detail."""
    bad = "FAIL" if required else "WARN"
    path = shutil.which(name)
    if path is None:
        return CheckResult(name, bad, f"{name} not in PATH. Hint: {hint}")
    try:
        done = subprocess.run([path, "--version"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired) as e:
        return CheckResult(name, bad, f"{e}. Hint: {hint}")
    lines = (done.stdout or done.stderr).splitlines()
    return CheckResult(name, "PASS", lines[0] if lines else "(no output)")


def check_provider(cfg: Config) -> CheckResult:
    name = cfg.embedding.provider.lower()
    if name not in PROVIDERS:
        return CheckResult("embedding", "FAIL", f"unknown provider {name!r}")
    detail = name if name == "hash" else f"{name} {cfg.embedding.model} at {cfg.embedding.endpoint}"
    return CheckResult("embedding", "PASS", detail)


def check_table_path(cfg: Config) -> CheckResult:
    """A local table path must be writable; other file systems are tested by the run."""
    if "://" in cfg.table_path:
        return CheckResult("table-path", "PASS", cfg.table_path)
    place = Path(cfg.table_path)
    while not place.exists() and place != place.parent:
        place = place.parent
    if place.is_dir() and os.access(place, os.W_OK):
        return CheckResult("table-path", "PASS", f"writable at {cfg.table_path}")
    return CheckResult("table-path", "FAIL", f"{place} is not a writable directory")


def check_config(cfg: Config) -> CheckResult:
    if cfg.config_path.exists():
        return CheckResult("config", "PASS", str(cfg.config_path))
    return CheckResult("config", "WARN", f"no config at {cfg.config_path}; run init first")


def run_checks(target: str | Path) -> list[CheckResult]:
    cfg = load_config(target)
    return [
        check_tool("java", "Spark needs a Java runtime", True),
        check_tool("git", "needed for index --since", False),
        check_provider(cfg),
        check_table_path(cfg),
        check_config(cfg),
    ]


def checks_table(spark: SparkSession, results: list[CheckResult]) -> DataFrame:
    rows = [(r.name, r.level, r.detail) for r in results]
    return spark.createDataFrame(rows, "name string, level string, detail string")


def render(results: list[CheckResult]) -> str:
    width = max(len(r.name) for r in results)
    return "\n".join(f"  [{r.level:<4}] {r.name.ljust(width)}  {r.detail}" for r in results)


def has_level(results: list[CheckResult], level: str) -> bool:
    return any(r.level == level for r in results)
