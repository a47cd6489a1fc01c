"""Project settings: defaults, TOML on disk, resolved paths."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

CONFIG_DIR = ".lodeseek"
CONFIG_FILE = "config.toml"

# What is indexed and what never is.
INCLUDE_GLOBS = (
    "**/*.rs",
    "**/*.py",
    "**/*.go",
    "**/*.ts",
    "**/*.tsx",
    "**/*.js",
    "**/*.jsx",
    "**/*.java",
    "**/*.kt",
    "**/*.md",
)
EXCLUDE_GLOBS = (
    "**/target/**",
    "**/node_modules/**",
    "**/__pycache__/**",
    "**/.venv/**",
    "**/venv/**",
    f"**/{CONFIG_DIR}/**",
    "**/dist/**",
    "**/build/**",
    "**/.git/**",
)


@dataclass(frozen=True)
class ProjectConfig:
    name: str = "project"


@dataclass(frozen=True)
class IndexConfig:
    include_globs: tuple[str, ...] = INCLUDE_GLOBS
    exclude_globs: tuple[str, ...] = EXCLUDE_GLOBS
    max_file_bytes: int = 1_000_000
    max_chunk_chars: int = 2500
    # A run is committed in this many parts; a crash keeps the finished ones.
    commits: int = 1


@dataclass(frozen=True)
class EmbeddingConfig:
    provider: str = "ollama"
    model: str = "embeddinggemma"
    endpoint: str = "http://localhost:11434"
    batch_size: int = 32
    dim: int = 768
    # Each distinct content of a run is embedded once; worth two joins where a model is slow.
    distinct: bool = False
    timeout_seconds: float = 60.0


@dataclass(frozen=True)
class StoreConfig:
    path: str = f"{CONFIG_DIR}/index"
    table: str = "chunks"
    # A new table begins with this many buckets and gets more where they hold over
    # `bucket_rows` rows on average.
    buckets: int = 64
    bucket_rows: int = 200_000


@dataclass(frozen=True)
class Config:
    project: ProjectConfig = field(default_factory=ProjectConfig)
    index: IndexConfig = field(default_factory=IndexConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)
    store: StoreConfig = field(default_factory=StoreConfig)
    target: str = "."

    @property
    def config_dir(self) -> Path:
        return Path(self.target) / CONFIG_DIR

    @property
    def config_path(self) -> Path:
        return self.config_dir / CONFIG_FILE

    @property
    def table_path(self) -> str:
        """Where the chunk table lies; URIs and absolute paths are taken as they are."""
        base = self.store.path
        if "://" not in base and not base.startswith("/"):
            base = f"{self.target}/{base}"
        return f"{base}/{self.store.table}"

    @property
    def skip_log_path(self) -> str:
        return f"{self.table_path}.skipped"


_SECTIONS = {
    "project": ProjectConfig,
    "index": IndexConfig,
    "embedding": EmbeddingConfig,
    "store": StoreConfig,
}


def _section(name: str, values: dict):
    cls = _SECTIONS[name]
    types = {f.name: type(getattr(cls(), f.name)) for f in fields(cls)}
    known = {}
    for key, value in values.items():
        if key not in types:
            continue
        want = types[key]
        if want is tuple and isinstance(value, list) and all(isinstance(v, str) for v in value):
            value = tuple(value)
        elif want is float and type(value) is int:
            value = float(value)
        if type(value) is not want:
            raise ValueError(f"[{name}] {key}: expected {want.__name__}, got {value!r}")
        known[key] = value
    return cls(**known)


def load_config(target: str | Path) -> Config:
    """Settings of a project directory; defaults where it has no config file."""
    root = Path(target).resolve()
    path = root / CONFIG_DIR / CONFIG_FILE
    if not path.exists():
        return Config(project=ProjectConfig(name=root.name), target=str(root))
    data = tomllib.loads(path.read_text(encoding="utf-8"))
    parts = {name: _section(name, data.get(name, {})) for name in _SECTIONS}
    return Config(**parts, target=str(root))


def save_config(cfg: Config, target: str | Path | None = None) -> Path:
    """Write the settings below the project directory and return the file's path."""
    cfg = cfg if target is None else replace(cfg, target=str(Path(target).resolve()))
    cfg.config_dir.mkdir(parents=True, exist_ok=True)
    lines = []
    for name in _SECTIONS:
        lines.append(f"[{name}]")
        # JSON scalars and string lists are valid TOML values.
        values = asdict(getattr(cfg, name)).items()
        lines += [f"{key} = {json.dumps(value, ensure_ascii=False)}" for key, value in values]
        lines.append("")
    cfg.config_path.write_text("\n".join(lines), encoding="utf-8")
    return cfg.config_path
