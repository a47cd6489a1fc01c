import dataclasses
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lodeseek.config import EmbeddingConfig, StoreConfig, load_config  # noqa: E402
from lodeseek.workspace import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("work")
    session = local_session(
        4, **{"spark.checkpoint.dir": str(work), "spark.sql.shuffle.partitions": "4"}
    )
    yield session
    session.stop()


@pytest.fixture
def project(tmp_path):
    """A source tree and its settings, with vectors that need no server."""

    def write(files: dict[str, str | bytes], **index):
        for name, content in files.items():
            path = tmp_path / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content if isinstance(content, bytes) else content.encode())
        cfg = load_config(tmp_path)
        return dataclasses.replace(
            cfg,
            embedding=EmbeddingConfig(provider="hash", dim=16),
            store=StoreConfig(buckets=4),
            index=dataclasses.replace(cfg.index, **index),
        )

    return write
