"""Runs of a flat array."""

from __future__ import annotations

import numpy as np


def gather(
    values: np.ndarray, starts: np.ndarray, which: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``values`` one after another, and where each begins (and the end)."""
    size = np.diff(starts)[which]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts[-1])) < 1 << 31 else np.int64
    flat = np.repeat((starts[which] - (ends - size)).astype(kind), size)
    flat += np.arange(total, dtype=kind)
    return values[flat], np.concatenate(([0], ends))
