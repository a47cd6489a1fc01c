"""Benchmark decontamination by q-gram counts in diagonal bands and banded alignment.

Benchmark texts are cut into windows of ``WINDOW`` characters, every ``WINDOW // 2``
and one at the end. A document is contaminated by an item if a window aligns with a
part of its text at no more than e edits, e being a tenth of the window's length.

A window with n characters within e edits of a text shares at least n - q + 1 - q e of
its q-grams with it, on diagonals (text position less window position) that differ
by e at most. Shared q-grams are therefore counted per window in bands of 2 (e + 1)
diagonals, one every e + 1, so that any such stretch lies whole in a band. Bands that
reach the bound are verified by an alignment within the band; the filter loses nothing.
Texts of a slice are searched as one array, but grams are counted per text and an
alignment ends where its text ends, so a text's result does not depend on its neighbours.

The q-gram index of a block of benchmark texts, about ``BLOCK_CHARS`` characters, goes
to all tasks; larger benchmarks are searched block by block. Documents are not
shuffled, and all of a text is read, in slices of several texts.

Both sides are compared in lower case (where that is one character) with white space
as single blanks; positions that are reported count characters of the text itself.

Defined cases: null and empty texts are clean; null or empty benchmark texts, and
those of under ``least`` characters (``LEAST`` unless set, as any text might share less by
chance), find nothing; where ``least`` is smaller, items under ``LEAST`` characters have to
be equal to a part of the text; shorter items than a window are one window; equal benchmark texts each
report; rows without id are searched and reported with a null id; repeated rows are
reported each; texts of any length are searched whole; extra columns are not read,
and ``clean`` passes them on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import slices, strings

Q = 8
WINDOW = 64
LEAST = 24
BLOCK_CHARS = 2_000_000
_BITS = 20
_BREAK = np.uint32(0xFFFFFFFF)
_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03))
_SPREAD = np.uint64(0x8CB92BA72F3D8DD7)
_VERIFY = 4096
_NEVER = 10_000


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(0x3001, dtype=np.uint32)
    for c in range(0x3000):
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    space = np.array([chr(c).isspace() for c in range(0x3001)])
    lower[space] = 32
    return lower, space


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compared characters of all texts with breaks between, the place of each in its text, borders."""
    lower, space = _tables()
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes + 1)
    low = points <= 0x3000
    out = np.where(low, lower[np.minimum(points, 0x3000)], points)
    blank = low & space[np.minimum(points, 0x3000)]
    place = np.arange(len(points)) - np.repeat(ends - sizes - 1, sizes + 1)
    out[ends - 1] = _BREAK
    blank[ends - 1] = False
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[ends - 1] = True
    borders = np.concatenate(([0], np.cumsum(keep)[ends - 1]))
    return out[keep], place[keep], borders


def grams(points: np.ndarray) -> np.ndarray:
    """A hash of the Q characters from each place on; the last Q - 1 places have none."""
    h = points.astype(np.uint64)
    width = 1
    for step in _STEPS:
        h = h[:-width] * step + h[width:] if len(h) > width else h[:0]
        width *= 2
    return h * _SPREAD


@dataclass
class Index:
    """Windows of a block and where each q-gram stands in them; items too short for a q-gram."""

    items: np.ndarray  # number of the item of each window
    ids: list
    windows: np.ndarray  # characters, padded
    sizes: np.ndarray
    edits: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    mask: np.ndarray
    tiny: list[tuple[int, str]]


def build(items: list[tuple[int | None, str]], least: int = LEAST) -> Index:
    """The index of benchmark texts of at least ``least`` characters."""
    cut, owner, kept, tiny = [], [], [], []
    for item_id, text in items:
        points = normal([text or ""])[0][:-1]
        n = len(points)
        if n < max(1, least):
            continue
        if n < Q:
            tiny.append((len(kept), _text(points)))
            kept.append(item_id)
            continue
        starts = list(range(0, max(1, n - WINDOW + 1), WINDOW // 2))
        if n > WINDOW and starts[-1] != n - WINDOW:
            starts.append(n - WINDOW)
        for s in starts:
            cut.append(points[s : s + WINDOW])
            owner.append(len(kept))
        kept.append(item_id)
    sizes = np.array([len(w) for w in cut], np.int64)
    windows = np.full((len(cut), WINDOW), _BREAK - np.uint32(1), np.uint32)
    for row, w in zip(windows, cut, strict=True):
        row[: len(w)] = w
    h = [grams(w) for w in cut]
    flat = np.concatenate(h) if h else np.empty(0, np.uint64)
    which = np.repeat(np.arange(len(cut)), [len(x) for x in h])
    offset = np.concatenate([np.arange(len(x)) for x in h]) if h else np.empty(0, np.int64)
    order = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[order], return_index=True)
    mask = np.zeros(1 << _BITS, bool)
    mask[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    edits = np.where(sizes < LEAST, 0, np.minimum(sizes // 10, (sizes - Q) // Q))
    return Index(
        np.array(owner, np.int64), kept, windows, sizes, edits, keys,
        np.append(first, len(flat)), which[order], offset[order], mask, tiny,
    )


def _text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def candidates(
    points: np.ndarray, borders: np.ndarray, index: Index
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, first diagonal) of the bands that share enough q-grams with one text."""
    h = grams(points)
    at = np.flatnonzero(index.mask[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    found = np.searchsorted(index.keys, h[at])
    found[found == len(index.keys)] = 0
    same = index.keys[found] == h[at]
    at, found = at[same], found[same]
    n = index.first[found + 1] - index.first[found]
    post = np.repeat(index.first[found] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    window = index.window[post]
    owner = np.searchsorted(borders, at, side="right") - 1
    # Diagonals count from the text's begin, so that bands do not depend on other texts.
    diagonal = np.repeat(at - borders[owner], n) - index.offset[post] + WINDOW
    owner = np.repeat(owner, n)
    # Each diagonal lies in two bands, the one that begins at it or before and the one before.
    band = diagonal // (index.edits[window] + 1)
    # One number names text, window and band: they are of one slice, and far from 2**63.
    span = int(band.max()) + 2 if len(band) else 1
    key = (owner * len(index.sizes) + window) * span + band
    key = np.concatenate((key, key + 1))
    key.sort()
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else key
    count = np.diff(np.append(starts, len(key)))
    band = key[starts] % span - 1
    owner, window = np.divmod(key[starts] // span, len(index.sizes))
    sizes, edits = index.sizes[window], index.edits[window]
    enough = count >= np.maximum(1, sizes - Q + 1 - Q * edits)
    owner, window, band = owner[enough], window[enough], band[enough]
    return owner, window, borders[owner] + band * (index.edits[window] + 1) - WINDOW


def align(
    points: np.ndarray,
    borders: np.ndarray,
    owner: np.ndarray,
    window: np.ndarray,
    diagonal: np.ndarray,
    index: Index,
) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of each window in its band and text, and the place after the aligned part.

    Parts that begin before their text or end behind it cost more than any.
    """
    widest = int(index.edits.max()) if len(index.edits) else 0
    width = 2 * (widest + 1) + 2 * widest + 1
    best = np.empty(len(window), np.int64)
    end = np.empty(len(window), np.int64)
    pad = WINDOW + width + 1
    text = np.concatenate((np.full(pad, _BREAK), points, np.full(2 * pad, _BREAK)))
    shift = np.arange(width)
    for lo in range(0, len(window), _VERIFY):
        w = window[lo : lo + _VERIFY]
        base = diagonal[lo : lo + _VERIFY] - widest + pad
        # Numbers of characters from a row's base to the ends of its text.
        own = owner[lo : lo + _VERIFY]
        first, last = borders[own] + pad - base, borders[own + 1] - 1 + pad - base
        outside = (shift < first[:, None]) | (shift > last[:, None])
        cost = np.where(outside, _NEVER, 0).astype(np.int16)
        done, sizes = np.empty((len(w), width), np.int16), index.sizes[w]
        for i in range(int(sizes.max())):
            there = text[base[:, None] + i + shift]
            step = cost + (there != index.windows[w, i][:, None])
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            step[i + 1 + shift > last[:, None]] = _NEVER
            cost = np.minimum.accumulate(step - shift, axis=1) + shift
            cost = np.minimum(cost, _NEVER).astype(np.int16)
            cost[i + 1 + shift > last[:, None]] = _NEVER
            full = sizes == i + 1
            done[full] = cost[full]
        at = done.argmin(1)
        best[lo : lo + _VERIFY] = done[np.arange(len(w)), at]
        end[lo : lo + _VERIFY] = base + at + sizes - pad
    return best, end


def find(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, windows, edits, start, end): items found in texts, with the fewest edits."""
    if not len(index.sizes) and not index.tiny:
        return []
    points, place, borders = normal(texts)
    rows: dict[tuple[int, int], list] = {}
    if len(index.sizes):
        text, window, diagonal = candidates(points, borders, index)
        edits, end = align(points, borders, text, window, diagonal, index)
        good = edits <= index.edits[window]
        text, window, edits, end = text[good], window[good], edits[good], end[good]
        start = np.maximum(end - index.sizes[window], borders[text])
        found = zip(*(x.tolist() for x in (text, window, edits, start, end)), strict=True)
        for t, w, e, a, b in found:
            own = rows.setdefault((t, int(index.items[w])), [set(), e, a, b])
            own[0].add(w)
            own[1:] = [min(own[1], e), min(own[2], a), max(own[3], b)]
    if index.tiny:
        whole = _text(np.where(points == _BREAK, 0, points))
        for item, word in index.tiny:
            at = whole.find(word)
            while at >= 0:
                t = int(np.searchsorted(borders, at, side="right")) - 1
                rows.setdefault((t, item), [{-1}, 0, at, at + len(word)])[3] = at + len(word)
                at = whole.find(word, at + 1)
    return [
        (t, item, len(ws), e, int(place[a]), int(place[max(b - 1, a)]) + 1)
        for (t, item), (ws, e, a, b) in sorted(rows.items())
    ]


# -- Spark --------------------------------------------------------------------


def blocks(benchmark: DataFrame, least: int) -> Iterator[Index]:
    """Indexes of the benchmark's blocks, one at a time."""
    texts = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-chars // BLOCK_CHARS))
    for b in range(n):
        own = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        rows = own.orderBy("item_id", "text").collect()
        yield build([(r["item_id"], r["text"]) for r in rows], least)


_KINDS = "doc_id long, item_id long, n_windows int, edits int, start int, end int"


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, n_windows, edits, start, end) of every document and item that it holds."""
    spark, out = docs.sparkSession, None
    for index in blocks(benchmark, least):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                found = find(strings(part), shared.value)
                if found:
                    text, item, *rest = zip(*found, strict=True)
                    ids = [shared.value.ids[i] for i in item]
                    yield pa.record_batch(
                        [
                            part.column(0).take(pa.array(text)),
                            pa.array(ids, pa.int64()),
                            *(pa.array(x, pa.int32()) for x in rest),
                        ],
                        ["doc_id", "item_id", "n_windows", "edits", "start", "end"],
                    )

        rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _KINDS)
        out = rows if out is None else out.union(rows)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of the benchmark.

    Only texts go to Python, and one truth value per text comes back.
    """
    for index in blocks(benchmark, least):
        docs = docs.where(_holds_none(docs.sparkSession.sparkContext.broadcast(index))(F.col("text")))
    return docs


def _holds_none(shared: Broadcast):
    @F.arrow_udf("boolean")
    def holds_none(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices([pa.record_batch([texts], ["text"])]):
            bad = {row[0] for row in find(strings(part), shared.value)}
            out += [i not in bad for i in range(part.num_rows)]
        return pa.array(out, pa.bool_())

    return holds_none
