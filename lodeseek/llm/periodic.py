"""Periodic runs of words: a suffix automaton whose paths are recoloured word by word.

A run is a stretch of words of smallest period ``q``, at least ``max(LEAST, 2 q)`` long,
that neither neighbour extends. The states of the suffix automaton of a text form a tree
by their suffix links; the path from a prefix's state to the root holds all strings that
end there. Every word appended recolours that path with its place (the access of a
link-cut tree: the path becomes the preferred one). The path falls into segments of one
old colour each, the place ``j`` where the segment's strings ended last. If the longest
of them has ``i - j`` words or more, the string of ``i - j`` words ends at ``j`` and at
``i``: a square. The first square of every run is met in this way, since the last
occurrence of its root is the one before; squares whose root is a power are never met.
Squares are then extended to runs, each once.

Preferred paths are kept along the heavy paths of the tree, which is complete before the
first access: a heavy path has a stack of the segments on it, nearest to the root on top,
and an access takes off what it covers. That is the amortised ``O(log n)`` segments of
the splay trees that a growing tree would need, without their rotations.

Of a text only its suspect stretches are given to the automaton: words within ``LEAST // 2``
words that occur twice in the text. A run of length ``L`` and period ``q`` repeats its
first and its last ``L - q >= LEAST // 2`` words, which cover it, so that every run lies
in one such stretch with all that could extend it, and the result is that of the text.

Texts are handled one slice at a time, each row by itself: no shuffle, nothing collected,
memory follows the longest text. Defined cases: a null or empty text has no word and no
run; rows with equal ids are rows of their own; a null id leaves the text as it is; an
empty table gives no row; of the table only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeseek.llm.common import mix64, slices, strings

LEAST = 12
SLICE = 2_000_000

Run = tuple[int, int, int]


class Automaton:
    """Suffix automaton of a sequence: lengths and suffix links of its states, and the prefixes' states."""

    def __init__(self, words: list[int]):
        length, link, follow = [0], [-1], [{}]
        ends = []
        last = 0
        for word in words:
            state = len(length)
            length.append(length[last] + 1)
            link.append(0)
            follow.append({})
            at = last
            while at >= 0 and word not in follow[at]:
                follow[at][word] = state
                at = link[at]
            if at >= 0:
                there = follow[at][word]
                if length[there] == length[at] + 1:
                    link[state] = there
                else:
                    twin = len(length)
                    length.append(length[at] + 1)
                    link.append(link[there])
                    follow.append(follow[there].copy())
                    link[there] = link[state] = twin
                    while at >= 0 and follow[at].get(word) == there:
                        follow[at][word] = twin
                        at = link[at]
            ends.append(state)
            last = state
        self.length, self.link, self.ends = length, link, ends

    def heads(self) -> list[int]:
        """The state nearest to the root on each state's heavy path."""
        n = len(self.length)
        link = self.link
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        size, heavy, most = [1] * n, [-1] * n, [0] * n
        for v in reversed(order[1:]):
            p = link[v]
            size[p] += size[v]
            if size[v] > most[p]:
                most[p], heavy[p] = size[v], v
        head = [0] * n
        for v in order[1:]:
            p = link[v]
            head[v] = head[p] if heavy[p] == v else v
        return head


def squares(automaton: Automaton) -> Iterator[tuple[int, int]]:
    """(place of the last word, period) of primitively rooted squares, the first of each run among them."""
    length, link, head = automaton.length, automaton.link, automaton.heads()
    # Per heavy path: lengths of the deepest states of its segments, and their colours.
    depths: list[list[int]] = [[] for _ in length]
    colours: list[list[int]] = [[] for _ in length]
    for i, state in enumerate(automaton.ends):
        while state > 0:
            top = head[state]
            deep, colour = depths[top], colours[top]
            reach = length[state]
            while deep:
                longest = deep[-1]
                if longest > reach:
                    if reach >= i - colour[-1]:
                        yield i, i - colour[-1]
                    break
                gap = i - colour[-1]
                if longest >= gap:
                    yield i, gap
                deep.pop()
                colour.pop()
                if longest == reach:  # the next segment's strings are all longer
                    break
            deep.append(reach)
            colour.append(i)
            state = link[top]


def runs_of(words: list[int], least: int = LEAST) -> list[Run]:
    """(start, length, period) of the runs of a sequence, by start and period."""
    found = []
    until: dict[int, int] = {}
    n = len(words)
    for i, q in squares(Automaton(words)):
        if i <= until.get(q, -1):
            continue
        start, end = i - 2 * q + 1, i + 1
        while start and words[start - 1] == words[start - 1 + q]:
            start -= 1
        while end < n and words[end] == words[end - q]:
            end += 1
        until[q] = end - 1
        if end - start >= least:
            found.append((start, end - start, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def suspects(ids: np.ndarray, borders: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(first, stop) of stretches of words within ``least // 2`` words that their text has twice.

    Equal hashes of different words only add stretches.
    """
    width = least // 2
    if len(ids) < 2 * width:
        return np.empty((0, 2), np.int64)
    with np.errstate(over="ignore"):
        text = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        key = mix64(text[: len(ids) - width + 1].astype(np.uint64) + np.uint64(1 << 40))
        word = mix64(ids.astype(np.uint64) + np.uint64(1))
        for k in range(width):
            key = key * np.uint64(0x9E3779B97F4A7C15) + word[k : len(ids) - width + 1 + k]
        key = mix64(key)
    inside = np.flatnonzero(text[: len(ids) - width + 1] == text[width - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    at = order[again]
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + width, -1)
    covered = np.cumsum(change)[:-1] > 0
    edge = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    # Two texts may meet within a covered stretch; it is parted there.
    cut = np.zeros(len(ids) + 1, bool)
    cut[borders] = True
    step = np.flatnonzero((edge != 0) | cut)
    first, stop = step[:-1], step[1:]
    keep = covered[first] & (stop - first >= least)
    return np.stack((first[keep], stop[keep]), axis=1)


def runs_of_texts(ids: np.ndarray, borders: np.ndarray, least: int = LEAST) -> dict[int, list[Run]]:
    """Runs of each text that has any; a text's words are ``ids`` between its borders."""
    found: dict[int, list[Run]] = {}
    for first, stop in suspects(ids, borders, least).tolist():
        own = runs_of(ids[first:stop].tolist(), least)
        if own:
            text = int(np.searchsorted(borders, first, side="right")) - 1
            shift = first - int(borders[text])
            found.setdefault(text, []).extend((s + shift, n, q) for s, n, q in own)
    return found


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run repeats, that is, all behind a run's first period."""
    gone = np.zeros(len(words), bool)
    for start, length, q in runs:
        gone[start + q : start + length] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


Shape = Callable[[int | None, list[bytes]], list[bytes]]


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of one document in ten end in a loop, chosen by the id's hash; others stay."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * -(-(n - a) // p))[: n - a]


def find_runs(
    docs: DataFrame, least: int = LEAST, shape: Shape | None = None, with_text: bool = False
) -> DataFrame:
    """Per row: doc_id, n_runs, the longest run, hashes of all runs and of the text without repeats.

    The longest run is the first by start and period of those of greatest length. ``shape``
    may change a text's words first. ``with_text`` adds ``runs`` and ``collapsed``, the kept
    words joined by a blank.
    """
    if least < 2:
        raise ValueError("runs of under two words")
    names = {
        "doc_id": "long",
        "n_runs": "long",
        "start": "long",
        "length": "long",
        "period": "long",
        "exponent_milli": "long",
        "runs_sha256": "string",
        "collapsed_sha256": "string",
    }
    if with_text:
        names |= {
            "runs": "array<struct<start:long,length:long,period:long>>",
            "collapsed": "string",
        }
    run = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=SLICE):
            doc_ids = part.column(0).to_pylist()
            words = [t.encode().split() for t in strings(part)]
            if shape:
                words = [shape(d, w) for d, w in zip(doc_ids, words, strict=True)]
            borders = np.concatenate(([0], np.cumsum([len(w) for w in words])))
            known: dict[bytes, int] = {}
            number = known.setdefault
            ids = np.fromiter(
                (number(w, len(known)) for own in words for w in own), np.int64, int(borders[-1])
            )
            found = runs_of_texts(ids, borders, least)
            out: dict[str, list] = {name: [] for name in names}
            for k, (doc_id, own) in enumerate(zip(doc_ids, words, strict=True)):
                runs = found.get(k, [])
                kept = b" ".join(kept_words(own, runs) if runs else own)
                best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
                milli = 1000 * best[1] // best[2] if runs else None
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                row = [doc_id, len(runs), *best, milli]
                row += [hashlib.sha256(x).hexdigest() for x in (listed, kept)]
                if with_text:
                    row.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                    row.append(kept.decode())
                for name, value in zip(names, row, strict=True):
                    out[name].append(value)
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.record_batch(
                {n: pa.array(v, kinds.get(names[n], pa.list_(run))) for n, v in out.items()}
            )

    schema = ", ".join(f"{n} {k}" for n, k in names.items())
    return docs.select("doc_id", "text").mapInArrow(rows, schema)
