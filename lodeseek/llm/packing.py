"""Packing: token ids of documents in sequences of one window, in order, with chosen cuts.

Documents of a scan's split, one after another, are a line of ids. A dynamic program
chooses where to cut it. Cuts may lie at ends of documents, at ends of sentences and,
within a sentence, at every ``INNER``-th id. A window of ``n`` ids costs its padding,
``window - n`` or nothing where ``n`` is a power of two (such a sequence is not padded),
and a cut costs a penalty unless a document ends there. With ``f(p)`` the least cost up
to place ``p``::

    f(p) = penalty(p) + min( window - p + min of f(i) + i over p - window <= i < p,
                             f(p - 2**k) for places that a power of two parts )

The inner minimum is over a window that slides with ``p``, so a monotone queue gives it
in constant time. The rest behind the last cut may be cut anywhere: it is padded, or
parted into powers of two, whichever costs less.

A task packs the documents of its split in chunks of about ``CHUNK_IDS`` ids, each ending
with a document, and writes one row per piece. There is no shuffle, nothing is collected,
and memory is a chunk, or the longest document. A sequence's number is made of the
number of its split and its place there, so a task that runs again gives the same rows.

Defined cases: a null text is the empty text, whose only id is the end id; rows with
equal or null ids are documents of their own; an empty table gives no row; a text of any
length is cut, none is shortened; of the table only the id and the text are read.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lodeseek.llm.common import slices
from lodeseek.llm.runs import gather

WINDOW = 4096
END_ID = 2
INNER = 32
CHUNK_IDS = 1 << 20
ENCODE_BYTES = 12_000_000
# Penalties of a cut, in ids of padding: at the end of a sentence, within one.
SENTENCE_CUT = 2.0
INNER_CUT = 12.0
# A sentence ends with one of these, and with what closes quotes or brackets behind it.
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]*$"

# Punctuation that closes a word, which the tokenizer's rule parts from its letters.
CLOSING = r"([\pL\pN])([[:punct:]]+)( |$)"


class UnitEncoder:
    """Ids of texts by a tokenizer that drops white space; each distinct unit is encoded once.

    A unit is what stands between two blanks or before a line break, without closing
    punctuation, which is a unit of its own. As the tokenizer parts texts at white space
    and between letters and punctuation before it joins anything, the ids of the units,
    one after another, are those of the text. New units are encoded many at a time, as
    one text: a unit ends with as many tokens of a word's end as the tokenizer's rule
    finds words in it. At most ``LIMIT`` units are remembered.
    """

    LIMIT = 700_000
    RUN = 20_000
    # Units of these characters alone are parted alike before and after normalisation.
    PLAIN = "^\n?[!-~À-ÿ]+$"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        if self.encoded(["a b\nc."])[0] != [i for x in self.encoded(["a", " b", "\nc", ". "]) for i in x]:
            raise ValueError(f"{path}: not a tokenizer that drops white space")
        rules = json.loads(self.tokenizer.to_str())
        self.rule = next(
            r["pattern"]["Regex"] for r in rules["pre_tokenizer"]["pretokenizers"] if "pattern" in r
        )
        vocabulary = self.tokenizer.get_vocab()
        suffix = rules["model"]["end_of_word_suffix"]
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._forget()

    def encoded(self, texts: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [e.ids for e in found]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encoded(units)
        flat = [i for x in found for i in x]
        return np.array(flat, np.uint32), np.array([len(x) for x in found], np.int64)

    def _joined(self, units: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of units that hold so many words each."""
        ids = np.array(self.encoded([" ".join(units)])[0], np.uint32)
        closing = np.flatnonzero(self.closes[ids])
        ends = np.cumsum(words)
        if not len(closing) or len(closing) != ends[-1] or closing[-1] != len(ids) - 1:
            return self._each(units)
        return ids, np.diff(closing[ends - 1], prepend=-1)

    def _places(self, units: list[str]) -> np.ndarray:
        """Where the units are remembered; new ones are encoded first."""
        new = [u for u in units if u not in self.known]
        if new and len(self.known) + len(new) > self.LIMIT:
            self._forget()
            new = units
        if new:
            column = pa.array(new, pa.string())
            words = pc.count_substring_regex(column, self.rule).to_numpy()
            odd = pc.match_substring(column, "<|")
            plain = pc.and_not(pc.match_substring_regex(column, self.PLAIN), odd)
            plain = plain.to_numpy(zero_copy_only=False) & (words > 0)
            some, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
            ordered = column.take(pa.array(np.concatenate((some, rest)))).to_pylist()
            ids, sizes = [self.ids], []
            for at in range(0, len(some), self.RUN):
                part = some[at : at + self.RUN]
                own, size = self._joined(ordered[at : at + len(part)], words[part])
                ids.append(own)
                sizes.append(size)
            if len(rest):
                own, size = self._each(ordered[len(some) :])
                ids.append(own)
                sizes.append(size)
            first = len(self.known)
            self.known.update(zip(ordered, range(first, first + len(new)), strict=True))
            ends = self.starts[-1] + np.cumsum(np.concatenate(sizes))
            self.starts = np.concatenate((self.starts, ends))
            self.ids = np.concatenate(ids)
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, where each begins and the end, ids behind which a sentence ends)."""
        lines = pc.replace_substring(texts.fill_null(""), "\n", " \n")
        # The tokenizer lowers letters and parts off punctuation itself, but only after it has
        # looked for special tokens.
        if not pc.any(pc.match_substring(lines, "<|")).as_py():
            lines = pc.ascii_lower(lines)
            lines = pc.replace_substring_regex(lines, CLOSING, r"\1 \2\3")
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        units, which = coded.dictionary, coded.indices.to_numpy()
        place = self._places(units.to_pylist())
        ids, starts = gather(self.ids, self.starts, place[which])
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        # A sentence ends with its last unit, and before a unit that begins a line.
        last = pc.match_substring_regex(units, SENTENCE_END).to_numpy(zero_copy_only=False)
        line = pc.starts_with(units, "\n").to_numpy(zero_copy_only=False)
        stops = np.zeros(len(ids) + 1, bool)
        stops[starts[1:][last[which]]] = True
        stops[starts[:-1][line[which]]] = True
        return ids, starts[borders], np.flatnonzero(stops)


@functools.cache
def encoder_of(path: str) -> UnitEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitEncoder(path)


def power_of_two(n: np.ndarray) -> np.ndarray:
    return (n & (n - 1)) == 0


def places(
    total: int, docs: np.ndarray, sentences: np.ndarray, inner: int = INNER
) -> tuple[np.ndarray, np.ndarray]:
    """Places of possible cuts, 0 and ``total`` among them, and the kind of each.

    Kind 0 is an end of a document, 1 an end of a sentence, 2 a place within one. Stretches
    without an end get inner places, ``inner`` ids apart.
    """
    ends = np.union1d(np.append(docs, [0, total]), sentences)
    more = (np.diff(ends) - 1) // inner
    step = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
    within = np.repeat(ends[:-1], more) + step * inner
    at = np.concatenate((ends, within))
    kind = np.concatenate((np.where(np.isin(ends, np.append(docs, [0, total])), 0, 1), np.full(len(within), 2)))
    order = np.argsort(at, kind="stable")
    return at[order], kind[order]


def tail_windows(rest: int, window: int, inner_cut: float) -> tuple[float, list[int]]:
    """Cost and lengths of the sequences of a last stretch, which may be cut anywhere."""
    bits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    padded = float(window - rest)
    parted = (len(bits) - 1) * inner_cut
    return (parted, bits) if parted < padded else (padded, [rest])


def cuts(
    at: np.ndarray,
    kind: np.ndarray,
    window: int = WINDOW,
    sentence_cut: float = SENTENCE_CUT,
    inner_cut: float = INNER_CUT,
) -> tuple[float, list[int]]:
    """The least cost of parting ``at[0]`` to ``at[-1]``, and the places of its cuts, the end too.

    No two neighbouring places may be over ``window`` apart.
    """
    if len(at) < 2:
        return 0.0, []
    penalty = np.array([0.0, sentence_cut, inner_cut])[kind].tolist()
    # Pairs of places that a power of two parts, in order of the later place.
    later, earlier = [], []
    for k in range(window.bit_length()):
        if 1 << k > window:
            break
        want = np.searchsorted(at, at - (1 << k))
        hit = np.flatnonzero(at[want] == at - (1 << k))
        later.append(hit)
        earlier.append(want[hit])
    later, earlier = np.concatenate(later), np.concatenate(earlier)
    order = np.argsort(later, kind="stable")
    earlier = earlier[order].tolist()
    first = np.searchsorted(later[order], np.arange(len(at) + 1)).tolist()

    place, cost, back = at.tolist(), [0.0], [0]
    queue, keys = deque([0]), deque([float(place[0])])
    last = len(place) - 1
    for k in range(1, last):
        p = place[k]
        low = p - window
        while place[queue[0]] < low:
            queue.popleft()
            keys.popleft()
        best, come = keys[0] - low, queue[0]
        for j in earlier[first[k] : first[k + 1]]:
            if cost[j] <= best:
                best, come = cost[j], j
        best += penalty[k]
        cost.append(best)
        back.append(come)
        key = best + p
        while keys and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(k)
        keys.append(key)

    end = place[last]
    tails = []
    j = last - 1
    while j >= 0 and end - place[j] <= window:
        more, sizes = tail_windows(end - place[j], window, inner_cut)
        tails.append((cost[j] + more, len(sizes), j, sizes))
        j -= 1
    total, _, j, sizes = min(tails)
    found = (place[j] + np.cumsum(sizes)).tolist()[::-1]
    while j:
        found.append(place[j])
        j = back[j]
    return total, found[::-1]


def pieces(docs: np.ndarray, ends: list[int]) -> tuple[np.ndarray, ...]:
    """(document, start in it, length, sequence, offset in it) of the pieces of a chunk.

    ``docs`` are the borders of the documents, ``ends`` the places of the cuts.
    """
    borders = np.union1d(docs, ends)
    first, stop = borders[:-1], borders[1:]
    doc = np.searchsorted(docs, first, side="right") - 1
    starts = np.concatenate(([0], ends))
    sequence = np.searchsorted(starts, first, side="right") - 1
    return doc, first - docs[doc], stop - first, sequence, first - starts[sequence]


Chunk = tuple[list[int | None], np.ndarray, np.ndarray, list[int]]


def chunks(
    batches: Iterator[pa.RecordBatch], tokenizer: str, window: int, end_id: int
) -> Iterator[Chunk]:
    """(doc ids, borders of documents, ids, places of the cuts) of whole documents, packed."""
    encoder = encoder_of(tokenizer)
    names: list[int | None] = []
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    stops: list[np.ndarray] = []
    total = 0

    def packed() -> Chunk:
        docs = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        at, kind = places(total, docs, np.concatenate(stops), min(INNER, window))
        return names, docs, np.concatenate(held), cuts(at, kind, window)[1]

    for part in slices(batches, size=ENCODE_BYTES):
        ids, starts, ends = encoder.encode(part.column(1))
        # The end id stands behind each document.
        n = np.diff(starts)
        out = np.full(len(ids) + len(n), end_id, np.uint32)
        moved = np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)
        out[moved] = ids
        # A sentence's end moves by the documents before it; those at a border are left out.
        doc = np.searchsorted(starts, ends, side="left") - 1
        names += part.column(0).to_pylist()
        held.append(out)
        sizes.append(n + 1)
        stops.append(total + (ends + np.maximum(doc, 0))[(doc >= 0) & ~np.isin(ends, starts)])
        total += len(out)
        if total >= CHUNK_IDS:
            yield packed()
            names, held, sizes, stops, total = [], [], [], [], 0
    if total:
        yield packed()


def _over_chunks(
    docs: DataFrame,
    tokenizer: str,
    window: int,
    end_id: int,
    rows: Callable[[Chunk, int], pa.RecordBatch],
    kinds: str,
) -> DataFrame:
    if window < 1:
        raise ValueError("a window holds at least one id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # As in Spark's own increasing ids: the split in the upper bits, the place below.
        sequence = TaskContext.get().partitionId() << 33
        for chunk in chunks(batches, tokenizer, window, end_id):
            yield rows(chunk, sequence)
            sequence += len(chunk[3])

    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def pack_pieces(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: its document, where it lies there, and where it lies in a sequence."""

    def rows(chunk: Chunk, first: int) -> pa.RecordBatch:
        names, borders, ids, ends = chunk
        doc, start, length, sequence, offset = pieces(borders, ends)
        raw, stop = memoryview(ids.astype("<u4").tobytes()), 4 * np.cumsum(length)
        crcs = [
            zlib.crc32(raw[e - 4 * n : e]) for e, n in zip(stop.tolist(), length.tolist(), strict=True)
        ]
        return pa.record_batch(
            {
                "doc_id": pa.array(names, pa.int64()).take(pa.array(doc)),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(crcs, pa.int64()),
                "doc_tokens": pa.array(np.diff(borders)[doc]),
                "sequence_id": pa.array(first + sequence),
                "offset": pa.array(offset),
            }
        )

    kinds = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long"
    )
    return _over_chunks(docs, tokenizer, window, end_id, rows, kinds)


def pack_sequences(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    pad_id: int = 0,
) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences as they are trained on, padded where needed."""

    def rows(chunk: Chunk, first: int) -> pa.RecordBatch:
        _, _, ids, ends = chunk
        stops = np.array(ends)
        n = np.diff(np.concatenate(([0], stops)))
        size = np.where(power_of_two(n), n, window)
        out = np.full(int(size.sum()), pad_id, np.int32)
        shift = np.cumsum(size) - size - (stops - n)
        out[np.arange(len(ids)) + np.repeat(shift, n)] = ids
        borders = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        return pa.record_batch(
            {
                "sequence_id": pa.array(first + np.arange(len(n))),
                "n_tokens": pa.array(n),
                "ids": pa.ListArray.from_arrays(pa.array(borders), pa.array(out)),
            }
        )

    return _over_chunks(
        docs, tokenizer, window, end_id, rows, "sequence_id long, n_tokens long, ids array<int>"
    )
