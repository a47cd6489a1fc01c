"""Token-id output: documents as one stream of ids in files of Simple-8b words.

File format, little-endian throughout::

    "S8BTOK01"
    words      64-bit; the blocks one after another, each of BLOCK ids (the last: fewer)
    footer     doc ids (int64), null flags (uint8), id counts (int64), word offset of
               each block (int64)
    tail       documents, blocks, ids (int64 each), crc32 of the footer (uint32), "S8BTOK01"

A word's upper 4 bits are a selector that says how many ids the other 60 bits hold.
Selector 0 is the escape: the next word is one value as it is, for values of over
60 bits. Blocks do not share words, so that a reader starts at any block, and all
blocks of a file are packed and unpacked side by side in numpy.

Documents are ordered by id with a range exchange, without a global sort; each task
streams its range into one file. A try writes a file of its own name, and only the
files of successful tasks are named by the manifest, so a lost executor or a second
try leaves nothing that a reader would see. Where a range's ids start follows from
the manifest's counts.

Defined cases: a null text is the empty text, whose only id is the end id; rows with
a null id come first; rows with equal ids are ordered by their text's hash and then
stand as they come; an empty table gives no file and no row; extra columns are not read.
"""

from __future__ import annotations

import functools
import os
import re
import string
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodeseek.llm.common import file_system, slices
from lodeseek.llm.runs import gather
from lodeseek.workspace import saved

MAGIC = b"S8BTOK01"
BLOCK = 4096
END_ID = 2
ENCODE_BYTES = 12_000_000
# Bits per id of selectors 1 to 15; each word holds 60 // bits of them.
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
COUNTS = 60 // BITS
ESCAPE = 0


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, and the word at which each block begins (one more: the end)."""
    values = values.astype(np.uint64, copy=False)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    selector, count = _choose(values)
    place = np.arange(blocks) * BLOCK
    stop = np.minimum(place + BLOCK, len(values))
    at, owner = [], []
    live = np.arange(blocks)
    while len(live):  # one word of every block per step
        at.append(place[live])
        owner.append(live)
        place[live] += count[place[live]]
        live = live[place[live] < stop[live]]
    at, owner = np.concatenate(at), np.concatenate(owner)
    order = np.lexsort((at, owner))
    at, owner = at[order], owner[order]
    chosen = selector[at]
    escaped = chosen == ESCAPE
    size = 1 + escaped
    slot = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s, (bits, n) in enumerate(zip(BITS, COUNTS, strict=True), start=1):
        mine = chosen == s
        first = at[mine]
        word = np.full(len(first), np.uint64(s << 60))
        for j in range(n if len(first) else 0):
            word |= values[first + j] << np.uint64(j * bits)
        words[slot[mine]] = word
    words[slot[escaped] + 1] = values[at[escaped]]
    held = np.bincount(owner, weights=size, minlength=blocks).astype(np.int64)
    return words, np.concatenate(([0], np.cumsum(held)))


def _choose(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: the selector that packs most of the ids from here to the block's end."""
    n = len(values)
    selector, count = np.zeros(n, np.int8), np.ones(n, np.int64)
    widest = int(values.max()).bit_length()
    for s in range(len(BITS), 0, -1):
        bits, want = int(BITS[s - 1]), int(COUNTS[s - 1])
        if bits >= widest:
            first = np.arange(max(0, n - want + 1))
        else:
            small = np.flatnonzero(values < np.uint64(1 << bits))
            head, tail = small[: len(small) - want + 1], small[want - 1 :]
            first = head[tail - head == want - 1] if len(small) >= want else small[:0]
        first = first[first % BLOCK + want <= BLOCK]
        selector[first], count[first] = s, want
    return selector, count


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ids of whole blocks; raises where the words do not hold exactly ``n`` of them."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    lead = np.flatnonzero(selector == ESCAPE)
    # The word after an escape is a value; it may look like an escape itself.
    previous = -2
    for i in lead:
        if previous != i - 1 or not raw[i]:
            if i + 1 >= len(words):
                raise ValueError("an escape without its value")
            raw[i + 1], previous = True, i
    head = ~raw
    if (selector[head] > len(BITS)).any():
        raise ValueError("unknown selector")
    held = np.where(selector[head] == ESCAPE, 1, COUNTS[np.maximum(selector[head], 1) - 1])
    ends = np.cumsum(held)
    if (ends[-1] if len(ends) else 0) != n:
        raise ValueError(f"{ends[-1] if len(ends) else 0} ids instead of {n}")
    out = np.empty(n, np.uint64)
    at, starts = np.flatnonzero(head), ends - held
    for s, (bits, count) in enumerate(zip(BITS, COUNTS, strict=True), start=1):
        mine = selector[at] == s
        word, start = words[at[mine]], starts[mine]
        mask = np.uint64((1 << int(bits)) - 1)
        for j in range(count):
            out[start + j] = (word >> np.uint64(j * bits)) & mask
    escaped = selector[at] == ESCAPE
    out[starts[escaped]] = words[at[escaped] + 1]
    return out


_SPACE = r"\s\x0b\x1c-\x1f\x{85}\pZ"


class WordEncoder:
    """A tokenizer's ids of whole texts, each distinct word encoded once.

    The tokenizer's rule begins a new piece at a blank or line break between two
    visible characters, and where punctuation follows a letter or digit. So a text
    is cut into words, each with its blank or line break, and a word's closing
    punctuation is cut off; the ids of these units, one after another, are those of
    the text. A text in which a blank or line break touches other white space, or
    that spells a special token, goes to the tokenizer in one piece. New units are
    encoded many at a time, as one text; a token that begins with a blank or line
    break begins a unit. At most ``LIMIT`` words are remembered.
    """

    LIMIT = 600_000
    RUN = 20_000

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([f"[ \n][{_SPACE}]", f"[{_SPACE}][ \n]", *map(re.escape, special)])
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        heads = tuple(self.tokenizer.encode(c, add_special_tokens=False).tokens[0] for c in " \n")
        self.begins[[i for t, i in vocabulary.items() if t.startswith(heads)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(2, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _encode_joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that begin with a blank or line break, and their numbers of ids."""
        ids, sizes = [], []
        for at in range(0, len(units), self.RUN):
            some = units[at : at + self.RUN]
            own = self._encode(["".join(some)])[0]
            starts = np.flatnonzero(self.begins[own])
            size = np.diff(np.append(starts, len(own)))
            if len(starts) != len(some) or starts[0]:
                each = self._encode(some)
                own, size = np.concatenate(each), np.array([len(x) for x in each])
            ids.append(own)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _places(self, units: list[str]) -> np.ndarray:
        """Where the units are remembered; new ones are encoded first."""
        new = [u for u in units if u not in self.known]
        if new and len(self.known) + len(new) > self.LIMIT:
            self._forget()
            new = [u for u in units if u]
        if new:
            joined = [u for u in new if u[0] in " \n" and u[1:] and not u[-1].isspace()]
            rest = list(set(new).difference(joined)) if len(joined) < len(new) else []
            parts, sizes = [self.ids], []
            if joined:
                ids, size = self._encode_joined(joined)
                parts.append(ids)
                sizes.append(size)
            if rest:
                each = self._encode(rest)
                parts += each
                sizes.append(np.array([len(x) for x in each]))
            first = len(self.known)
            self.known.update(zip([*joined, *rest], range(first, first + len(new)), strict=True))
            ends = self.starts[-1] + np.cumsum(np.concatenate(sizes))
            self.starts = np.concatenate((self.starts, ends))
            self.ids = np.concatenate(parts)
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, each with its blank or line break, and where each begins."""
        stems = pc.utf8_rtrim(words, string.punctuation)
        cut = pc.match_substring_regex(stems, r"[\pL\pN]\z")
        stems = pc.if_else(cut, stems, words)
        extra = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy()
        at = np.flatnonzero(extra)
        closed = words.take(pa.array(at)).to_pylist()
        ends = [w[-n:] for w, n in zip(closed, extra[at].tolist(), strict=True)]
        blank = pc.binary_join_element_wise(pa.scalar(""), stems, " ")
        coded = pc.if_else(pc.starts_with(stems, "\n"), stems, blank).dictionary_encode()
        distinct = list(dict.fromkeys(ends))
        stem_list = coded.dictionary.to_pylist()
        place = self._places([*stem_list, *distinct])
        suffix = dict(zip(distinct, place[len(stem_list) :].tolist(), strict=True))
        units = np.zeros((len(words), 2), np.int64)
        units[:, 0] = place[coded.indices.to_numpy()]
        units[at, 1] = [suffix[e] for e in ends]
        ids, starts = gather(self.ids, self.starts, units.ravel())
        return ids, starts[::2]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array; null is the empty text."""
        texts = texts.fill_null("")
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for i in np.flatnonzero(whole):
            out[i] = self._encode([texts[i].as_py()])[0]
        at = np.flatnonzero(~whole)
        if not len(at):
            return out
        lines = pc.replace_substring(texts.take(pa.array(at)), "\n", " \n")
        split = pc.split_pattern(lines, " ")
        flat = split.flatten()
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        # The first word of a text has no blank before it.
        lead = self._encode(flat.take(pa.array(borders[:-1])).to_pylist())
        coded = flat.dictionary_encode()
        word_ids, word_starts = self._words(coded.dictionary)
        which = coded.indices.to_numpy()
        ids, starts = gather(word_ids, word_starts, which)
        skip = np.diff(word_starts)[which[borders[:-1]]]
        lows, highs = starts[borders[:-1]] + skip, starts[borders[1:]]
        for i, first, lo, hi in zip(at, lead, lows, highs, strict=True):
            out[i] = np.concatenate((first, ids[lo:hi]))
        return out


@functools.cache
def encoder_of(path: str) -> WordEncoder:
    """A worker's encoder; one process encodes one task at a time, so threads would only wait."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


class ShardWriter:
    """Streams documents into one file; memory is a few blocks and the footer."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.out = fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.rest: list[np.ndarray] = []
        self.held = self.words = self.total = 0
        self.docs, self.nulls, self.counts, self.offsets = [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self.rest.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= 256 * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        values = np.concatenate(self.rest) if self.rest else np.empty(0, np.uint32)
        words, offsets = pack(values[:n])
        self.out.write(words.astype("<u8").tobytes())
        self.offsets.append(offsets[:-1] + self.words)
        self.words += len(words)
        self.rest, self.held = [values[n:]], len(values) - n

    def close(self) -> tuple[int, int]:
        self._flush(self.held)
        offsets = np.concatenate(self.offsets)
        footer = (
            np.array(self.docs, "<i8").tobytes()
            + np.array(self.nulls, "u1").tobytes()
            + np.array(self.counts, "<i8").tobytes()
            + offsets.astype("<i8").tobytes()
        )
        self.out.write(footer)
        sizes = (len(self.docs), len(offsets), self.total)
        self.out.write(struct.pack("<qqqI", *sizes, zlib.crc32(footer)) + MAGIC)
        self.out.close()
        return len(self.docs), self.total


_TAIL = struct.calcsize("<qqqI") + len(MAGIC)


def read_shard(
    fs: pafs.FileSystem, path: str
) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, id counts, ids) in runs of documents; checks every part of the file.

    Ids are unpacked some hundred blocks at a time, from the block's offset on.
    """
    with fs.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(_TAIL, size - _TAIL) if size >= _TAIL + len(MAGIC) else b""
        if tail[-len(MAGIC) :] != MAGIC or f.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path}: not a token file")
        n_docs, n_blocks, total, crc = struct.unpack("<qqqI", tail[: -len(MAGIC)])
        length = 17 * n_docs + 8 * n_blocks
        if not 0 <= length <= size - _TAIL - len(MAGIC) or min(n_docs, n_blocks) < 0:
            raise ValueError(f"{path}: damaged tail")
        footer = f.read_at(length, size - _TAIL - length)
        if zlib.crc32(footer) != crc:
            raise ValueError(f"{path}: damaged footer")
        docs = np.frombuffer(footer, "<i8", n_docs)
        nulls = np.frombuffer(footer, "u1", n_docs, 8 * n_docs)
        counts = np.frombuffer(footer, "<i8", n_docs, 9 * n_docs)
        offsets = np.frombuffer(footer, "<i8", n_blocks, 17 * n_docs)
        words = (size - _TAIL - length - len(MAGIC)) // 8
        if counts.sum() != total or -(-total // BLOCK) != n_blocks:
            raise ValueError(f"{path}: counts do not add up")
        offsets = np.append(offsets, words)
        ends = np.cumsum(counts)
        pending, first = np.empty(0, np.uint32), 0
        for b in range(0, n_blocks, 256):
            last = min(b + 256, n_blocks)
            n = min(last * BLOCK, total) - b * BLOCK
            lo, hi = int(offsets[b]), int(offsets[last])
            raw = np.frombuffer(f.read_at(8 * (hi - lo), len(MAGIC) + 8 * lo), "<u8")
            pending = np.concatenate((pending, unpack(raw, n).astype(np.uint32)))
            done = int(np.searchsorted(ends, b * BLOCK + n, side="right"))
            if done > first:
                taken = int(counts[first:done].sum())
                names = [None if z else int(d) for d, z in zip(docs[first:done], nulls[first:done])]
                yield names, counts[first:done], pending[:taken]
                pending, first = pending[taken:], done


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode (doc_id, text) into files below ``folder``; returns the manifest, read from there."""
    key = F.xxhash64("text")
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), key)
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), key)
    )
    files = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = encoder_of(tokenizer), None
        end = np.array([end_id], np.uint32)
        fs, root = file_system(files)
        name = f"{uuid.uuid4().hex}.s8b"
        for part in slices(batches, size=ENCODE_BYTES):
            if writer is None:
                fs.create_dir(root, recursive=True)
                writer = ShardWriter(fs, f"{root}/{name}")
            for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))):
                writer.add(doc_id, np.concatenate((ids, end)))
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.record_batch(
                [[TaskContext.get().partitionId()], [name], [n_docs], [n_ids]],
                ["shard", "file", "n_docs", "n_ids"],
            )

    kinds = "shard long, file string, n_docs long, n_ids long"
    return saved(ordered.mapInArrow(run, kinds), f"{folder}/manifest")


def read_runs(
    spark: SparkSession,
    folder: str,
    manifest: DataFrame,
    columns: Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]],
    kinds: str,
) -> DataFrame:
    """(doc_id, start, n_tokens) and what ``columns`` makes of a run's (counts, ids).

    A task reads a file. The manifest has a row per file, not per document, so one
    task can add up where each file's ids start.
    """
    before = F.coalesce(
        F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    placed = manifest.select("file", before.alias("first"))
    files = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(files)
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns)):
                for docs, counts, ids in read_shard(fs, f"{root}/{name}"):
                    ends = np.cumsum(counts)
                    more = columns(counts, ids)
                    yield pa.record_batch(
                        [
                            pa.array(docs, pa.int64()),
                            pa.array(at + ends - counts),
                            pa.array(counts),
                            *more.values(),
                        ],
                        ["doc_id", "start", "n_tokens", *more],
                    )
                    at += int(ends[-1])

    dealt = placed.repartition(max(1, manifest.count()))
    return dealt.mapInArrow(run, f"doc_id long, start long, n_tokens long, {kinds}")


def _lists(counts: np.ndarray, ids: np.ndarray) -> dict[str, pa.Array]:
    borders = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return {"ids": pa.ListArray.from_arrays(pa.array(borders), pa.array(ids.astype(np.int64)))}


def _checksums(counts: np.ndarray, ids: np.ndarray) -> dict[str, pa.Array]:
    raw, ends = memoryview(ids.astype("<u4").tobytes()), 4 * np.cumsum(counts)
    crcs = [zlib.crc32(raw[e - 4 * n : e]) for e, n in zip(ends.tolist(), counts.tolist())]
    return {"ids_crc32": pa.array(crcs, pa.int64())}


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents."""
    return read_runs(spark, folder, manifest, _lists, "ids array<long>")


def read_checksums(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), with the crc32 of the ids as little-endian uint32."""
    return read_runs(spark, folder, manifest, _checksums, "ids_crc32 long")
