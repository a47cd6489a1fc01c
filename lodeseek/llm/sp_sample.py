"""SentencePiece encoding by sampling without replacement, and decoding.

A text's segmentations into pieces form a lattice, whose paths have probabilities in
proportion to the product of their pieces' weights. The k segmentations with the
largest perturbed log probabilities (each plus a Gumbel variable of its own) are a
sample without replacement. They are found by A* search from above: a node is the set
of all paths that share a beginning, its priority is the largest perturbed value
within it. That maximum is itself a Gumbel variable at the log of the set's mass, so
the root draws it, a path descends by piece probabilities and inherits it, and the
rest of each set that the path left gets a maximum of its own, truncated at its
parent's. The next best node holds the next sample: its beginning, another piece, and
a freely drawn rest. Every sample is distinct. With the next value after the k-th as
threshold, a sample's inclusion score is 1 - exp(-exp(log_prob - threshold)).

No piece crosses from a word into the next blank, so the lattice is that of the words
one after another. A task builds it once per distinct word, with arrays over all
words: pieces by a trie, masses from the words' ends, and draws for all words at once.

Weights: of a unigram model its log probabilities; a byte-pair model has none, and
its pieces get the log of Zipf's law at their rank. Characters without a piece fall
back to bytes, or to the unknown piece where the model has no bytes.

Random numbers are hashes of (row key, sample, place), so a row's samples depend
neither on its neighbours nor on tries or partitions.

Defined cases: a null text is the empty text, whose only sample has no pieces,
log_prob 0 and score 1; a text with fewer than k segmentations gives all it has; rows
that repeat a key and text repeat its samples; a text of any length is taken whole;
an empty table gives no row; only the columns ``keep`` are passed on.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from lodeseek.llm.common import mix64, slices
from lodeseek.llm.runs import gather

SAMPLES = 2
# Bytes of text that have a lattice at a time: arrays of some 200 bytes for each.
SLICE = 150_000
BLANK = "▁"
_END = 0x1FFFFF
_MARKS = ("\x00", "\x01", "\x02", "￿")
_U = np.uint64
_STEP, _WORD, _SAMPLE, _NODE = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03), _U(0xABC98388FB8FAC03), _U(0x8CB92BA72F3D8DD7)


class Vocabulary:
    """A model's pieces as a trie of arrays, their log weights, and their bytes."""

    def __init__(self, path: str):
        self.processor = SentencePieceProcessor(model_file=path)
        sp = self.processor
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        scores = np.array([sp.get_score(i) for i in range(size)])
        byte = {}
        for i in range(size):
            if sp.is_byte(i):
                byte[int(pieces[i][1:-1], 16)] = i
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        plain = [i for i in range(size) if i not in special and i not in set(byte.values())]
        probable = len(plain) > 0 and (np.exp(scores[plain]).sum() < 1.5) and scores[plain].max() < 0
        ranked = sorted(plain, key=lambda i: (-scores[i], i))
        weights = np.full(size, -np.inf)
        if probable and not _is_ranks(scores[plain]):
            weights[plain] = scores[plain]
        else:
            weights[ranked] = -np.log(np.arange(len(ranked)) + 2.0)
        self.weights = weights
        self.fallback = float(weights[plain].min()) - 10
        self.byte, self.unknown = byte, sp.unk_id()
        self.surface = np.array(
            [
                b"" if sp.is_control(i)
                else bytes([int(pieces[i][1:-1], 16)]) if sp.is_byte(i)
                else " ⁇ ".encode() if sp.is_unknown(i)
                else pieces[i].replace(BLANK, " ").encode()
                for i in range(size)
            ],
            object,
        )
        nodes: dict[tuple[int, int], int] = {}
        final = [-1]
        for i in plain:
            state = 0
            for c in map(ord, pieces[i]):
                at = (state, c)
                if at not in nodes:
                    nodes[at] = len(final)
                    final.append(-1)
                state = nodes[at]
            final[state] = i
        self._hash(np.array([(s << 21) | c for s, c in nodes], np.int64), list(nodes.values()))
        self.final = np.array(final, np.int32)

    def _hash(self, keys: np.ndarray, values: list[int]) -> None:
        """An open hash table of the trie's transitions, an eighth full at most."""
        self.shift = _U(64 - max(4, int(8 * len(keys)).bit_length()))
        self.slots = np.full((1 << int(_U(64) - self.shift)), -1, np.int64)
        self.next = np.zeros(len(self.slots), np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[todo[free]]  # of equal slots the last one stays
            done = self.slots[at] == keys[todo]
            self.next[at[done]] = np.array(values, np.int32)[todo[done]]
            todo, at = todo[~done], (at[~done] + 1) % len(self.slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * _STEP) >> self.shift).astype(np.int64)

    def step(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which transitions (state and character) there are, and their slots."""
        at = self._slot(keys)
        own = self.slots[at]
        todo = np.flatnonzero((own != keys) & (own >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.slots)
            own[todo] = self.slots[at[todo]]
            todo = todo[(own[todo] != keys[todo]) & (own[todo] >= 0)]
        return own == keys, at

    def fall_back(self, c: str) -> list[int]:
        raw = c.encode("utf-8", "surrogatepass")
        return [self.byte[b] for b in raw] if all(b in self.byte for b in raw) else [self.unknown]


def _is_ranks(scores: np.ndarray) -> bool:
    """Whether scores are whole numbers, as the ranks of a byte-pair model are."""
    return bool((scores == np.round(scores)).all())


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@dataclass
class Lattice:
    """Edges by start; places are ordered by their distance from the word's end.

    ``begin``: place of each word's start; ``first``: first edge of each place (one
    more: the end); per edge: ``end`` place, probability ``p``, its logarithm and that of
    1 - p, the sums ``upto`` of p among the edges of the place, and where its ids stand in
    ``ids``.
    """

    begin: np.ndarray
    distance: np.ndarray
    first: np.ndarray
    end: np.ndarray
    p: np.ndarray
    log: np.ndarray
    log_rest: np.ndarray
    upto: np.ndarray
    ids: np.ndarray
    id_starts: np.ndarray
    id_of: np.ndarray


def _joined(words: pa.Array) -> str:
    """All words one after another, as they lie in the array."""
    if not len(words):
        return ""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int32)[[words.offset, words.offset + len(words)]]
    return data.slice(int(at[0]), int(at[1] - at[0])).to_pybytes().decode() if data else ""


def build(words: pa.Array, v: Vocabulary) -> Lattice:
    """The lattice of distinct words."""
    lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    total = int(ends[-1]) + 1 if len(ends) else 0
    points = np.full(total, _END, np.int64)
    inside = np.ones(total, bool)
    inside[ends] = False
    points[inside] = np.frombuffer(_joined(words).encode("utf-32-le"), np.uint32)
    distance = np.repeat(ends, lengths + 1) - np.arange(total)

    # Pieces from every place, longer and longer.
    place, state = np.flatnonzero(inside), np.zeros(int(inside.sum()), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    length = 0
    covered = np.zeros(total, bool)
    while len(place):
        key = (state << 21) | points[place + length]
        alive, at = v.step(key)
        place, state = place[alive], v.next[at[alive]].astype(np.int64)
        length += 1
        piece = v.final[state]
        whole = piece >= 0
        found.append((place[whole], piece[whole]))
        if length == 1:
            covered[place[whole]] = True
    missing = np.flatnonzero(inside & ~covered)
    extra, which = np.unique(points[missing], return_inverse=True)
    lists = [v.fall_back(chr(c)) for c in extra]
    size = len(v.weights)
    ids = np.concatenate((np.arange(size), np.array([i for x in lists for i in x], np.int64)))
    id_starts = np.concatenate(
        (np.arange(size + 1), size + np.cumsum([len(x) for x in lists], dtype=np.int64))
    )
    weights = np.append(v.weights, [v.fallback * len(x) for x in lists])

    # Edges in the order of their start's distance from the end, longest first.
    small = distance.astype(np.uint16) if total and distance.max() < 65536 else distance
    order = np.argsort(small, kind="stable")
    rank = np.empty(total, np.int64)
    rank[order] = np.arange(total)
    groups = [(missing, which + size, 1)]
    groups += [(p, i, n) for n, (p, i) in enumerate(found, start=1)]
    count = np.zeros(total, np.int64)
    for p, _, _ in groups:
        count[rank[p]] += 1
    first = np.concatenate(([0], np.cumsum(count)))
    fill = first[:-1].copy()
    edges = int(first[-1])
    end, id_of = np.empty(edges, np.int32), np.empty(edges, np.int32)
    for p, i, n in reversed(groups):
        at = rank[p]
        slot = fill[at]
        fill[at] += 1
        end[slot], id_of[slot] = rank[p + n], i
    weight = weights[id_of]

    # Log masses from the ends backwards.
    mass = np.zeros(total)
    prob = np.empty(edges)
    sorted_distance = distance[order]
    cut = np.flatnonzero(np.diff(sorted_distance)) + 1
    bounds = np.concatenate((cut, [total])) if total else np.zeros(1, np.int64)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        a, b = int(first[lo]), int(first[hi])
        x = weight[a:b] + mass[end[a:b]]
        own, n = first[lo:hi] - a, count[lo:hi]
        top = np.maximum.reduceat(x, own)
        summed = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, n)), own))
        mass[lo:hi] = summed
        prob[a:b] = np.exp(x - np.repeat(summed, n))
    # Sums place by place, so that they do not depend on the other words.
    upto, most = prob.copy(), int(count.max()) if total else 0
    for j in range(1, most):
        slot = first[:-1][count > j] + j
        upto[slot] += upto[slot - 1]
    upto[first[1:][count > 0] - 1] = np.inf
    log = np.log(np.maximum(prob, 1e-300))
    with np.errstate(divide="ignore"):
        log_rest = np.log1p(-np.minimum(prob, 1.0))
    return Lattice(
        rank[starts], sorted_distance, first, end, prob, log, log_rest, upto, ids, id_starts, id_of
    )


def _uniform(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((mix64(h) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _pick(lattice: Lattice, place: np.ndarray, u: np.ndarray) -> np.ndarray:
    """An edge of each place, by its probability."""
    edge = lattice.first[place]
    todo = np.flatnonzero(u > lattice.upto[edge])
    while len(todo):
        edge[todo] += 1
        todo = todo[u[todo] > lattice.upto[edge[todo]]]
    return edge


def walk(lattice: Lattice, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a free draw from each place to its word's end, and how many each took."""
    n = len(place)
    count = np.zeros(n, np.int64)
    live = np.flatnonzero(lattice.distance[place] > 0) if n else np.empty(0, np.int64)
    at, own = place[live], seed[live]
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        edge = _pick(lattice, at, _uniform(own))
        taken.append((live.astype(np.int32), edge.astype(np.int32)))
        count[live] += 1
        at = lattice.end[edge]
        more = lattice.distance[at] > 0
        live, at, own = live[more], at[more], own[more] + _STEP
    starts = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.int32)
    for step, (who, edge) in enumerate(taken):
        out[starts[who] + step] = edge
    return out, count


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


@dataclass
class Text:
    """The search of one text: paths found, and the open nodes along each."""

    words: np.ndarray
    seed: int
    paths: list
    logs: list
    values: list
    nodes: list  # per path: perturbed maxima of the sets that it left, by step
    left: dict  # (path, step) -> edges that are used up there
    branch: tuple | None = None


# No Gumbel variable that ``_uniform`` can give is larger.
_LARGEST = 37.5
_NEAR = 45.0


def _open(
    lattice: Lattice, text: Text, path: np.ndarray, since: int, bound: float, turn: int, k: int
) -> None:
    """Add a path and the nodes that it left from step ``since`` on, truncated at ``bound``.

    The sets left later and later have ever less mass. Once k nodes lie above what the
    mass still ahead can reach with the largest variable, the rest is never needed.
    """
    log, log_rest = lattice.log[path], lattice.log_rest[path]
    upto = np.cumsum(log)
    with np.errstate(over="ignore"):
        place = _U(text.seed) ^ (_U(turn + 1) * _NODE)

    def values(stop: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(since, stop)
        with np.errstate(divide="ignore", over="ignore"):
            mass = (upto - log)[own] + log_rest[own]
            h = place + np.arange(since, stop, dtype=np.uint64) * _STEP
        shifted = mass + _gumbel(_uniform(h))
        return shifted, np.where(np.isfinite(mass), -np.logaddexp(-bound, -shifted), -np.inf)

    stop = len(path)
    ahead = upto[since:] < (upto[since - 1] if since else 0.0) - _NEAR
    if ahead.any():
        stop = since + int(ahead.argmax()) + 1
    shifted, found = values(stop)
    if stop < len(path) and (shifted > upto[stop - 1] + _LARGEST).sum() < k:
        stop = len(path)
        shifted, found = values(stop)
    nodes = np.full(stop, -np.inf)
    nodes[since:] = found
    text.paths.append(path)
    text.logs.append(float(upto[-1]) if len(path) else 0.0)
    text.values.append(bound)
    text.nodes.append(nodes)


def _best(text: Text) -> tuple[float, int, int]:
    """Value, path and step of the best open node."""
    best = (-np.inf, -1, -1)
    for j, values in enumerate(text.nodes):
        if len(values):
            t = int(values.argmax())
            if values[t] > best[0]:
                best = (float(values[t]), j, t)
    return best


def _branch(lattice: Lattice, text: Text, turn: int) -> bool:
    """Take the best node: keep its beginning, draw another piece, leave the rest to ``walk``."""
    value, j, t = _best(text)
    if not np.isfinite(value):
        return False
    path = text.paths[j]
    used = text.left.setdefault((j, t), [int(path[t])])
    place = int(np.searchsorted(lattice.first, path[t], side="right")) - 1
    edges = np.arange(lattice.first[place], lattice.first[place + 1])
    free = edges[(edges[:, None] != used).all(1)]
    p = lattice.p[free]
    with np.errstate(over="ignore"):
        base = _U(text.seed) + _U(turn) * _SAMPLE
        u = _uniform(np.array([base, base ^ _NODE], np.uint64))
    new = int(free[min(int(np.searchsorted(np.cumsum(p), u[0] * p.sum())), len(free) - 1)])
    used.append(new)
    before = float(np.log(lattice.p[path[:t]]).sum())
    rest = p.sum() - lattice.p[new]
    if len(free) > 1 and rest > 0:
        shifted = before + np.log(rest) + _gumbel(u[1:])[0]
        text.nodes[j][t] = -np.logaddexp(-value, -shifted)
    else:
        text.nodes[j][t] = -np.inf
    text.branch = (value, path[:t], new, t)
    return True


def _finish(lattice: Lattice, texts: list[Text], turn: int, offsets: list, k: int) -> None:
    """Draw the rests of all branched texts at once, and open their nodes."""
    places, seeds = [], []
    for text, count in zip(texts, offsets, strict=True):
        # The word of the branch, from behind the new piece, then all later words.
        _, prefix, new, _ = text.branch
        ends = np.cumsum(lattice.distance[lattice.end[np.append(prefix, new)]] == 0)
        word = int(ends[-1] - (lattice.distance[lattice.end[new]] == 0))
        own = np.concatenate(([lattice.end[new]], text.words[word + 1 :]))
        places.append(own)
        seeds.append(_word_seeds(text.seed, turn, np.arange(word, len(text.words))))
        count.append(len(own))
    edges, taken = walk(lattice, np.concatenate(places), np.concatenate(seeds))
    sums = np.concatenate(([0], np.cumsum(taken)))
    at = 0
    for text, count in zip(texts, offsets, strict=True):
        value, prefix, new, t = text.branch
        n = count.pop()
        path = np.concatenate((prefix, np.array([new], np.int32), edges[sums[at] : sums[at + n]]))
        at += n
        _open(lattice, text, path, t + 1, value, turn, k)


def _word_seeds(seed: int, turn: int, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(_U(seed) + _U(turn) * _SAMPLE + words.astype(np.uint64) * _WORD)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of normalised texts: borders per text, word numbers, distinct words."""
    joined = "".join(texts.to_pylist())
    mark = next((m for m in _MARKS if m not in joined), None)
    if mark is None:
        parts = [re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", t) for t in texts.to_pylist()]
        borders = np.cumsum([0, *map(len, parts)])
        coded = pa.array([w for p in parts for w in p], pa.string()).dictionary_encode()
    else:
        if BLANK + BLANK in joined:
            marked = pc.replace_substring_regex(texts, f"{BLANK}+", f"{mark}\\0")
        else:
            marked = pc.replace_substring(texts, BLANK, mark + BLANK)
        split = pc.split_pattern(marked, mark)
        flat = split.flatten()
        filled = pc.binary_length(flat).to_numpy() > 0
        borders = split.offsets.to_numpy() - split.offsets[0].as_py()
        borders = np.concatenate(([0], np.cumsum(filled)))[borders]
        coded = flat.filter(pa.array(filled)).dictionary_encode()
    return borders, coded.indices.to_numpy().astype(np.int64), coded.dictionary


def sample_texts(
    texts: list[str], keys: np.ndarray, v: Vocabulary, k: int, seed: int
) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples (ids, log_prob, perturbed, inclusion), best first."""
    normal = pa.array(v.processor.normalize(texts) if texts else [], pa.string())
    borders, words, distinct = split_words(normal)
    lattice = build(distinct, v)
    begin = lattice.begin[words] if len(words) else np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        own = mix64(keys.astype(np.uint64) + _U(seed) * _STEP)
        count = np.diff(borders)
        number = np.arange(len(words)) - np.repeat(borders[:-1], count)
        seeds = mix64(np.repeat(own, count) + number.astype(np.uint64) * _WORD)
    edges, taken = walk(lattice, begin, seeds)
    sums = np.concatenate(([0], np.cumsum(taken)))
    cuts = sums[borders]
    roots = _gumbel(_uniform(own ^ _NODE))
    searches = []
    for i in range(len(texts)):
        text = Text(begin[borders[i] : borders[i + 1]], int(own[i]), [], [], [], [], {})
        _open(lattice, text, edges[cuts[i] : cuts[i + 1]], 0, float(roots[i]), 0, k)
        searches.append(text)
    for turn in range(1, k):
        going = [t for t in searches if len(t.paths) == turn and _branch(lattice, t, turn)]
        if not going:
            break
        _finish(lattice, going, turn, [[] for _ in going], k)
    paths = [path for text in searches for path in text.paths]
    edges = np.concatenate(paths) if paths else np.empty(0, np.int64)
    ids, starts = gather(lattice.ids, lattice.id_starts, lattice.id_of[edges])
    stops = starts[np.cumsum([len(path) for path in paths], dtype=np.int64)].tolist()
    out, at, j = [], 0, 0
    for text in searches:
        threshold = _best(text)[0]
        rows = []
        for log, value in zip(text.logs, text.values, strict=True):
            score = float(-np.expm1(-np.exp(log - threshold))) if np.isfinite(threshold) else 1.0
            rows.append((ids[at : stops[j]], log, value, score))
            at, j = stops[j], j + 1
        out.append(rows)
    return out


def decode_ids(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of a sequence of ids, without the blank that encoding puts first."""
    text = b"".join(v.surface[ids].tolist()).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def sample(
    docs: DataFrame,
    model: str,
    keep: list[str],
    key: str = "doc_id",
    k: int = SAMPLES,
    seed: int = 1,
    verify: bool = False,
) -> DataFrame:
    """``keep`` and (sample, ids, log_prob, perturbed, inclusion): up to k rows per row of ``docs``.

    With ``verify`` also ``round_trip``: whether the ids decode to the text.
    """
    rows = docs.select(*keep, F.xxhash64(key).alias("_key"), F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for part in slices(batches, "_text", SLICE):
            texts = [x or "" for x in part.column(len(keep) + 1).to_pylist()]
            keys = part.column(len(keep)).to_numpy().view(np.uint64)
            found = sample_texts(texts, keys, v, k, seed)
            which = pa.array([i for i, rows in enumerate(found) for _ in rows])
            flat = [row for rows in found for row in rows]
            ends = np.cumsum([0, *(len(r[0]) for r in flat)]).astype(np.int32)
            ids = np.concatenate([r[0] for r in flat]).astype(np.int32)
            order = pa.array([j + 1 for rows in found for j in range(len(rows))], pa.int32())
            columns = [
                *(c.take(which) for c in part.columns[: len(keep)]),
                order,
                pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)),
                *(pa.array([r[j] for r in flat], pa.float64()) for j in (1, 2, 3)),
            ]
            if verify:
                same = [
                    decode_ids(r[0], v) == text
                    for text, rows in zip(texts, found, strict=True)
                    for r in rows
                ]
                columns.append(pa.array(same, pa.bool_()))
            yield pa.record_batch(columns, names)

    names = [*keep, "sample", "ids", "log_prob", "perturbed", "inclusion"]
    more = "sample int, ids array<int>, log_prob double, perturbed double, inclusion double"
    if verify:
        names, more = [*names, "round_trip"], f"{more}, round_trip boolean"
    return rows.mapInArrow(run, f"{kinds}, {more}")


def decode(rows: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """``keep`` and the text of ``ids``; null ids give a null text."""
    rows = rows.select(*keep, F.col("ids").alias("_ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [
                    decode_ids(x.values.to_numpy(), v) if x.is_valid else None
                    for x in part.column(len(keep))
                ]
                yield pa.record_batch(
                    [*part.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, "text"]
                )

    return rows.mapInArrow(run, f"{kinds}, text string")
