"""Personal data: rules, and a character BiLSTM with a CRF that adds spans to theirs.

Rules give base spans of four kinds. A network of two character LSTMs, one per
direction, scores tags (outside, and begin/inside of each kind), and a CRF's
transitions turn the scores into paths. It is trained in numpy on the driver from
the rule-labelled windows of a bounded sample (``TRAIN_DOCS`` documents,
``TRAIN_WINDOWS`` windows). Windows with blanks put around the at sign, a spelling
that the rules miss, are added; up to ``TRAIN_SPACED`` places are theirs before
others, so their number does not fall as the input grows. Within both kinds a hash
of text and window decides, so all parts of a text are drawn alike.

Decoding is one map over all texts. Windows of ``WIDTH`` characters lie every
``WIDTH // 2``, so that a span of half a window is whole in some window. A span
must hold a digit or an at sign; windows without one can hold no span and are
left out. Candidates that a border inside the text cuts are joined over neighbouring
windows into whole spans, as long as each of these holds a digit or an at sign. Over
the whole text, the candidates of all windows are then reconciled: equal ones are united with their best score, the set of
disjoint ones with the largest total is taken, and what overlaps a base span goes.
Base spans always stay. An added span needs every tag's marginal probability
to reach ``LEAST`` and the kind's own check (Luhn, parts up to 255, digits).

Defined cases: a null or empty text has no spans; a text of any length is decoded
in batches of windows; repeated rows each get their spans; ties of score go to the
span that ends first; without any labelled window there is no network and the base
spans are all; extra columns are not read. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import release, slices, strings

KINDS = ("email", "ip", "card", "phone")
# The base rules.
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile("[0-9@]")

WIDTH = 96
STEP = WIDTH // 2
HIDDEN = 16
EMBED = 12
TAGS = 1 + 2 * len(KINDS)
TRAIN_DOCS = 1000
TRAIN_WINDOWS = 1500
TRAIN_SPACED = 500
EPOCHS = 25
BATCH = 64
RATE = 0.02
LEAST = 0.9
DECODE_BATCH = 1024
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def valid(kind: str, s: str) -> bool:
    """The check of a kind on a span's text."""
    if kind == "email":
        return "@" in s and "." in s.partition("@")[2]
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(re.fullmatch("[0-9]+", p) and int(p[-19:]) <= 255 and
                                       not p[:-19].strip("0") for p in parts)
    d = _digits(s)
    return 16 <= len(d) <= 19 and luhn(d) if kind == "card" else 8 <= len(d) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The e-mail rule's matches, found from each at sign outwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            last = host.end()
            yield start, last
        else:
            last = max(last, at + 1)
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """Spans of the rules, by kind and start."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for kind, rule in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        spans += [
            (kind, m.start(), m.end()) for m in rule.finditer(text) if valid(kind, m[0])
        ]
    return spans


# -- windows ------------------------------------------------------------------


def codes(text: str) -> np.ndarray:
    """Character classes: ASCII as it is, other letters, digits and the rest; 0 pads."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(points < 128, points, 128).astype(np.int64)
    for i in np.flatnonzero(points >= 128):
        c = text[i]
        out[i] = 129 if c.isalpha() else 130 if c.isspace() else 128
    out[out == 0] = 128
    return out


CLASSES = 131


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign."""
    found: dict[int, None] = {}
    final = max(0, -(-(len(text) - WIDTH) // STEP))
    for m in _TRIGGER.finditer(text):
        k = m.start() // STEP
        for w in (k - 1, k):
            if 0 <= w <= final:
                found[w] = None
    return [w * STEP for w in found]


def cut(text: str, starts: list[int]) -> np.ndarray:
    """Windows as rows of classes, padded with 0."""
    out = np.zeros((len(starts), WIDTH), np.int64)
    for row, s in zip(out, starts, strict=True):
        part = codes(text[s : s + WIDTH])
        row[: len(part)] = part
    return out


def tags_of(spans: list[Span], start: int) -> np.ndarray:
    """Tags of a window; the part of a span that lies in it counts."""
    out = np.zeros(WIDTH, np.int64)
    for kind, a, b in spans:
        if a < start + WIDTH and b > start:
            tag = 1 + 2 * KINDS.index(kind)
            lo, hi = max(a - start, 0), min(b - start, WIDTH)
            out[lo:hi] = tag + 1
            if a >= start:
                out[lo] = tag
    return out


# -- network ------------------------------------------------------------------


def _forbidden() -> np.ndarray:
    """Transitions into the inside of a kind that is not open."""
    bad = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        bad[:, inside] = -1e4
        bad[[inside - 1, inside], inside] = 0
    return bad


_FORBIDDEN = _forbidden()
Params = dict[str, np.ndarray]


def init(seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"emb": draw(CLASSES, EMBED), "out": draw(2 * HIDDEN, TAGS), "trans": draw(TAGS, TAGS) * 0}
    for d in "fb":
        p |= {f"x{d}": draw(EMBED, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN)}
        bias = np.zeros(4 * HIDDEN, np.float32)
        bias[HIDDEN : 2 * HIDDEN] = 1
        p[f"b{d}"] = bias
    p["bias"] = np.zeros(TAGS, np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(table: np.ndarray, wh: np.ndarray, ids: np.ndarray, keep: bool):
    """Hidden states (T, B, H) over time-major classes; with ``keep`` also what training needs."""
    t, b = ids.shape
    hs = np.empty((t, b, HIDDEN), np.float32)
    h = c = np.zeros((b, HIDDEN), np.float32)
    kept = []
    for i in range(t):
        z = table[ids[i]] + h @ wh
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = c
        c = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * g
        tc = np.tanh(c)
        if keep:
            kept.append((h, gates, g, before, tc))
        h = gates[:, 2 * HIDDEN :] * tc
        hs[i] = h
    return hs, kept


def emissions(p: Params, ids: np.ndarray, keep: bool = False):
    """Tag scores (T, B, TAGS) of time-major windows."""
    sides = []
    for d, turned in (("f", ids), ("b", ids[::-1])):
        hs, kept = _lstm(p["emb"] @ p[f"x{d}"] + p[f"b{d}"], p[f"h{d}"], turned, keep)
        sides.append((hs, kept))
    both = np.concatenate((sides[0][0], sides[1][0][::-1]), axis=2)
    return both @ p["out"] + p["bias"], both, sides


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def marginals(e: np.ndarray, trans: np.ndarray):
    """Forward and backward log sums, and the log of the total, of a CRF."""
    t = len(e)
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0]
    for i in range(1, t):
        a[i] = _lse(a[i - 1][:, :, None] + trans, 1) + e[i]
    for i in range(t - 2, -1, -1):
        b[i] = _lse((b[i + 1] + e[i + 1])[:, None, :] + trans, 2)
    return a, b, _lse(a[-1], 1)


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    t, n, _ = e.shape
    back = np.empty(e.shape, np.int8)
    best = e[0]
    for i in range(1, t):
        step = best[:, :, None] + trans
        back[i] = step.argmax(1)
        best = step.max(1) + e[i]
    path = np.empty((t, n), np.int64)
    path[-1] = best.argmax(1)
    rows = np.arange(n)
    for i in range(t - 1, 0, -1):
        path[i - 1] = back[i, rows, path[i]]
    return path


def gradients(p: Params, ids: np.ndarray, tags: np.ndarray) -> tuple[float, Params]:
    """Mean negative log likelihood of the tag paths and its gradient."""
    t, n = ids.shape
    trans = p["trans"] + _FORBIDDEN
    e, both, sides = emissions(p, ids, keep=True)
    a, b, total = marginals(e, trans)
    rows = np.arange(n)
    gold = sum(e[i, rows, tags[i]] for i in range(t)) + trans[tags[:-1], tags[1:]].sum(0)
    de = np.exp(a + b - total[:, None])
    dtrans = np.zeros_like(trans)
    for i in range(1, t):
        pair = a[i - 1][:, :, None] + trans + (e[i] + b[i])[:, None, :] - total[:, None, None]
        dtrans += np.exp(pair).sum(0)
    np.subtract.at(dtrans, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    de[np.arange(t)[:, None], rows, tags] -= 1
    de /= n
    grad = {
        "trans": np.where(_FORBIDDEN < 0, 0, dtrans / n).astype(np.float32),
        "out": both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS),
        "bias": de.sum((0, 1)),
        "emb": np.zeros_like(p["emb"]),
    }
    dboth = de @ p["out"].T
    for k, d in enumerate("fb"):
        dh_all = dboth[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        turned = ids if d == "f" else ids[::-1]
        dh_all = dh_all if d == "f" else dh_all[::-1]
        wh, kept = p[f"h{d}"], sides[k][1]
        dwh, dtable = np.zeros_like(wh), np.zeros((CLASSES, 4 * HIDDEN), np.float32)
        dh_next = dc = np.zeros((n, HIDDEN), np.float32)
        for i in range(t - 1, -1, -1):
            h, gates, g, before, tc = kept[i]
            gi, gf, go = (gates[:, j * HIDDEN : (j + 1) * HIDDEN] for j in range(3))
            dh = dh_all[i] + dh_next
            dc = dc + dh * go * (1 - tc * tc)
            dz = np.concatenate(
                (
                    dc * g * gi * (1 - gi),
                    dc * before * gf * (1 - gf),
                    dh * tc * go * (1 - go),
                    dc * gi * (1 - g * g),
                ),
                axis=1,
            )
            dc = dc * gf
            dwh += h.T @ dz
            np.add.at(dtable, turned[i], dz)
            dh_next = dz @ wh.T
        grad[f"h{d}"] = dwh
        grad[f"x{d}"] = p["emb"].T @ dtable
        grad[f"b{d}"] = dtable.sum(0)
        grad["emb"] += dtable @ p[f"x{d}"].T
    return float((total - gold).mean()), grad


def train(windows: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Params:
    """Adam over shuffled batches of labelled windows."""
    rng, p = np.random.default_rng(seed), init(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    step, rounds = 0, epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            _, grad = gradients(p, windows[rows].T, tags[rows].T)
            step += 1
            rate = RATE * (1 - step / (rounds + 1))
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                hat = (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
                p[k] = p[k] - np.float32(rate) * hat.astype(np.float32)
    return p


# -- decoding -----------------------------------------------------------------


def stretches(row: np.ndarray) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, begun) of a path's spans; one that the window's begin cuts is not begun."""
    begins = np.flatnonzero(row % 2 == 1).tolist()
    if row[0] and row[0] % 2 == 0:
        begins.insert(0, 0)
    for s in begins:
        begun = bool(row[s] % 2)
        inside, end = row[s] + begun, s + 1
        while end < len(row) and row[end] == inside:
            end += 1
        yield KINDS[inside // 2 - 1], s, end, begun


def candidates(
    p: Params, windows: np.ndarray
) -> Iterator[tuple[int, str, int, int, bool, float]]:
    """(window, kind, start, end, begun, score) of the spans on each window's best path."""
    trans = p["trans"] + _FORBIDDEN
    for at in range(0, len(windows), DECODE_BATCH):
        ids = windows[at : at + DECODE_BATCH].T
        e, _, _ = emissions(p, ids)
        path = viterbi(e, trans).T
        hit = np.flatnonzero((path > 0).any(1))
        if not len(hit):
            continue
        a, b, total = marginals(e[:, hit], trans)
        sure = np.exp(a + b - total[:, None])
        for j, w in enumerate(hit):
            row = path[w]
            for kind, s, end, begun in stretches(row):
                own = sure[np.arange(s, end), j, row[s:end]]
                yield at + int(w), kind, s, end, begun, float(own.min())


def joined(cut: list[tuple[int, int, str, float, bool, bool]]) -> dict[Span, float]:
    """Whole spans from the parts that borders of windows cut off, with their least score.

    A part is (start, end, kind, score, cut on the left, cut on the right). Parts of one
    kind that overlap and are cut where they meet are one span, over any number of windows;
    one that never ends, or never begins, is none.
    """
    out: dict[Span, float] = {}
    running: dict[str, tuple[int, int, float]] = {}
    for a, b, kind, score, left, right in sorted(cut):
        if left:
            before = running.pop(kind, None)
            if before is None or a >= before[1]:
                continue
            a, b, score = before[0], max(b, before[1]), min(score, before[2])
        if right:
            running[kind] = (a, b, score)
        else:
            out[kind, a, b] = max(score, out.get((kind, a, b), 0.0))
    return out


def reconcile(found: dict[Span, float], base: list[Span]) -> list[tuple[str, int, int, float]]:
    """Disjoint spans of the largest total score that touch no base span."""
    taken = sorted((a, b) for _, a, b in base)
    begins = [a for a, _ in taken]
    reach = [0, *itertools.accumulate((b for _, b in taken), max)]
    # Of the base spans that begin before the end, the one that ends last must end in time.
    free = sorted(
        (b, a, kind, score)
        for (kind, a, b), score in found.items()
        if reach[bisect.bisect_left(begins, b)] <= a
    )
    ends = [x[0] for x in free]
    best = [0.0] * (len(free) + 1)
    for i, (_, a, _, score) in enumerate(free):
        before = bisect.bisect_right(ends, a)
        best[i + 1] = max(best[i], best[min(before, i)] + score)
    out, i = [], len(free)
    while i:
        if best[i] == best[i - 1]:
            i -= 1
            continue
        b, a, kind, score = free[i - 1]
        out.append((kind, a, b, score))
        i = min(bisect.bisect_right(ends, a), i - 1)
    return out[::-1]


def spans_of(texts: list[str], p: Params | None) -> list[list[tuple[str, int, int, float, bool]]]:
    """(kind, start, end, score, base) of each text, by kind and start."""
    bases = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
    found: list[dict[Span, float]] = [{} for _ in texts]
    borders: dict[int, list[tuple[int, int, str, float, bool, bool]]] = {}
    held: list[tuple[int, int]] = []
    parts: list[np.ndarray] = []

    def put(doc: int, span: Span, score: float) -> None:
        piece = texts[doc][span[1] : span[2]]
        if _TRIGGER.search(piece) and valid(span[0], piece):
            found[doc][span] = max(score, found[doc].get(span, 0.0))

    def decode() -> None:
        for w, kind, s, e, begun, score in candidates(p, np.concatenate(parts)):
            doc, start = held[w]
            text = texts[doc]
            cut_left = s == 0 and start > 0
            cut_right = e == WIDTH and start + e < len(text)
            if score < LEAST or start + e > len(text) or not (begun or cut_left):
                continue
            if cut_left or cut_right:
                part = (start + s, start + e, kind, score, cut_left, cut_right)
                borders.setdefault(doc, []).append(part)
            else:
                put(doc, (kind, start + s, start + e), score)
        held.clear()
        parts.clear()

    if p is not None:
        for doc, text in enumerate(texts):
            starts = window_starts(text)
            for at in range(0, len(starts), DECODE_BATCH):
                some = starts[at : at + DECODE_BATCH]
                parts.append(cut(text, some))
                held += [(doc, s) for s in some]
                if len(held) >= DECODE_BATCH:
                    decode()
        if held:
            decode()
    for doc, cuts in borders.items():
        for span, score in joined(cuts).items():
            put(doc, span, score)
    out = []
    for base, extra in zip(bases, found, strict=True):
        spans = [(*s, 1.0, True) for s in base]
        spans += [(*s, False) for s in (reconcile(extra, base) if extra else [])]
        out.append(sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))
    return out


# -- Spark --------------------------------------------------------------------


def labelled_windows(
    text: str, rng: np.random.Generator
) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Windows of a text with the rules' tags, and whether one has a spaced at sign."""
    spans = base_spans(text)
    for start in window_starts(text):
        yield cut(text, [start])[0], tags_of(spans, start), False
    for kind, a, b in spans:
        if kind == "email" and rng.random() < 0.5:
            left, _, right = text[a:b].partition("@")
            spaced = f"{left} @ {right}"
            start = max(0, a - int(rng.integers(8, 40)))
            changed = text[start:a] + spaced + text[b : b + WIDTH]
            span = [("email", a - start, a - start + len(spaced))]
            near = [(k, x - start, y - start) for k, x, y in spans if y <= a]
            near += [(k, x - start + 2, y - start + 2) for k, x, y in spans if x >= b]
            yield cut(changed[:WIDTH], [0])[0], tags_of(span + near, 0), True


def learn(docs: DataFrame) -> Params | None:
    """Train on the bounded sample of documents with a digit or an at sign."""
    marked = docs.where(F.col("text").rlike("[0-9@]")).select(
        F.xxhash64("text").alias("at"), "text"
    )
    chosen = marked.select("at").distinct().orderBy("at").limit(TRAIN_DOCS)
    last = chosen.agg(F.max("at")).first()[0]
    if last is None:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for at, text in zip(part.column(0).to_pylist(), strings(part), strict=True):
                rng = np.random.default_rng(abs(at))
                for k, (w, t, spaced) in enumerate(labelled_windows(text, rng)):
                    w, t = (x.astype(np.uint8).tobytes() for x in (w, t))
                    rows.append((at, k, w, t, spaced))
            if rows:
                names = ["at", "k", "w", "t", "spaced"]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])

    # Documents of equal text are one example.
    sample = marked.where(F.col("at") <= last).dropDuplicates(["at"])
    windows = sample.mapInArrow(run, "at long, k long, w binary, t binary, spaced boolean")

    def drawn(of: DataFrame) -> DataFrame:
        return of.orderBy(F.xxhash64("at", "k"), "at", "k").limit(TRAIN_WINDOWS)

    found = drawn(windows.where("spaced")).union(drawn(windows.where("not spaced"))).collect()
    spaced, others = ([r for r in found if r["spaced"] == x] for x in (True, False))
    places = max(TRAIN_SPACED, TRAIN_WINDOWS - len(others))
    rows = spaced[:places]
    rows += others[: TRAIN_WINDOWS - len(rows)]
    if not any(any(r["t"]) for r in rows):
        return None
    params = train(
        np.array([list(r["w"]) for r in rows], np.int64),
        np.array([list(r["t"]) for r in rows], np.int64),
    )
    release()
    return params


SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
_SPAN = pa.list_(
    pa.struct(
        [
            ("kind", pa.string()),
            ("start", pa.int32()),
            ("end", pa.int32()),
            ("score", pa.float64()),
            ("base", pa.bool_()),
        ]
    )
)


def find_spans(docs: DataFrame, params: Params | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``spans``, base and added, by kind and start; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(params)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    names = ["kind", "start", "end", "score", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            found = spans_of(strings(part, "_text"), shared.value)
            listed = [[dict(zip(names, s, strict=True)) for s in spans] for spans in found]
            yield pa.record_batch(
                [*part.columns[:-1], pa.array(listed, _SPAN)], [*keep, "spans"]
            )

    return rows.mapInArrow(run, f"{kinds}, spans {SPAN_TYPE}")
