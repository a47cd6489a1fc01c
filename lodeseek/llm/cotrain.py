"""Quality by co-training: two views of a page teach each other, then judge together.

The *text* view sees frequencies of character-class n-grams (letters by case, digits,
white space; other signs as they are) and a few measures of lines and words. The
*metadata* view sees source, language and length as the table gives them. Each view
has a logistic classifier. In each round, both views score all documents without a
label, and each hands those that it is surest of, good and bad in the share of the
labels and ``PER_ROUND`` in all, to the other view's training set. A held-out fifth of
the labels then calibrates each view (Platt's scaling), and the calibrated log odds are
added, with the prior counted once, as the views' independence asks.

Training is on the driver, from ``LABELLED`` labelled documents, the smallest by hash,
and from what the rounds hand over. A round is a map over all documents; what is sure
in it is shuffled as numbers only, and tasks rank their own before one task ranks
theirs. Documents of equal content count once there, so that copies cannot fill a
round. Scoring is one map over all documents with the weights broadcast, some kilobytes.

Defined cases: a null text is the empty text; null source, language or length are
values of their own; labels that are null or name no document teach nothing, and a
document with contradicting labels takes the majority, in a tie none; without labels
of both kinds every score is 1 and every document is kept; repeated rows are judged
each; of rows that share a labelled id, that with the smallest hash of its content
teaches; ids may be null, such rows are judged but teach nothing. Extra columns are passed on by ``accepted`` and not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import release, slices, strings
from lodeseek.llm.lang_id import buckets

BITS = 10
SIZES = (1, 2, 3)
LABELLED = 4000
ROUNDS = 4
PER_ROUND = 200
SURE = 0.9
LEAST = 0.5
_DOCS = 256
_META_BITS = 9
_MEASURES = 8


@dataclass
class View:
    """A linear classifier on scaled features, and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale) @ self.weights + self.bias

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log odds of a good document."""
        return self.slope * self.raw(x) + self.shift


@dataclass
class Model:
    text: View
    meta: View
    prior: float


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


# -- views --------------------------------------------------------------------


def _classes() -> np.ndarray:
    """Classes of the first 128 characters, and of all others by kind."""
    out = np.arange(132, dtype=np.uint32)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


_CLASS = _classes()


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    borders = np.cumsum([0, *map(len, texts)])
    high = raw >= 128
    out = _CLASS[np.where(high, 128, raw)]
    if high.any():
        values, which = np.unique(raw[high], return_inverse=True)
        kinds = [
            ord("A") if c.isupper() else ord("a") if c.isalpha() else 32 if c.isspace() else 128
            for c in map(chr, values)
        ]
        out[high] = np.array(kinds, np.uint32)[which]
    return out, borders


def text_features(texts: list[str]) -> np.ndarray:
    """A row per text: square roots of n-gram frequencies, then measures of lines and words."""
    width = (1 << BITS) + 1
    points, borders = _points(texts)
    n = len(texts)
    owner = np.repeat(np.arange(n), np.diff(borders))
    counts = np.zeros(n * width)
    for size in SIZES:
        h = buckets(points, borders, size, BITS)
        counts += np.bincount(owner * width + h, minlength=n * width)
    grams = counts.reshape(n, width)[:, :-1]
    length = np.maximum(np.diff(borders), 1)
    grams = np.sqrt(grams / length[:, None])
    measures = np.zeros((n, _MEASURES))
    for j, c in enumerate((10, 32, ord("A"), ord("0"))):
        measures[:, j] = np.bincount(owner[points == c], minlength=n) / length
    measures[:, 4] = np.log1p(np.diff(borders))
    for i, t in enumerate(texts):
        words, lines = t.split(), t.split("\n")
        measures[i, 5] = len(set(words)) / max(1, len(words))
        measures[i, 6] = len(set(lines)) / len(lines)
        measures[i, 7] = len(t) / (1 + len(words))
    return np.concatenate((grams, measures), axis=1).astype(np.float32)


def meta_features(part: pa.RecordBatch) -> np.ndarray:
    """A row per document: hashed source and language, and steps of the length."""
    size = 1 << _META_BITS
    out = np.zeros((part.num_rows, size + 34), np.float32)
    for j, name in enumerate(("_source", "_lang")):
        column = part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        out[np.arange(len(out)), column % (size // 2) + j * (size // 2)] = 1
    chars = part.column(part.schema.get_field_index("_chars"))
    known = chars.is_valid().to_numpy(zero_copy_only=False)
    steps = np.log2(1 + np.maximum(chars.fill_null(0).to_numpy(zero_copy_only=False), 0))
    out[np.arange(len(out)), size + np.minimum(steps.astype(np.int64), 32)] = known
    out[:, size + 33] = ~known
    return out


_VIEWED = ["_text", "_source", "_lang", "_chars"]


def _read() -> list[Column]:
    """What both views read of a document."""
    named = (F.xxhash64(F.coalesce(F.col(c), F.lit("\x00"))) for c in ("source", "lang"))
    return [
        F.col("text"),
        *(h.bitwiseAND(0x7FFFFFFF) for h in named),
        F.col("n_chars").cast("double"),
    ]


def viewed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and what both views read, under names of its own."""
    return docs.select(*keep, *(c.alias(n) for c, n in zip(_read(), _VIEWED, strict=True)))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "_text"):
        for at in range(0, part.num_rows, _DOCS):
            yield part.slice(at, _DOCS)


# -- training -----------------------------------------------------------------


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150) -> View:
    """Weighted logistic regression with a quadratic penalty, by Adam on all rows; scales ``x`` in place."""
    mean, std = x.mean(0), x.std(0)
    scale = np.where(std > 1e-6, 1 / np.maximum(std, 1e-6), 0).astype(np.float32)
    x -= mean
    x *= scale
    z = x.astype(np.float32, copy=False)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        off = (weight * (_sigmoid(z @ w + b) - y)).astype(np.float32)
        grad = np.append(z.T @ off + 2e-3 * w, off.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.05 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
    return View(mean, scale, w, float(b))


def _calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt's scaling on held-out rows, with his smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    raw = view.raw(x)
    size = max(float(np.abs(raw).max()), 1e-9)
    z = raw / size

    def loss(a: float, b: float) -> float:
        v = a * z + b
        return float((np.logaddexp(0, v) - target * v).sum()) + 1e-3 * a * a

    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * z + b)
        off, w = p - target, p * (1 - p)
        g = np.array([(off * z).sum() + 2e-3 * a, off.sum()])
        h = np.array([[(w * z * z).sum() + 2e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        step, share = np.linalg.solve(h, g), 1.0
        while share > 1e-6 and loss(a - share * step[0], b - share * step[1]) > loss(a, b):
            share /= 2
        a, b = a - share * step[0], b - share * step[1]
        if share * np.abs(step).max() < 1e-6:
            break
    a /= size
    # A view that does not separate the labels falls back to the prior.
    view.slope, view.shift = (a, b) if a > 0 else (0.0, float(np.log((good + 1) / (bad + 1))))


@dataclass
class Lesson:
    """Documents that a view labels for the other one: content keys, labels, both views' features."""

    keys: np.ndarray
    labels: np.ndarray
    features: tuple[np.ndarray, np.ndarray]


#: From both views, the keys that each has handed over, and how many good and bad documents
#: to take at most: a lesson of each view.
Surest = Callable[[list[View], list[np.ndarray], int, int], list[Lesson]]


def train(
    text: np.ndarray, meta: np.ndarray, y: np.ndarray, held: np.ndarray, surest: Surest
) -> Model | None:
    """Co-train on labelled rows that are not ``held`` and on lessons, calibrate on the held rows."""
    if len(y) == 0 or min(y[~held].sum(), (1 - y[~held]).sum()) < 1:
        return None
    base, views = y[~held], (text, meta)
    share = base.mean()
    good, bad = round(PER_ROUND * share), round(PER_ROUND * (1 - share))
    lessons: tuple[list[Lesson], list[Lesson]] = ([], [])
    fitted: list[View] = []
    for turn in range(ROUNDS + 1):
        fitted = []
        for v in range(2):
            heard = lessons[1 - v]
            x = np.concatenate((views[v][~held], *(part.features[v] for part in heard)))
            labels = np.concatenate((base, *(part.labels for part in heard)))
            # Taught labels count half of given ones.
            weight = np.where(np.arange(len(labels)) < len(base), 1.0, 0.5)
            fitted.append(_fit(x, labels, weight))
        if turn == ROUNDS:
            break
        done = [np.concatenate((np.empty(0, np.int64), *(p.keys for p in own))) for own in lessons]
        new = surest(fitted, done, good, bad)
        if not any(len(part.keys) for part in new):
            break
        for own, part in zip(lessons, new, strict=True):
            own.append(part)
    check = held if 0 < y[held].sum() < held.sum() else ~held
    for v in range(2):
        _calibrate(fitted[v], views[v][check], y[check])
    return Model(fitted[0], fitted[1], float(np.log(share / (1 - share))))


def content_key() -> Column:
    """Names what both views read of a document, so that copies have one name."""
    named = (F.coalesce(F.col(c), F.lit("\x00")) for c in ("source", "lang"))
    chars = F.coalesce(F.col("n_chars").cast("double"), F.lit(-1.0))
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), *named, chars)


def _column(part: pa.RecordBatch, name: str) -> np.ndarray:
    return part.column(part.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _packed(row: np.ndarray) -> bytes:
    """A row of features for its way to the driver: most of them are zero."""
    return zlib.compress(row.tobytes(), 1)


def _matrix(rows: pa.Table, name: str, width: int) -> np.ndarray:
    """The packed rows of a column, unpacked one by one into one array."""
    out = np.empty((rows.num_rows, width), np.float32)
    for i, row in enumerate(rows[name]):
        out[i] = np.frombuffer(zlib.decompress(row.as_py()), np.float32)
    return out


def _features(docs: DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The names in order, and features of the row of each ``name`` with the smallest ``key``.

    For a bounded number of names. A task holds one row of each, whatever number of rows
    they have, and as many are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, bytes, bytes]] = {}
        for part in _parts(batches):
            names, keys = _column(part, "name"), _column(part, "key")
            order = np.lexsort((keys, names))
            order = order[np.r_[True, np.diff(names[order]) != 0]]
            new = [i for i in order if names[i] not in best or keys[i] < best[names[i]][0]]
            if new:
                part = part.take(pa.array(new))
                t, m = text_features(strings(part, "_text")), meta_features(part)
                for i, j in enumerate(new):
                    best[int(names[j])] = (int(keys[j]), _packed(t[i]), _packed(m[i]))
        rows = [(name, *row) for name, row in best.items()]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.record_batch(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
            ["name", "key", "t", "m"],
        )

    rows = (
        viewed(docs, ["name", "key"])
        .mapInArrow(run, "name long, key long, t binary, m binary")
        .groupBy("name")
        .agg(F.min_by(F.struct("t", "m"), "key").alias("row"))
        .select("name", "row.t", "row.m")
        .toArrow()
        .sort_by("name")
    )
    names = np.array(rows["name"].to_pylist(), np.int64)
    text = _matrix(rows, "t", (1 << BITS) + _MEASURES)
    return names, (text, _matrix(rows, "m", (1 << _META_BITS) + 34))


def _sure(docs: DataFrame, views: list[View], done: list[np.ndarray]) -> DataFrame:
    """(doc_id, key, view, label, odds) of every document and view that is sure of it."""
    shared = docs.sparkSession.sparkContext.broadcast((views, done))
    least = float(np.log(SURE / (1 - SURE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, handed = shared.value
        for part in _parts(batches):
            keys = _column(part, "key")
            x = (text_features(strings(part, "_text")), meta_features(part))
            for v in range(2):
                # Odds are cut to four digits, so that ties do not hang on how rows meet in batches.
                raw = np.round(fitted[v].raw(x[v]).astype(np.float64), 4)
                at = np.flatnonzero((np.abs(raw) >= least) & ~np.isin(keys, handed[v]))
                yield pa.record_batch(
                    [
                        part.column(part.schema.get_field_index("doc_id")).take(pa.array(at)),
                        pa.array(keys[at]),
                        pa.array(np.full(len(at), v, np.int32)),
                        pa.array((raw[at] > 0).astype(np.int32)),
                        pa.array(np.abs(raw[at])),
                    ],
                    ["doc_id", "key", "view", "label", "odds"],
                )

    return viewed(docs, ["doc_id", "key"]).mapInArrow(
        run, "doc_id long, key long, view int, label int, odds double"
    )


def _surest_of(docs: DataFrame, known: DataFrame) -> Surest:
    """Lessons from all of ``docs``, with their ``key``, whose ids are not among the ``known``."""
    spark = docs.sparkSession

    def surest(
        views: list[View], done: list[np.ndarray], good: int, bad: int
    ) -> list[Lesson]:
        ranked = Window.partitionBy("view", "label").orderBy(F.desc("odds"), "key")
        rows = (
            _sure(docs, views, done)
            .join(known, "doc_id", "left_anti")
            .groupBy("view", "label", "key")
            .agg(F.max("odds").alias("odds"))
            .withColumn("place", F.row_number().over(ranked))
            .where(F.col("place") <= PER_ROUND)
            .where(F.col("place") <= F.when(F.col("label") == 1, good).otherwise(bad))
            .collect()
        )
        # At most twice PER_ROUND keys go to all tasks.
        picked = spark.createDataFrame(sorted({(r["key"],) for r in rows}), "key long")
        held = docs.join(F.broadcast(picked), "key").withColumn("name", F.col("key"))
        names, features = _features(held)
        lessons = []
        for v in range(2):
            own = {r["key"]: r["label"] for r in rows if r["view"] == v}
            at = np.flatnonzero(np.isin(names, list(own)))
            labels = np.array([own[int(k)] for k in names[at]], np.float64)
            lessons.append(Lesson(names[at], labels, (features[0][at], features[1][at])))
        return lessons

    return surest


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """Fit on (doc_id, text, source, lang, n_chars) and a bounded sample of (doc_id, label)."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.avg(label).alias("mean"))
    )
    columns = [F.col(c) for c in ("doc_id", "text", "source", "lang", "n_chars")]
    named = docs.where(F.col("doc_id").isNotNull()).select(*columns, content_key().alias("key"))
    given = (
        known.where("mean <> 0.5")
        .join(named.select("doc_id").distinct(), "doc_id", "left_semi")
        .select("doc_id", (F.col("mean") > 0.5).cast("int").alias("tag"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(LABELLED)
        .collect()
    )
    # At most LABELLED ids go to all tasks.
    picked = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in given], "name long")
    chosen = named.join(F.broadcast(picked), F.col("doc_id") == F.col("name"))
    names, (text, meta) = _features(chosen)
    tags = {r["doc_id"]: r["tag"] for r in given}
    y = np.array([tags[int(d)] for d in names], np.float64)
    held = np.array([hash_fold(int(d)) == 0 for d in names], bool)
    model = train(text, meta, y, held, _surest_of(named, known.select("doc_id")))
    release()
    return model


def hash_fold(doc_id: int) -> int:
    """One of five folds."""
    return (doc_id * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) % 5


# -- scoring ------------------------------------------------------------------


def _judge(part: pa.RecordBatch, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if model is None:
        one = np.ones(part.num_rows)
        return one, one, one
    t = model.text.odds(text_features(strings(part, "_text")))
    m = model.meta.odds(meta_features(part))
    return _sigmoid(t), _sigmoid(m), _sigmoid(t + m - model.prior)


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with text_score, meta_score, score and whether to ``keep`` it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = viewed(docs, keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            t, m, s = _judge(part, shared.value)
            yield pa.record_batch(
                [*part.columns[: len(keep)], *(pa.array(x) for x in (t, m, s, s >= LEAST))],
                [*keep, "text_score", "meta_score", "score", "kept"],
            )

    return rows.mapInArrow(
        run, f"{kinds}, text_score double, meta_score double, score double, kept boolean"
    )


def accepted(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``LEAST`` or more.

    Only what the views read goes to Python, and one truth value per row comes back.
    """
    return docs.where(_passes(docs.sparkSession.sparkContext.broadcast(model))(*_read()))


def _passes(shared: Broadcast):
    @F.arrow_udf("boolean")
    def passes(text: pa.Array, source: pa.Array, lang: pa.Array, chars: pa.Array) -> pa.Array:
        part = pa.record_batch([text, source, lang, chars], _VIEWED)
        judged = [_judge(p, shared.value)[2] >= LEAST for p in _parts([part])]
        return pa.array(np.concatenate(judged) if judged else np.empty(0, bool))

    return passes
