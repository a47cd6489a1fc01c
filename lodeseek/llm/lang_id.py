"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one pass over all learning rows: each task counts n-grams of its
texts in numpy and hands on (language, bucket, count) rows, which Spark adds up.
The log-probability matrix has ``2 ** bits`` rows and a column per language, and
is broadcast; its size does not depend on the number of documents. Prediction
needs no shuffle: per slice of texts, the sparse counts times the matrix.

Letters are lower-cased, everything else is one blank, and n-grams never cross
the border of two texts. Languages are ordered by name, which settles ties.

Defined cases: a text that is null, empty or without a letter gets ``und`` and
score 0, as does every text when nothing could be learned; rows whose language
is null or whose text has no letter teach nothing; repeated rows count each
time; a null id is predicted like any other. Other columns are neither read nor
returned, so extra columns cannot clash.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import slices, strings

SIZES = (1, 2, 3)
BITS = 15
SMOOTHING = 0.5
MAX_LANGUAGES = 2000
_STEP = 1_000_000
UNKNOWN = "und"


@dataclass
class Model:
    """``weights``: a row per bucket and one of zeros, a column per language; ``prior``: logs."""

    languages: list[str]
    weights: np.ndarray
    prior: np.ndarray
    bits: int = BITS


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, blanks between words and around each text; borders of texts.

    A text without a letter has no code points.
    """
    lowered = [f" {t.lower()} " for t in texts]
    ends = np.cumsum([0, *map(len, lowered)])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    # A blank stays where a word ends, and where the first word of a text begins.
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = ends[:-1]
    before = np.concatenate(([0], np.cumsum(letter)))
    filled = before[ends[1:]] > before[starts]
    keep[starts[filled]] = True
    out = np.where(letter, points, np.uint32(32))[keep]
    return out, np.concatenate(([0], np.cumsum(keep)))[ends]


def buckets(points: np.ndarray, borders: np.ndarray, size: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each code point; ``2 ** bits`` where none fits."""
    h = np.full(len(points), np.uint32(size * 0x9E3779B1 & 0xFFFFFFFF))
    for i in range(size):
        shifted = np.zeros_like(points)
        shifted[: len(points) - i] = points[i:]
        h = (h ^ shifted) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    h = (h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)
    for i in range(1, size):  # n-grams that would run into the next text
        last = borders[1:] - i
        h[last[last >= borders[:-1]]] = 1 << bits
    return h


def count_ngrams(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task's rows; bucket -1 counts documents."""
    size = (1 << bits) + 1
    counts: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}

    def flush() -> pa.RecordBatch:
        langs, which, n = [], [], []
        for lang, c in counts.items():
            at = np.flatnonzero(c[:-1])
            langs += [lang] * (len(at) + 1)
            which += [np.array([-1]), at]
            n += [np.array([documents[lang]]), c[at]]
        counts.clear()
        documents.clear()
        flat = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (which, n)]
        return pa.record_batch(
            [pa.array(langs, pa.string()), pa.array(flat[0].astype(np.int32)), pa.array(flat[1])],
            ["lang", "bucket", "n"],
        )

    for part in slices(batches):
        langs = part.column(part.schema.get_field_index("lang")).to_pylist()
        order = sorted(range(len(langs)), key=langs.__getitem__)
        texts = strings(part)
        points, borders = letters_of([texts[i] for i in order])
        first = 0
        while first < len(order):
            lang, last = langs[order[first]], first
            while last < len(order) and langs[order[last]] == lang:
                last += 1
            own = borders[first : last + 1]
            filled = int(np.count_nonzero(np.diff(own)))
            if filled:
                if lang not in counts:
                    counts[lang] = np.zeros(size, np.int64)
                documents[lang] = documents.get(lang, 0) + filled
                here = points[own[0] : own[-1]]
                for n in SIZES:
                    h = buckets(here, own - own[0], n, bits)
                    counts[lang] += np.bincount(h, minlength=size)
            first = last
        if len(counts) > 64:
            yield flush()
    if counts:
        yield flush()


def learn(docs: DataFrame, bits: int = BITS) -> Model:
    """Fit on all rows of (text, lang) whose language is known."""
    known = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    counted = known.mapInArrow(
        lambda batches: count_ngrams(batches, bits), "lang string, bucket int, n long"
    )
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(rows["lang"].unique().to_pylist())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the matrix is made for {MAX_LANGUAGES}")
    column = pc.index_in(rows["lang"], pa.array(languages, pa.string())).to_numpy()
    bucket, n = rows["bucket"].to_numpy(), rows["n"].to_numpy()
    counts = np.zeros(((1 << bits) + 1, len(languages)))
    gram = bucket >= 0
    counts[bucket[gram], column[gram]] = n[gram]
    documents = np.zeros(len(languages))
    documents[column[~gram]] = n[~gram]
    weights = np.log(counts[:-1] + SMOOTHING)
    weights -= np.log(counts[:-1].sum(0) + SMOOTHING * (1 << bits))
    weights = np.vstack((weights, np.zeros((1, len(languages)))))
    prior = np.log(documents / documents.sum()) if languages else documents
    return Model(languages, weights.astype(np.float32), prior, bits)


def score_texts(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior for each text."""
    points, borders = letters_of(texts)
    filled = np.diff(borders) > 0
    names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if not model.languages or not filled.any():
        return list(names), score
    log = np.zeros((len(texts), len(model.languages)))
    # Blocks of whole texts; only a text beyond a block's size is summed in parts.
    owner = np.repeat(np.arange(len(texts)), np.diff(borders))
    for n in SIZES:
        h = buckets(points, borders, n, model.bits)
        for at in range(0, len(h), _STEP):
            own = owner[at : at + _STEP]
            cut = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            gathered = model.weights[h[at : at + _STEP]]
            log[own[cut]] += np.add.reduceat(gathered, cut, axis=0, dtype=np.float64)
    log += model.prior
    best = log.argmax(1)
    top = log[np.arange(len(log)), best]
    posterior = 1 / np.exp(log - top[:, None]).sum(1)
    names[filled] = np.array(model.languages, object)[best[filled]]
    score[filled] = posterior[filled]
    return list(names), score


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text"):
            names, score = score_texts(strings(part, "_text"), shared.value)
            yield pa.record_batch(
                [*part.columns[:-1], pa.array(names, pa.string()), pa.array(score)],
                [*keep, "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
