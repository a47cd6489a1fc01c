"""Importance resampling towards a target: weights from an array, ranks by a distributed radix sort.

Features of a text are its runs of 1 to ``orders`` consecutive words; a feature's bucket
is a checksum modulo ``buckets``. Both corpora are counted whole, by bucket, in tasks and
then over them. A bucket's gain is the logarithm of how much likelier the target is to
show it; the gains are an array of ``buckets`` integers, looked up for all words of a
slice of texts at once. A text's weight is the mean gain of its features, its score the
weight plus noise drawn from the hash of its id, so that the highest scores are a sample
without replacement.

The order (score falling, id rising, rows without id behind others) is made by a least
significant digit radix sort. Rows lie in blocks and have a place in their block. A pass

1. counts the digits of each block,
2. adds the counts up: by digit over all (at most ``RADIX`` numbers), and within a digit
   over the blocks before, which gives the place where a block's rows of a digit begin,
3. deals the rows of each block out by a stable counting sort: a row's destination is that
   place and its rank among its block's rows of the digit; destinations name the next block.

After the last pass a destination is the final rank. Every block has the same number of
rows, whatever the keys are, so ties and hot values need no splitting, and a task holds one
block. Each pass is written before the next, so a lost executor costs at most a pass; files
of the pass before are deleted then. Only rows that may be drawn take part.

Defined cases: a null or empty text has no feature and weight 0; rows with equal ids are
rows of their own, equal rows take neighbouring ranks; a null id has noise of its own
(``seed:``); an empty table, or a target without words, is no fault; extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import slices
from lodeseek.workspace import discard, saved

BUCKETS = 10_000
SEED = 2024
RADIX_BITS = 12
BLOCK_ROWS = 1 << 20
LEAST_ROWS = 1024
SLICE = 4_000_000
REMEMBERED = 1_000_000

# Letters and digits of ASCII, capitals as small letters, and all bytes of other characters.
_WORD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


class Buckets(dict):
    """Bucket of a feature; remembers those of single words."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket


def features(
    texts: pa.Array, known: Buckets, orders: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features, where each text's begin and the end, numbers of words)."""
    split = [(t or b"").translate(_WORD).split() for t in texts.cast(pa.binary()).to_pylist()]
    n_words = np.array([len(w) for w in split], np.int64)
    if orders == 1:
        flat = np.fromiter(
            (known[w] for words in split for w in words), np.int64, int(n_words.sum())
        )
        return flat, np.concatenate(([0], np.cumsum(n_words))), n_words
    found = [
        [zlib.crc32(b" ".join(words[i : i + k])) % known.buckets for i in range(len(words) - k + 1)]
        for words in split
        for k in range(1, orders + 1)
    ]
    sizes = np.array([len(x) for x in found], np.int64).reshape(len(split), orders).sum(1)
    flat = np.array([b for x in found for b in x], np.int64)
    return flat, np.concatenate(([0], np.cumsum(sizes))), n_words


def bucket_counts(texts: DataFrame, orders: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for part in slices(batches, size=SLICE):
            total += np.bincount(features(part.column(0), known, orders)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    # At most one row per bucket.
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the ratio of smoothed shares, floored, by bucket."""
    n = len(source)
    all_source, all_target = int(source.sum()) + n, int(target.sum()) + n
    ratios = (
        (t + 1) * all_source / ((s + 1) * all_target)
        for s, t in zip(source.tolist(), target.tolist(), strict=True)
    )
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel variable, floored, from the hash of the id."""
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, orders: int, seed: int, least_words: int) -> DataFrame:
    """Per row doc_id, n_features, weight, score; rows that may be drawn have a block and a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block, place = Buckets(len(gain)), TaskContext.get().partitionId(), 0
        for part in slices(batches, size=SLICE):
            flat, borders, n_words = features(part.column(1), known, orders)
            sums = np.concatenate(([0], np.cumsum(gain[flat])))[borders]
            size = np.diff(borders)
            weight = np.diff(sums) // np.maximum(size, 1)
            lot = np.array([noise(d, seed) for d in part.column(0).to_pylist()], np.int64)
            drawable = n_words >= least_words
            places = place + np.cumsum(drawable) - 1
            place += int(drawable.sum())
            yield pa.record_batch(
                {
                    "doc_id": part.column(0),
                    "n_features": pa.array(size),
                    "weight": pa.array(weight),
                    "score": pa.array(weight + lot),
                    "block": pa.array(np.full(len(size), block, np.int64), mask=~drawable),
                    "place": pa.array(places, mask=~drawable),
                }
            )

    kinds = "doc_id long, n_features long, weight long, score long, block long, place long"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


@dataclass(frozen=True)
class Digit:
    """``bits`` bits from ``shift`` on of a key: ids from the lowest on, or scores from the highest down."""

    key: str
    start: int
    shift: int
    bits: int

    def of(self, part: pa.RecordBatch | pa.Table) -> np.ndarray:
        if self.key == "missing":
            return part["doc_id"].is_null().to_numpy(zero_copy_only=False).astype(np.uint16)
        column = part[self.key].fill_null(self.start).to_numpy(zero_copy_only=False)
        value, start = column.astype(np.int64).astype(np.uint64), np.uint64(self.start % (1 << 64))
        with np.errstate(over="ignore"):  # differences of 64-bit numbers, modulo 2**64
            gap = value - start if self.key == "doc_id" else start - value
        return (gap >> np.uint64(self.shift) & np.uint64((1 << self.bits) - 1)).astype(np.uint16)


def digits(low_id: int | None, high_id: int | None, missing: int, low: int, high: int) -> list[Digit]:
    """The digits of the composite key, least significant first."""

    def of(key: str, start: int, span: int) -> list[Digit]:
        width = span.bit_length()
        return [
            Digit(key, start, s, min(RADIX_BITS, width - s)) for s in range(0, width, RADIX_BITS)
        ]

    ids = of("doc_id", low_id, high_id - low_id) if low_id is not None else []
    return [*ids, *([Digit("missing", 0, 0, 1)] if missing else []), *of("score", high, high - low)]


def radix_pass(state: DataFrame, digit: Digit, block_rows: int, blocks: int, path: str) -> DataFrame:
    """``state`` stably ordered by one digit; ``blocks`` bounds the numbers of its blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            key = part["block"].to_numpy() << 16 | digit.of(part).astype(np.int64)
            names, n = np.unique(key, return_counts=True)
            yield pa.record_batch(
                [pa.array(names >> 16), pa.array(names & 0xFFFF), pa.array(n)], ["block", "digit", "n"]
            )

    counted = state.select("block", "doc_id", "score").mapInArrow(
        count, "block long, digit long, n long"
    )
    counts = saved(counted.groupBy("block", "digit").agg(F.sum("n").alias("n")), f"{path}/counts")
    # At most a row for each value of a digit.
    total = dict(counts.groupBy("digit").agg(F.sum("n")).collect())
    if len(total) < 2:
        return state
    bases, at = [], 0
    for value in sorted(total):
        bases.append((value, at))
        at += total[value]
    spark = state.sparkSession
    before = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(
        F.broadcast(spark.createDataFrame(bases, "digit long, base long")), "digit"
    )
    offsets = offsets.select("block", "digit", (F.col("base") + F.col("before")).alias("first"))
    both = state.unionByName(offsets, allowMissingColumns=True)
    names = state.columns
    top = (1 << RADIX_BITS) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        held.clear()
        own = table["block"].to_numpy()
        for block in np.unique(own):
            part = table.filter(pa.array(own == block))
            is_offset = part["first"].is_valid()
            starts = part.filter(is_offset)
            rows = part.filter(pa.compute.invert(is_offset)).select(names)
            first = np.zeros(top, np.int64)
            first[starts["digit"].to_numpy()] = starts["first"].to_numpy()
            # Places are dense, so putting rows back in order is a counting sort by itself.
            order = np.empty(len(rows), np.int64)
            order[rows["place"].to_numpy()] = np.arange(len(rows))
            value = digit.of(rows)[order]
            ranked = np.argsort(value, kind="stable")  # numpy counts digits of 16 bits
            size = np.bincount(value, minlength=top)
            rank = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
            goal = np.empty(len(rows), np.int64)
            goal[order[ranked]] = first[value[ranked]] + rank
            rows = rows.set_column(names.index("block"), "block", pa.array(goal // block_rows))
            rows = rows.set_column(names.index("place"), "place", pa.array(goal % block_rows))
            yield from rows.combine_chunks().to_batches()

    dealt = both.repartitionById(blocks, F.col("block").cast("int")).mapInArrow(deal, state.schema)
    return saved(dealt, f"{path}/rows")


def radix_ranks(state: DataFrame, folder: str, block_rows: int | None = None) -> DataFrame:
    """``state`` (doc_id, score, block, place, ..) with ``position`` from 0, highest score first.

    Rows of a block have the places 0, 1, 2, ..
    """
    spark = state.sparkSession
    known = state.agg(
        F.count("*"),
        F.min("doc_id"),
        F.max("doc_id"),
        F.count_if(F.col("doc_id").isNull()),
        F.min("score"),
        F.max("score"),
        F.max("block"),
    ).first()
    n = known[0]
    if block_rows is None:
        share = -(-n // (2 * spark.sparkContext.defaultParallelism))
        block_rows = min(BLOCK_ROWS, max(LEAST_ROWS, share))
    done, blocks, old = 0, (known[6] or 0) + 1, None
    for digit in digits(*known[1:6]) if n else []:
        path = f"{folder}/{done}"
        dealt = radix_pass(state, digit, block_rows, blocks, path)
        discard(spark, f"{path}/counts")
        if dealt is state:
            continue
        if old:
            discard(spark, old)
        state, blocks, old, done = dealt, -(-n // block_rows), path, done + 1
    if n and not done:
        # All keys are equal: any order of the blocks will do.
        sizes = state.groupBy("block").count()
        before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        at = sizes.select("block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_at"))
        return state.join(at, "block").withColumn("position", F.col("_at") + F.col("place")).drop("_at")
    return state.withColumn("position", F.col("block") * block_rows + F.col("place"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    folder: str,
    percent: int = 10,
    least_words: int = 20,
    orders: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank; rows that are not drawn have no rank.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred are drawn.
    """
    gain = gains(bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets))
    rows = saved(scored(docs, gain, orders, seed, least_words), f"{folder}/scored")
    drawable = F.col("place").isNotNull()
    ordered = radix_ranks(rows.where(drawable), f"{folder}/passes")
    drawn = rows.where(drawable).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    rank = F.when(F.col("position") < drawn, F.col("position") + 1).alias("rank")
    rest = rows.where(~drawable).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ordered.select(*columns, rank).unionByName(rest)


def drawn_rows(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with all their columns."""
    wanted = ranks.where(F.col("rank").isNotNull()).select("doc_id").distinct()
    return docs.join(wanted, "doc_id", "left_semi")
