"""Exact nearest neighbours and the heuristic second ranking."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodeseek.functions.tokens import symbol_tokens

# Factors on the distance, lower is better.
FUNCTION_FACTOR = 0.85
TEST_NAME_FACTOR = 1.15
OVERLAP_STRONG_FACTOR = 0.88
OVERLAP_WEAK_FACTOR = 0.94
COVERAGE_FULL_FACTOR = 0.85
COVERAGE_HALF_FACTOR = 0.92
# Fixed value: candidates fetched per wanted hit before the second ranking.
OVERFETCH = 3

# Query vectors held by one task, and at most so many go by way of the driver.
QUERY_BLOCK_BYTES = 64 << 20


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that hold a vector of this length, those vectors as float64)."""
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    usable = vectors if len(rows) == len(vectors) else vectors.take(pa.array(rows))
    m = usable.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # A component that is null or not a number leaves its vector without a distance.
    sound = np.isfinite(m).all(1)
    return (rows, m) if sound.all() else (np.asarray(rows)[sound], m[sound])


def _query_matrix(vectors: pa.Array) -> np.ndarray:
    """Query vectors as float64, a null component as no number; all have one length."""
    (dim, *others) = pc.unique(vectors.value_lengths()).to_pylist()
    if others:
        raise ValueError("query vectors are of several lengths")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), dim)


def squared_l2(vector: Column, query: list[float]) -> Column:
    """Squared Euclidean distance to one query; NULL for other vector lengths."""
    target = np.asarray(query, dtype=np.float64)

    @F.arrow_udf("double")
    def distance(vectors: pa.Array) -> pa.Array:
        rows, m = _matrix(vectors, len(target))
        out = np.full(len(vectors), np.nan)
        m -= target
        out[rows] = np.einsum("ij,ij->i", m, m)
        return pa.array(out, from_pandas=True)

    return distance(vector)


def nearest(
    rows: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector"
) -> DataFrame:
    """The k nearest rows with their `_distance`, ties broken by key.

    Distances are Arrow batches of doubles; ordering and limit become one
    per-partition top-k, so only k rows per task leave it. Rows without a
    distance go last and are dropped behind the limit: a filter before it would
    be pushed down and measure every vector a second time.
    """
    return (
        rows.withColumn("_distance", squared_l2(F.col(vector), query))
        .orderBy(F.asc_nulls_last("_distance"), key)
        .limit(k)
        .where(F.col("_distance").isNotNull())
    )


def _task_top_k(queries: np.ndarray, k: int, batches: Iterator[pa.RecordBatch]):
    """Running exact top-k of every query over the batches of one task."""
    n, dim = queries.shape
    square = (queries * queries).sum(1)
    ids: list[Any] = [None] * n
    dist: list[Any] = [np.empty(0)] * n
    worst = np.full(n, np.inf)
    for batch in batches:
        rows, m = _matrix(batch.column(1), dim)
        if not len(rows):
            continue
        keys = batch.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False)
        norms = (m * m).sum(1)
        slack = 1e-9 * (1.0 + norms.max())
        for at in range(0, n, 256):
            block = slice(at, at + 256)
            # The product form only preselects; survivors are measured exactly.
            rough = queries[block] @ m.T
            rough *= -2.0
            rough += norms
            rough += square[block, None]
            bound = worst[block].copy()
            new = np.flatnonzero(np.isinf(bound))
            if len(new) and len(m) > k:
                bound[new] = np.partition(rough[new], k - 1, axis=1)[:, k - 1]
            bound += slack + 1e-9 * square[block]
            asked, near = np.nonzero(rough <= bound[:, None])
            ends = np.searchsorted(asked, np.arange(len(bound) + 1))
            for i in np.flatnonzero(np.diff(ends)):
                q, mine = at + i, near[ends[i] : ends[i + 1]]
                gap = m[mine] - queries[q]
                d = np.concatenate([dist[q], np.einsum("ij,ij->i", gap, gap)])
                names = keys[mine] if ids[q] is None else np.concatenate([ids[q], keys[mine]])
                best = np.lexsort((names, d))[:k]
                ids[q], dist[q] = names[best], d[best]
                if len(best) == k:
                    worst[q] = dist[q][-1]
    return ids, dist


def _hits(names: list, queries: np.ndarray, k: int, batches, arrow: pa.Schema):
    """Each query's nearest of some batches, as rows."""
    ids, dist = _task_top_k(queries, k, batches)
    for q, found in enumerate(ids):
        if found is not None:
            columns = [[names[q]] * len(found), found.tolist(), dist[q]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)],
                schema=arrow,
            )


def _nearest_to_block(
    rows: DataFrame, block: list[tuple[Any, list[float]]], k: int, schema: T.StructType
) -> DataFrame:
    names = [name for name, _ in block]
    vectors = np.asarray([v for _, v in block], dtype=np.float64)
    arrow = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _hits(names, vectors, k, batches, arrow)

    return rows.mapInArrow(search, schema)


def _grid(size: int, block_bytes: int, cores: int) -> tuple[int, int]:
    """(query blocks, shares of the rows) of a search for `size` bytes of query vectors.

    What is shuffled are the rows once per block and the queries once per share. So there
    are no more of either than it takes to keep the cores busy, however small a block could
    be; more blocks are made only where these would hold over ``QUERY_BLOCK_BYTES``.
    """
    side = math.ceil(math.sqrt(2 * cores))
    blocks = -(-size // block_bytes)
    return min(blocks, max(side, -(-size // QUERY_BLOCK_BYTES))), side


def _nearest_to_blocks(
    rows: DataFrame, queries: DataFrame, blocks: int, shares: int, k: int, schema: T.StructType
) -> DataFrame:
    """The same for any number of query blocks, in one job and without the driver.

    Rows are dealt into shares, queries into blocks; a task gets one share and one block,
    the block's queries first.
    """
    key, vector = rows.columns
    none = F.lit(None)
    data = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64(key), F.lit(shares)).cast("int").alias("share"),
        F.lit(1).alias("kind"),
        none.cast(schema["query_id"].dataType).alias("query_id"),
        F.col(key).alias("key"),
        F.col(vector).alias("vector"),
    )
    asked = queries.select(
        F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"),
        F.lit(0).alias("kind"),
        "query_id",
        none.cast(schema[1].dataType).alias("key"),
        F.col("vector").cast(rows.schema[vector].dataType).alias("vector"),
    )
    arrow = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = [], []
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            n = int(np.searchsorted(batch.column(2).to_numpy(), 1))
            if n:
                asks = batch.slice(0, n)
                names += asks.column(3).to_pylist()
                held.append(_query_matrix(asks.column(5)))
            if n < batch.num_rows:
                rest = [batch.slice(n)]
                break
        if not names:
            return
        data = (b.select([4, 5]) for b in itertools.chain(rest, batches))
        yield from _hits(names, np.concatenate(held), k, data, arrow)

    place = (F.col("block") * shares + F.col("share")).cast("int")
    dealt = data.unionByName(asked).repartitionById(blocks * shares, place)
    return dealt.sortWithinPartitions("kind").mapInArrow(search, schema)


def nearest_to_each(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "id",
    vector: str = "vector",
    block_bytes: int = QUERY_BLOCK_BYTES,
) -> DataFrame:
    """(query_id, key, _distance, rank) of the k nearest rows of every query.

    `queries` has (query_id, vector). A query set of up to `block_bytes` goes to the data:
    one scan without a shuffle, of which each task returns at most k rows per query. A
    larger one is dealt into blocks of that size or more, and tasks pair a block with a
    share of the rows, all in one job.
    """
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField(key, rows.schema[key].dataType),
            T.StructField("_distance", T.DoubleType()),
        ]
    )
    slim = rows.select(key, vector)
    usable = queries.select("query_id", "vector").where(F.col("vector").isNotNull())
    size = usable.agg(F.sum(F.size("vector") * 8)).first()[0]
    if size is None:
        return slim.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
    if size > block_bytes:
        cores = slim.sparkSession.sparkContext.defaultParallelism
        blocks, shares = _grid(size, block_bytes, cores)
        return _ranked(_nearest_to_blocks(slim, usable, blocks, shares, k, schema), k, key)
    block = [(r["query_id"], r["vector"]) for r in usable.collect()]
    return _ranked(_nearest_to_block(slim, block, k, schema), k, key)


def _ranked(hits: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("_distance", key)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank_score(distance: Column, kind: Column, symbol: Column, tokens: Column) -> Column:
    """Distance times the factors for kind, test names and token overlap.

    A missing distance scores 0 and thus comes first.
    """
    is_function = kind.isin("function", "method")
    head = F.substring_index(symbol, ":part", 1)
    is_test = head.startswith("test_") | head.startswith("Test")
    symbol_words = symbol_tokens(F.coalesce(symbol, F.lit("")))
    overlap = F.size(F.array_intersect(tokens, symbol_words))
    coverage = F.try_divide(overlap, F.size(symbol_words))
    return F.coalesce(
        distance
        * F.when(is_function, F.lit(FUNCTION_FACTOR)).otherwise(1.0)
        * F.when(is_function & is_test, F.lit(TEST_NAME_FACTOR)).otherwise(1.0)
        * F.when(overlap >= 2, F.lit(OVERLAP_STRONG_FACTOR))
        .when(overlap == 1, F.lit(OVERLAP_WEAK_FACTOR))
        .otherwise(1.0)
        * F.when((overlap >= 1) & (coverage >= 0.9), F.lit(COVERAGE_FULL_FACTOR))
        .when((overlap >= 1) & (coverage >= 0.5), F.lit(COVERAGE_HALF_FACTOR))
        .otherwise(1.0),
        F.lit(0.0),
    )


def rerank(hits: DataFrame, tokens: Column, key: str = "id") -> DataFrame:
    """Add `_rerank_score` and order by it; equal scores keep distance order."""
    score = rerank_score(F.col("_distance"), F.col("kind"), F.col("symbol"), tokens)
    return hits.withColumn("_rerank_score", score).orderBy("_rerank_score", "_distance", key)
