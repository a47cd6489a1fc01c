"""Nearest neighbours by inner product: p-stable hashing with success-ordered probes.

Vectors get one more component, so that the largest inner product is the smallest
distance. As that component fills a vector up to the longest length, vectors are indexed
by bands of length: a band spans an octave at most, beginning with the longest vector
left, so that a few long ones do not crowd all others together (where over ``BANDS``
would arise, the shortest vectors share the last). In each band, each of ``TABLES`` hash tables projects on ``HASHES`` random directions (the
normal distribution is 2-stable) and cuts each projection into ``SLABS`` slabs. A
query visits its own bucket and perturbed ones: for each bucket the chance that it
holds a neighbour is the product of the slabs' normal probabilities around where the
query's neighbours project, and buckets are visited in falling order of it until the
chances add up to what ``RECALL`` asks of a table. Candidates of all tables meet at
the query, where exact inner products rank them.

The fit uses ``SAMPLE`` vectors at most: they set the slabs' widths, and from the
nearest of their pairs, as large a share as k is of all vectors, where neighbours
project; each band has a sample of its own. A query goes on visiting until it has seen
k + 1 entries of each table, or all of them, so that it never returns fewer than there are. Every vector is indexed. Equal vectors are one entry with its k + 1 smallest
ids, which is all that k neighbours and the query itself can take.

Where the work goes: the directory of buckets, at most ``TABLES * SLABS ** HASHES``
counts a band, is broadcast. Buckets of over ``BLOCK`` entries are split, and entries and
probes meet in cells of about ``CELL`` entries, of which a task holds one. A query is
sent once to each cell that holds a bucket it visits. Nothing is capped: all entries
of a visited bucket are measured.

Defined cases: vectors that are null, empty, zero, or hold a null or a component
that is not finite take no part, nor do rows without an id, nor vectors of another
length than most; rows that repeat id and vector are one; ties go to the smaller id;
an empty table gives no row; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.common import attach, mix64
from lodeseek.workspace import saved

TABLES = 2
HASHES = 6
SLABS = 4
RECALL = 0.995
BANDS = 8
SAMPLE = 4096
SAMPLE_QUERIES = 128
SAMPLE_PAIRS = 512
BLOCK = 4096
CELL = 8192
_QUERY_BLOCK = 256


@dataclass
class Index:
    """What the fit of a band found.

    ``directions`` (tables, dims + 1, hashes); ``edges``: inner borders of the slabs;
    neighbours project to ``slope`` times the query's projection plus ``shift``, give or
    take ``spread``.
    """

    directions: np.ndarray
    edges: np.ndarray
    slope: np.ndarray
    shift: np.ndarray
    spread: np.ndarray
    longest: float
    codes: np.ndarray
    counts: np.ndarray


@dataclass
class Bands:
    """Indexes by rising length of their longest vector, and the directory of all their buckets."""

    indexes: list[Index]
    limits: np.ndarray
    codes: np.ndarray
    blocks: np.ndarray
    cells: int

    def of(self, length: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.limits, length), len(self.limits) - 1)


_STRIDE = TABLES * SLABS**HASHES


def limits_of(bins: list[tuple[int, float]]) -> list[float]:
    """Lengths at which bands end, rising, from (sixteenth of an octave, longest length in it)."""
    out: list[float] = []
    first = 0
    for bin_, longest in sorted(bins, reverse=True):
        if not out or bin_ <= first - 16:
            if len(out) == BANDS:
                break
            out.append(longest)
            first = bin_
    return out[::-1]


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _extended(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
    return np.concatenate((x, rest[:, None]), axis=1)


def _aimed(q: np.ndarray, longest: float) -> np.ndarray:
    """Queries scaled to the longest vector; their own last component is 0."""
    scaled = q * (longest / np.sqrt((q * q).sum(1)))[:, None]
    return np.concatenate((scaled, np.zeros((len(q), 1))), axis=1)


def _codes(points: np.ndarray, index: Index) -> np.ndarray:
    """Bucket of each point in each table, numbered over all tables."""
    out = []
    for t, directions in enumerate(index.directions):
        projected = points @ directions
        slab = (projected[:, :, None] >= index.edges[t][None]).sum(2)
        out.append(slab @ (SLABS ** np.arange(HASHES)) + t * SLABS**HASHES)
    return np.array(out, np.int64)


def _normal(x: np.ndarray) -> np.ndarray:
    # A logistic curve within 0.01 of the normal distribution's.
    return 1 / (1 + np.exp(-np.clip(1.5976 * x + 0.07056 * x**3, -60, 60)))


def probes(queries: np.ndarray, index: Index, least: int = 0) -> list[np.ndarray]:
    """The buckets that each (aimed) query visits, of all tables, in order of success per table.

    They hold ``least`` entries of each table, or all of them.
    """
    goal = 1 - (1 - RECALL) ** (1 / TABLES)
    visits: list[list[np.ndarray]] = [[] for _ in queries]
    for t, directions in enumerate(index.directions):
        mine = index.codes // SLABS**HASHES == t
        own, sizes = index.codes[mine], index.counts[mine]
        digits = (own[:, None] // SLABS ** np.arange(HASHES)) % SLABS
        projected = queries @ directions
        centre = index.slope[t] * projected + index.shift[t]
        inner = _normal((index.edges[t][None] - centre[:, :, None]) / index.spread[t][:, None])
        outer = np.concatenate(
            (np.zeros((*projected.shape, 1)), inner, np.ones((*projected.shape, 1))), axis=2
        )
        chance = np.log(np.maximum(np.diff(outer, axis=2), 1e-30))
        total = np.zeros((len(queries), len(own)))
        for j in range(HASHES):
            total += chance[:, j][:, digits[:, j]]
        order = np.argsort(-total, axis=1, kind="stable")
        success = np.exp(np.take_along_axis(total, order, 1))
        reached = np.cumsum(success, axis=1)
        count = (reached < goal * reached[:, -1:]).sum(1) + 1
        seen = np.cumsum(sizes[order], axis=1)
        count = np.minimum(np.maximum(count, (seen < least).sum(1) + 1), len(own))
        for i, n in enumerate(count):
            visits[i].append(own[order[i, :n]])
    return [np.concatenate(v) for v in visits]


def usable(vector: Column) -> Column:
    """Whether a vector can take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, kind: str = "f8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """The vectors as bytes of doubles, and their lengths, beside the columns ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(batch.num_columns - 1)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(v), -1)
            raw = pa.array([x.tobytes() for x in flat], pa.binary())
            length = pa.array(_lengths(flat))
            yield pa.record_batch([*batch.columns[:-1], raw, length], [*names, "vector", "length"])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.select(*names, "vector").mapInArrow(run, f"{kinds}, vector binary, length double")


def _spreads(
    raw: np.ndarray, points: np.ndarray, directions: np.ndarray, longest: float, share: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where neighbours project, seen from their query: slope, shift and spread by direction.

    Neighbours are the nearest ``share`` of the sample's pairs, ``SAMPLE_PAIRS`` at least.
    """
    slope = np.ones(TABLES)
    shift = np.zeros((TABLES, HASHES))
    spread = np.full((TABLES, HASHES), longest)
    if len(raw) < 2:
        return slope, shift, spread
    aimed = _aimed(raw[:SAMPLE_QUERIES], longest)
    likeness = aimed @ points.T
    likeness[np.arange(len(aimed)), np.arange(len(aimed))] = -np.inf
    pairs = len(aimed) * (len(points) - 1)
    n = min(pairs, max(round(share * pairs), SAMPLE_PAIRS))
    query, near = np.divmod(np.argpartition(-likeness.ravel(), n - 1)[:n], len(points))
    for t in range(TABLES):
        q, x = aimed[query] @ directions[t], points[near] @ directions[t]
        slope[t] = (q * x).sum() / max((q * q).sum(), 1e-12)
        rest = x - slope[t] * q
        shift[t], spread[t] = rest.mean(0), np.maximum(rest.std(0), 1e-6 * longest)
    return slope, shift, spread


def fit(entries: DataFrame, k: int, seed: int = 17) -> Bands:
    """The bands of length and the index of each."""
    bin_ = F.floor(F.log2("length") * 16)
    bins = entries.groupBy(bin_.alias("bin")).agg(F.max("length")).collect()
    limits = limits_of([(r[0], r[1]) for r in bins]) or [1.0]
    indexes = []
    for i, limit in enumerate(limits):
        own = entries.where(F.col("length") <= limit)
        if i:
            own = own.where(F.col("length") > limits[i - 1])
        indexes.append(fit_band(own, k, limit, seed))
    counts = np.concatenate([ix.counts for ix in indexes])
    codes = np.concatenate([ix.codes + i * _STRIDE for i, ix in enumerate(indexes)])
    cells = max(1, -(-int(counts.sum()) // CELL))
    return Bands(indexes, np.array(limits), codes, -(-counts // BLOCK), cells)


def fit_band(entries: DataFrame, k: int, longest: float, seed: int) -> Index:
    """Directions, slabs and spreads from the sample; the directory of all buckets."""
    spark = entries.sparkSession
    total = entries.count()
    rows = entries.select("u", "vector").orderBy("u").limit(SAMPLE).collect()
    rng = np.random.default_rng(seed)
    raw = np.array([np.frombuffer(r["vector"], "f8") for r in rows]).reshape(
        len(rows), -1 if rows else 0
    )
    points = _extended(raw, longest)
    dims = points.shape[1]
    width = max(HASHES, dims)
    directions = np.array(
        [np.linalg.qr(rng.standard_normal((width, HASHES)))[0][:dims] for _ in range(TABLES)]
    )
    edges = np.empty((TABLES, HASHES, SLABS - 1))
    for t in range(TABLES):
        projected = points @ directions[t] if len(points) else np.zeros((1, HASHES))
        step = projected.std(0) + 1e-12
        shift = rng.random(HASHES) - 0.5
        for s in range(SLABS - 1):
            edges[t, :, s] = projected.mean(0) + step * (s - (SLABS - 2) / 2 + 0.5 * shift)
    slope, shift, spread = _spreads(raw, points, directions, longest, k / max(1, total - 1))
    none = np.empty(0, np.int64)
    index = Index(directions, edges, slope, shift, spread, longest, none, none)
    shared = spark.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_STRIDE, np.int64)
        for batch in batches:
            if batch.num_rows:
                codes = _codes(_extended(_matrix(batch.column(0)), shared.value.longest), shared.value)
                n += np.bincount(codes.ravel(), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(at), pa.array(n[at])], ["code", "n"])

    counted = entries.select("vector").mapInArrow(count, "code long, n long")
    found = counted.groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    index.codes, index.counts = found["code"].to_numpy(), found["n"].to_numpy()
    return index


def _cells(codes: np.ndarray, block: np.ndarray, cells: int) -> np.ndarray:
    h = mix64(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + block.astype(np.uint64))
    return (h % np.uint64(cells)).astype(np.int64)


_KINDS = "cell long, kind int, u long, low long, codes binary, vector binary"
_NAMES = ["cell", "kind", "u", "low", "codes", "vector"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], _NAMES)


def placed_entries(entries: DataFrame, index: Bands) -> DataFrame:
    """Each entry (u, low, vector) in the cell of its bucket's block, once per table."""
    shared = entries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            u, vectors = batch.column(0).to_numpy(), batch.column(2)
            x, band = _matrix(vectors), ix.of(batch.column(3).to_numpy())
            placed = np.empty((TABLES, len(u)), np.int64)
            for i in np.unique(band):
                own, part = ix.indexes[i], band == i
                placed[:, part] = _codes(_extended(x[part], own.longest), own) + i * _STRIDE
            for codes in placed:
                blocks = ix.blocks[np.searchsorted(ix.codes, codes)]
                block = (mix64(u.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
                cells = _cells(codes, block, ix.cells)
                raw = pa.array([c.tobytes() for c in codes.astype("<i4")], pa.binary())
                kind = pa.array(np.zeros(len(u), np.int32))
                yield pa.record_batch(
                    [pa.array(cells), kind, batch.column(0), batch.column(1), raw, vectors], _NAMES
                )

    return entries.select("u", "low", "vector", "length").mapInArrow(run, _KINDS)


def placed_queries(queries: DataFrame, index: Bands, least: int) -> DataFrame:
    """Each query (u, vector) in every cell that it visits, with the buckets it visits there.

    In each band, it visits ``least`` entries of each table at least.
    """
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                vectors = part.column(1).to_pylist()
                x = _matrix(part.column(1))
                by_band = [
                    [codes + i * _STRIDE for codes in probes(_aimed(x, own.longest), own, least)]
                    for i, own in enumerate(ix.indexes)
                ]
                visits = map(np.concatenate, zip(*by_band, strict=True))
                rows = []
                for u, v, codes in zip(part.column(0).to_pylist(), vectors, visits, strict=True):
                    n = ix.blocks[np.searchsorted(ix.codes, codes)]
                    each = np.repeat(codes, n)
                    block = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                    cells = _cells(each, block, ix.cells)
                    order = np.argsort(cells, kind="stable")
                    cells, each = cells[order], each[order].astype("<i4")
                    cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1), len(cells)]
                    rows += [
                        (int(cells[a]), 1, u, None, each[a:b].tobytes(), v)
                        for a, b in zip(cuts[:-1], cuts[1:], strict=True)
                    ]
                if rows:
                    yield _batch(rows)

    return queries.select("u", "vector").mapInArrow(run, _KINDS)


def _best(table: pa.Table, known: pa.Table, k: int) -> tuple[list, list, list, list]:
    """(query, candidate, low, score): the k best visited entries of a cell for each query."""
    x, entry = _matrix(known["vector"].combine_chunks()), known["u"].to_numpy()
    low = known["low"].to_numpy()
    names, bucket = np.unique(
        np.frombuffer(b"".join(known["codes"].to_pylist()), "<i4"), return_inverse=True
    )
    out: tuple[list, list, list, list] = ([], [], [], [])
    for at in range(0, table.num_rows, _QUERY_BLOCK):
        part = table.slice(at, _QUERY_BLOCK)
        q = _matrix(part["vector"].combine_chunks())
        visited = np.zeros((len(q), len(names)), bool)
        for i, raw in enumerate(part["codes"].to_pylist()):
            codes = np.frombuffer(raw, "<i4")
            place = np.searchsorted(names, codes)
            place = place[(place < len(names)) & (names[np.minimum(place, len(names) - 1)] == codes)]
            visited[i, place] = True
        score = np.where(visited[:, bucket], q @ x.T, -np.inf)
        for i, u in enumerate(part["u"].to_pylist()):
            own = score[i]
            most = k * TABLES  # an entry stands in a cell once per table at most
            if len(own) > most:
                edge = np.partition(own, len(own) - most)[len(own) - most]
                chosen = np.flatnonzero((own >= edge - 1e-9 * (1 + abs(edge))) & (own > -np.inf))
            else:
                chosen = np.flatnonzero(own > -np.inf)
            # Products of whole blocks may differ in the last bit; these do not.
            exact = (x[chosen] * q[i]).sum(1)
            order = np.lexsort((entry[chosen], low[chosen], -exact))
            same = entry[chosen[order]]
            order = order[np.concatenate(([True], same[1:] != same[:-1]))[: len(order)]][:k]
            out[0].extend([u] * len(order))
            out[1].extend(entry[chosen[order]].tolist())
            out[2].extend(low[chosen[order]].tolist())
            out[3].extend(exact[order].tolist())
    return out


def meet(placed: DataFrame, k: int) -> DataFrame:
    """(query, candidate, low, score) of the best per cell; a task holds one cell's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, entries, known = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows of one cell and kind at a time: entries come first, then queries.
            cells, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            cuts = [0, *change, batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = pa.Table.from_batches([batch.slice(a, b - a)])
                if cells[a] != cell:
                    cell, entries, known = cells[a], [], None
                if kinds[a] == 0:
                    entries.append(part)
                elif entries:
                    known = known or pa.concat_tables(entries)
                    rows = _best(part, known, k)
                    if rows[0]:
                        yield pa.record_batch(
                            [*(pa.array(r, pa.int64()) for r in rows[:3]), pa.array(rows[3], pa.float64())],
                            ["query", "candidate", "low", "score"],
                        )

    sorted_rows = placed.repartition("cell").sortWithinPartitions("cell", "kind", "u")
    return sorted_rows.mapInArrow(run, "query long, candidate long, low long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int, folder: str) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, embedding) that are queries."""
    rows = vectors.select("vec_id", F.col("embedding").alias("vector"), is_query.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), "size").first()
    size = most["size"] if most else 0
    rows = rows.where(F.size("vector") == size).withColumn("u", F.xxhash64("vector"))
    slim = saved(rows.select("vec_id", "u", "asks").distinct(), f"{folder}/rows")
    first = F.row_number().over(Window.partitionBy("u").orderBy("vec_id"))
    ids = (
        slim.select("u", "vec_id").distinct().withColumn("at", first).where(F.col("at") <= k + 1)
        .groupBy("u").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    shapes = rows.groupBy("u").agg(F.first("vector").alias("vector"))
    entries = saved(
        packed(shapes.join(ids, "u").select("u", F.col("ids")[0].alias("low"), "ids", "vector"),
               ["u", "low", "ids"]),
        f"{folder}/entries",
    )
    asked = saved(
        slim.where("asks").groupBy("u").agg(F.count("*").alias("asking")), f"{folder}/asked"
    )
    index = fit(entries, k)
    queries = asked.join(entries, "u").select("u", "vector")
    placed = placed_entries(entries, index).union(placed_queries(queries, index, k + 1))
    met = meet(placed, k + 1).groupBy("query", "candidate").agg(
        F.max("score").alias("score"), F.min("low").alias("low")
    )
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "low"))
    found = saved(
        met.withColumn("at", best).where(F.col("at") <= k + 1).select("query", "candidate", "score"),
        f"{folder}/found",
    )
    popular = saved(
        found.groupBy("candidate").agg(F.count("*").alias("times"))
        .join(entries.select(F.col("u").alias("candidate"), "ids"), "candidate"),
        f"{folder}/popular",
    )
    listed = attach(found, popular, "candidate", ["ids"], "times", found.count())
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    hits = (
        listed.select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("at", order).where(F.col("at") <= k + 1)
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("hits"))
    )
    answers = saved(
        asked.join(hits, asked["u"] == hits["query"]).select("u", "hits", "asking"),
        f"{folder}/answers",
    )
    asks = slim.where("asks").select(F.col("vec_id").alias("query_id"), "u")
    given = attach(asks, answers, "u", ["hits"], "asking", asks.count())
    others = F.filter("hits", lambda h: h["vec_id"] != F.col("query_id"))
    return (
        given.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "hit"))
        .select(
            "query_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("hit.vec_id").alias("vec_id"),
            F.col("hit.score").alias("score"),
        )
    )
