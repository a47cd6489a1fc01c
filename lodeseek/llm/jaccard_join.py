r"""Exact join of texts whose word-shingle sets have a large Jaccard index, by pivots and regions.

Texts of equal sets are one *node*. Nodes x, y link where the Jaccard distance
d(x, y) is at most D. Pivots are used on two levels.

*Outer regions.* In a fixed order of all shingles, rarest first, the pivot U(s) is
the set of all shingles from s on. The directed difference |x \\ U| obeys
|x \\ U| <= |x \\ y| + |y \\ U|. A node belongs to the region of the last pivot that
holds it whole, which is that of its first shingle. A linked y may lack up to b(x)
shingles of x, so by the inequality x is copied into all regions with
|x \\ U(s)| <= b(x): those of its first b(x) + 1 shingles. Linked nodes then meet in
a region. Regions are parted by the distance to the empty set too: a set's size, the
logarithm of which differs by a step at most in linked sets; rings of sizes span
``RING`` steps, and nodes within a step of the next ring enter it as well. (Whole documents as outermost pivots cannot part a corpus: nearly all of
it is at distance 1 from any document, inside every window. See the README.)

*Bounds.* Counting a set's shingles in ``CLASSES`` hash classes maps it to a vector
whose L1 distances never exceed |x \ y| + |y \ x|, and saturated counts keep that.
These 128 bytes, 2 KB for long texts, rule out nearly all chance meetings without a
set being moved.

*Inner regions.* In each region the most central node is the pivot p: the one that
enters by most frequent shingles, as an original does that its copies alter. Regions
of one pivot are united. Distances to p are computed for all members, first the
bounds, then exactly where those allow a link. Nodes within D of p link to it, which
joins them with each other as well, so pairs among them need no look. Beyond,
|d(x, p) - d(y, p)| <= d(x, y): a node inside D can link to one outside only if it is
within D of the nearest outside node. Those of that window and all outside nodes
form the next region, which is joined in the same way. What is left after ``ROUNDS``
rounds is compared pairwise in blocks of ``LEAF`` nodes, by bounds and then exactly.
Nodes that links found so far have joined are never compared: before each round
components are named, and regions of a single one are done.

A first pass of the same kind, with bounds only, finds the nodes that may have a
link at all; only their texts are read again, to get their sets.

The order needs no exact counts, only to be the same for all texts: frequent
shingles come from tasks that count in ``2 ** SKETCH_BITS`` counters and report the
heavy ones; the summed classes, 2 MB, go to all tasks.

Sizes: documents move once as slim rows of (id, size, node, counts, first shingles);
texts of possible partners move once more. Pairs are stars, so their number follows
the members of regions. Hot nodes, regions and pivots are dealt out
(``common.attach``). Hashes have 64 bits, nodes in addition their size. Intermediate
files go as soon as no later step reads them.

Defined cases: a null text, or one without words, has the empty set and links with
nothing; a row without id is counted but takes no part and has a null component;
repeated rows are linked like other equal sets; an empty table gives no row; a text
of any length is taken whole; extra columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import attach, mix64, release, slices
from lodeseek.llm.components import components
from lodeseek.llm.shingles import shingles
from lodeseek.workspace import discard, saved

SKETCH_BITS = 21
ROUNDS = 2
LEAF = 256
RING = 4
CLASSES = 128
LONG = 2048
LONG_CLASSES = 2048
_SLICE = 2_000_000
_NODE_KEY = np.uint64(0xA0761D6478BD642F)


def spare(n: int, percent: int) -> int:
    """How many of n shingles a linked set may lack."""
    return n - (percent * n + 99) // 100


def heavy_counters(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(counter, n) of a task's counters that stand out."""
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    shift = np.uint64(64 - SKETCH_BITS)
    for part in slices(batches, size=_SLICE):
        h, _ = shingles(part.column(0), width)
        counts += np.bincount((h >> shift).astype(np.int64), minlength=len(counts))
    at = np.flatnonzero(counts >= max(8, 4 * counts.mean()))
    if len(at):
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], ["counter", "n"])


def frequency_classes(docs: DataFrame, width: int) -> np.ndarray:
    """For each counter the binary logarithm of its reported count; 0 for all others."""
    counted = docs.select("text").mapInArrow(
        lambda batches: heavy_counters(batches, width), "counter long, n long"
    )
    rows = (
        counted.groupBy("counter")
        .agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("c"))
        .toArrow()
    )
    classes = np.zeros(1 << SKETCH_BITS, np.uint8)
    classes[rows["counter"].to_numpy()] = rows["c"].to_numpy()
    del rows
    release()
    return classes


def _class_counts(own: np.ndarray) -> bytes:
    """Numbers of a set's shingles by their lowest bits, saturated; long sets have more classes."""
    classes = CLASSES if len(own) <= LONG else LONG_CLASSES
    per = np.bincount((own & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return np.minimum(per, 255).astype(np.uint8).tobytes()


def _sets(part: pa.Array, width: int) -> Iterator[tuple[np.ndarray, int]]:
    """The sorted set of each text, and its node."""
    h, borders = shingles(part, width)
    for a, b in zip(borders[:-1], borders[1:], strict=True):
        own = np.unique(h[a:b])
        name = int(np.add.reduce(mix64(own ^ _NODE_KEY))) + len(own)
        yield own, (name + (1 << 63)) % (1 << 64) - (1 << 63)


def name_sets(docs: DataFrame, classes: np.ndarray, width: int, percent: int) -> DataFrame:
    """(doc_id, n, node, counts, heavy, first): of each document its set's facts.

    ``first`` are the shingles whose regions the node enters, ``heavy`` how many of
    them are frequent ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    shift = np.uint64(64 - SKETCH_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for part in slices(batches, size=_SLICE):
            sizes, nodes, counts, heavy, first = [], [], [], [], []
            for own, node in _sets(part.column(1), width):
                n = len(own)
                sizes.append(n)
                nodes.append(node)
                counts.append(_class_counts(own))
                take = spare(n, percent) + 1 if n else 0
                order = rank[(own >> shift).astype(np.int64)]
                if order.any():
                    own = own[np.argsort(order, kind="stable")]
                first.append(own[:take].view(np.int64))
                heavy.append(int(np.count_nonzero(np.sort(order)[:take])))
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            flat = np.concatenate(first) if first else np.empty(0, np.int64)
            yield pa.record_batch(
                [
                    part.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(counts, pa.binary()),
                    pa.array(heavy, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                ["doc_id", "n", "node", "counts", "heavy", "first"],
            )

    kinds = "doc_id long, n long, node long, counts binary, heavy long, first array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, kinds)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, items) of the wanted (doc_id, node): the set as 64-bit hashes in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, size=_SLICE):
            kept = [
                (want, own.tobytes())
                for want, (own, node) in zip(
                    part.column(0).to_pylist(), _sets(part.column(1), width), strict=True
                )
                if node == want
            ]
            if kept:
                nodes, items = zip(*kept, strict=True)
                yield pa.record_batch(
                    [pa.array(nodes, pa.int64()), pa.array(items, pa.binary())], ["node", "items"]
                )

    texts = docs.select("doc_id", "text").join(wanted, "doc_id").select("node", "text")
    # An id that occurs twice with one text gives its set twice.
    return texts.mapInArrow(run, "node long, items binary").dropDuplicates(["node"])


def centred(pairs: DataFrame, facts: DataFrame, values: list[str], path: str) -> DataFrame:
    """(pivot, node) pairs with the facts of both, those of the pivot as ``p_*``."""
    stars = saved(pairs.groupBy("pivot").agg(F.count("*").alias("pairs")), f"{path}-stars")
    total = stars.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    own = facts.select(F.col("node").alias("pivot"), *(F.col(v).alias(f"p_{v}") for v in values))
    centres = stars.join(own, "pivot")
    full = pairs.join(facts.select("node", *values), "node")
    return attach(full, centres, "pivot", [f"p_{v}" for v in values], "pairs", total)


def _gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """L1 distances of rows of class counts."""
    return np.abs(x.astype(np.int16) - y.astype(np.int16)).sum(1, dtype=np.int64)


def _counts(raw: list[bytes]) -> np.ndarray:
    """Rows of class counts, those of more classes folded to the fewest that any has."""
    width = min(map(len, raw), default=CLASSES)
    rows = [np.frombuffer(r, np.uint8) for r in raw]
    return np.array(
        [
            r if len(r) == width
            else np.minimum(r.reshape(-1, width).sum(0, dtype=np.int64), 255).astype(np.uint8)
            for r in rows
        ],
        np.uint8,
    ).reshape(len(raw), width)


def _flat_gaps(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """L1 distances of pairs of class counts, all at ``CLASSES``: one metric for all sizes."""
    short = bytes(CLASSES)
    both = [np.array([_counts([r, short])[0] for r in raw], np.uint8) for raw in (left, right)]
    return _gap(*(x.reshape(-1, CLASSES) for x in both))


def _gaps(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """L1 distances of pairs of class counts, each pair at the fewer classes of the two.

    Those of long sets are on a finer scale, so two of them do not obey the triangle
    inequality with those of shorter ones; ``_flat_gaps`` do.
    """
    out = np.empty(len(left), np.int64)
    short = np.array([len(a) == len(b) == CLASSES for a, b in zip(left, right, strict=True)], bool)
    at = np.flatnonzero(short)
    if len(at):
        out[at] = _gap(_counts([left[i] for i in at]), _counts([right[i] for i in at]))
    for i in np.flatnonzero(~short):
        pair = _counts([left[i], right[i]])
        out[i] = _gap(pair[:1], pair[1:])[0]
    return out


def _possible(gap: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``total`` shingles in all, ``gap`` or more of them unshared, may link."""
    return gap * (100 + percent) <= total * (100 - percent)


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int, path: str) -> DataFrame:
    """(pivot, node, gap, flat, total, possible) of the pairs, from class counts.

    ``gap`` is the finest bound of a pair, ``flat`` is on one scale for all pairs.
    """
    rows = centred(pairs, nodes, ["n", "counts"], path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            left, right = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            gap = _gaps(left, right)
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(gap),
                    pa.array(_flat_gaps(left, right)),
                    pa.array(total),
                    pa.array(_possible(gap, total, percent)),
                ],
                ["pivot", "node", "gap", "flat", "total", "possible"],
            )

    kinds = "pivot long, node long, gap long, flat long, total long, possible boolean"
    rows = rows.select("pivot", "node", "n", "p_n", "counts", "p_counts")
    return saved(rows.mapInArrow(run, kinds), path)


def measured(pairs: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """(pivot, node, shared, united): the exact sizes of the pairs' intersections and unions."""
    rows = centred(pairs.select("pivot", "node"), sets, ["items"], path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, united = [], []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                shared.append(both)
                united.append(len(x) + len(y) - both)
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(shared, pa.int64()),
                    pa.array(united, pa.int64()),
                ],
                ["pivot", "node", "shared", "united"],
            )

    kinds = "pivot long, node long, shared long, united long"
    return saved(rows.select("pivot", "node", "items", "p_items").mapInArrow(run, kinds), path)


def close_pairs(
    live: DataFrame, nodes: DataFrame, percent: int, names_only: bool, path: str
) -> DataFrame:
    """Pairs (pivot, node) within regions that their bounds allow, or only the nodes in them.

    A region of more than ``LEAF`` nodes is dealt out as pairs of its blocks. Rows
    arrive sorted by such cells; a task holds one cell and compares a block of rows
    with all others in numpy, except for nodes of one ``part``. Long sets are compared
    by their finer counts with each other: on the scale of shorter ones unrelated long
    sets seem near.
    """
    sized = saved(live.groupBy("region").agg(F.count("*").alias("n")).where("n > 1"), path)
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = attach(
        live.select("region", "node", "part"), sized.withColumn("size", F.col("n")), "region", ["size"], "n", total
    ).where("size > 1")
    blocks = F.ceil(F.col("size") / LEAF)
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    )
    cell = (
        placed.select(
            F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
            "node",
            "part",
        )
        .join(nodes.select("node", "n", "counts"), "node")
        .repartition("cell")
        .sortWithinPartitions("cell", "node")
    )

    def compare(
        ids: np.ndarray, part: np.ndarray, n: np.ndarray, raw: list[bytes]
    ) -> list[tuple[int, int]]:
        found = []
        if (part == part[0]).all():
            return found
        counts = _counts(raw)
        long = np.flatnonzero(np.array([len(r) for r in raw]) > counts.shape[1])
        fine = _counts([raw[i] for i in long])
        at = np.full(len(ids), -1)
        at[long] = np.arange(len(long))
        for i in range(len(ids) - 1):
            size = n[i + 1 :]
            fit = np.flatnonzero(
                (100 * np.minimum(size, n[i]) >= percent * np.maximum(size, n[i]))
                & (part[i + 1 :] != part[i])
            )
            if len(fit):
                gap = _gap(counts[i + 1 + fit], counts[i])
                fit = fit[_possible(gap, size[fit] + n[i], percent)]
                if at[i] >= 0:
                    other = at[i + 1 + fit]
                    gap = _gap(fine[other], fine[at[i]])
                    fit = fit[(other < 0) | _possible(gap, size[fit] + n[i], percent)]
                for j in fit:
                    found.append((int(ids[i]), int(ids[i + 1 + j])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cells = table["cell"].to_numpy()
            ids, n, part = (table[c].to_numpy() for c in ("node", "n", "part"))
            raw = table["counts"].to_pylist()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1), len(cells)]
            pairs = {
                pair
                for a, b in zip(cuts[:-1], cuts[1:], strict=True)
                for pair in compare(ids[a:b], part[a:b], n[a:b], raw[a:b])
            }
            if names_only:
                rows = [[x for x in {x for pair in pairs for x in pair}]]
            else:
                rows = [[p[0] for p in pairs], [p[1] for p in pairs]]
            if rows[0]:
                names = ["node"] if names_only else ["pivot", "node"]
                yield pa.record_batch([pa.array(r, pa.int64()) for r in rows], names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            cells = table["cell"].to_numpy()
            last = int(np.searchsorted(cells == cells[-1], True))
            if last:
                yield from emit(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held))

    kinds = "node long" if names_only else "pivot long, node long"
    return cell.mapInArrow(run, kinds).distinct()


def stars(live: DataFrame, path: str) -> tuple[DataFrame, int]:
    """(region, node, weight, part, pivot, own_part) of all members but the pivots.

    ``live`` has (region, node, weight, part); ``own_part`` is the pivot's. Also the
    number of its rows in regions of more than one node.
    """
    pivots = saved(
        live.groupBy("region")
        .agg(F.max(F.struct("weight", "node", "part")).alias("top"), F.count("*").alias("n"))
        .where("n > 1")
        .select(
            "region", F.col("top.node").alias("pivot"), F.col("top.part").alias("own_part"), "n"
        ),
        f"{path}-pivots",
    )
    total = pivots.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = attach(live, pivots, "region", ["pivot", "own_part"], "n", total).where(
        F.col("pivot").isNotNull() & (F.col("pivot") != F.col("node"))
    )
    return saved(members, f"{path}-members"), total


def parted(live: DataFrame, parts: DataFrame, path: str) -> DataFrame:
    """``live`` with the ``part`` of each node (its own where ``parts`` has none), in regions of several."""
    placed = saved(
        live.select("region", "node", "weight")
        .join(parts, "node", "left")
        .withColumn("part", F.coalesce("part", "node")),
        f"{path}-placed",
    )
    several = saved(
        placed.groupBy("region")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
        .where("low <> high")
        .select("region", "n", F.col("n").alias("size")),
        f"{path}-several",
    )
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kept = attach(placed, several, "region", ["size"], "n", total).where("size > 0")
    return saved(kept.select("region", "node", "weight", "part"), f"{path}-parted")


def beyond(
    apart: DataFrame, total: int, measure: str, reach: Column, path: str
) -> DataFrame:
    """What a region still has to join: nodes outside of the pivot's reach, and the window.

    ``apart`` has (region, node, weight, outside) and the distance ``measure`` from the
    pivot, null where it was not measured; ``reach`` is the largest distance of a link.
    """
    nearest = saved(
        apart.groupBy("region")
        .agg(
            F.min(F.when(F.col("outside"), F.col(measure))).alias("nearest"),
            reach.alias("reach"),
            F.count("*").alias("n"),
        )
        .where("nearest IS NOT NULL AND n > 1")
        .withColumn("edge", F.col("nearest") - F.col("reach")),
        f"{path}-nearest",
    )
    return saved(
        attach(apart, nearest, "region", ["edge"], "n", total)
        .where(F.col("edge").isNotNull())
        .where(F.col("outside") | F.col(measure).isNull() | (F.col(measure) >= F.col("edge")))
        .select("region", "node", "weight"),
        f"{path}-live",
    )


def distinct_nodes(named: DataFrame, path: str) -> DataFrame:
    """(node, doc_id, n, counts, heavy, first) of each node of ``name_sets``, its least doc_id."""
    return saved(
        named.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n").alias("n"),
            F.first("counts").alias("counts"),
            F.first("heavy").alias("heavy"),
            F.first("first").alias("first"),
        ),
        path,
    )


def linked_nodes(
    docs: DataFrame, nodes: DataFrame, folder: str, width: int, percent: int, rounds: int
) -> DataFrame:
    """Links (u, v) that join all nodes of a component.

    ``nodes`` are the ``distinct_nodes`` at ``folder``/nodes, which go with the first step.
    """

    def drop(*names: str) -> None:
        for name in names:
            discard(docs.sparkSession, f"{folder}/{name}")

    # Sizes of linked sets differ by one step at most; each ring has RING steps.
    at = F.log(F.col("n").cast("double")) / math.log(100 / percent)
    ring = F.floor(at / RING)
    near_end = at - ring * RING >= RING - 1 - 1e-6
    rings = F.when(near_end, F.array(ring, ring + 1)).otherwise(F.array(ring))
    placed = nodes.withColumn("rings", rings)
    each = F.transform("rings", lambda r: F.transform("first", lambda s: F.xxhash64(s, r)))
    entries = placed.select("node", "heavy", F.explode(F.flatten(each)).alias("entry"))
    sizes = saved(
        entries.groupBy("entry")
        .agg(F.count("*").alias("size"), F.max(F.struct("heavy", "node")).alias("top"))
        .where("size > 1")
        .select("entry", "size", F.col("top.node").alias("pivot")),
        f"{folder}/sizes",
    )
    total = placed.agg(
        F.coalesce(F.sum(F.size("first") * F.size("rings")), F.lit(0))
    ).first()[0]
    met = attach(entries, sizes, "entry", ["pivot"], "size", total).where("pivot IS NOT NULL")
    # Regions of one pivot are one region: pairs that met still meet, in fewer rows.
    central = saved(
        met.groupBy("node").agg(
            F.collect_set("pivot").alias("regions"), F.first("heavy").alias("weight")
        ),
        f"{folder}/met",
    )
    facts = saved(nodes.select("node", "doc_id", "n", "counts"), f"{folder}/facts")
    drop("nodes", "sizes")

    def regions(of: DataFrame) -> DataFrame:
        return of.select(
            F.explode("regions").alias("region"), "node", "weight", F.col("node").alias("part")
        )

    # Which nodes may have a link at all, by bounds.
    members, total = stars(regions(central), f"{folder}/first")
    bounds = bounded(
        members.select("pivot", "node").distinct(), facts, percent, f"{folder}/first-bounds"
    )
    apart = members.join(bounds, ["pivot", "node"]).withColumn("outside", ~F.col("possible"))
    widest = F.max("total") * ((100 - percent) / (100 + percent)) * 2
    # Windows compare distances of different pairs, so these must be on one scale.
    live = beyond(apart, total, "flat", widest, f"{folder}/first")
    near = bounds.where("possible")
    sure = near.select("node").union(near.select("pivot")).distinct()
    # Nodes that are wanted anyway need no comparison with each other.
    live = parted(live, sure.withColumn("part", F.lit(0).cast("long")), f"{folder}/first")
    wanted = (
        sure.union(close_pairs(live, facts, percent, True, f"{folder}/first-cells"))
        .distinct()
    )
    wanted = saved(
        wanted.join(facts.select("node", "doc_id"), "node"), f"{folder}/wanted"
    )
    passing = ["members", "pivots", "bounds", "bounds-stars", "nearest", "live", "placed", "several", "parted"]
    drop(*(f"first-{name}" for name in (*passing, "cells")))

    # The links themselves, exactly.
    sets = saved(sets_of(docs, wanted, width), f"{folder}/sets")
    live = regions(central.join(wanted.select("node"), "node"))
    links = []
    for step in range(rounds):
        at = f"{folder}/round{step}"
        members, total = stars(live, at)
        if not total:
            break
        pairs = members.where("part <> own_part").select("pivot", "node").distinct()
        bounds = bounded(pairs, facts, percent, f"{at}-bounds")
        exact = measured(bounds.where("possible"), sets, f"{at}-measured")
        linked = F.col("shared") * 100 >= F.col("united") * percent
        links.append(exact.where(linked).select(F.col("pivot").alias("u"), F.col("node").alias("v")))
        least = 2 * F.col("gap") / (F.col("total") + F.col("gap"))
        far = bounds.join(exact, ["pivot", "node"], "left").select(
            "pivot",
            "node",
            F.coalesce(1 - F.col("shared") / F.col("united"), least).alias("d"),
            (~F.coalesce(linked, F.lit(False))).alias("outside"),
        )
        # Members of the pivot's own part have no distance and stay while others do.
        apart = members.join(far, ["pivot", "node"], "left").withColumn(
            "outside", F.coalesce("outside", F.lit(False))
        )
        # The slack covers the rounding of a difference of doubles.
        live = beyond(apart, total, "d", F.lit(1 - percent / 100 + 1e-9), at)
        roots = components(functools.reduce(DataFrame.union, links), f"{at}-components")
        live = parted(live, roots.withColumnRenamed("root", "part"), at)
        drop(*(f"round{step}-{name}" for name in (*passing[:-1], "measured-stars", "components")))
        if step:
            drop(f"round{step - 1}-parted")
    last = close_pairs(live, facts, percent, False, f"{folder}/last-cells")
    exact = measured(saved(last, f"{folder}/last"), sets, f"{folder}/last-measured")
    links.append(
        exact.where(F.col("shared") * 100 >= F.col("united") * percent).select(
            F.col("pivot").alias("u"), F.col("node").alias("v")
        )
    )
    return functools.reduce(DataFrame.union, links)


def jaccard_groups(
    docs: DataFrame, folder: str, width: int = 5, percent: int = 80, rounds: int = ROUNDS
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text).

    Texts link where 100 * |intersection| >= percent * |union| of their sets of
    ``width``-word shingles; a component's id is its smallest doc_id.
    """
    classes = frequency_classes(docs, width)
    wide = saved(name_sets(docs, classes, width, percent), f"{folder}/wide")
    named = saved(wide.select("doc_id", "n", "node"), f"{folder}/named")
    nodes = distinct_nodes(wide, f"{folder}/nodes")
    discard(docs.sparkSession, f"{folder}/wide")
    links = linked_nodes(docs, nodes, folder, width, percent, rounds)
    roots = components(links, f"{folder}/components")
    nodes = named.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("low"), F.count("*").alias("copies")
    )
    placed = saved(
        nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")),
        f"{folder}/placed",
    )
    lowest = saved(
        placed.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("nodes")),
        f"{folder}/lowest",
    )
    count = lowest.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]
    answers = saved(
        attach(placed, lowest, "root", ["component_id"], "nodes", count).select(
            "node", "component_id", "copies"
        ),
        f"{folder}/answers",
    )
    # Texts without a set, and rows without id, look for no node.
    key = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node"))
    rows = named.select("doc_id", F.col("n").alias("n_shingles"), key.alias("node"))
    out = attach(rows, answers, "node", ["component_id"], "copies", named.count())
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id"))
        .otherwise(F.col("doc_id"))
        .alias("component_id"),
    )


def representatives(
    docs: DataFrame, folder: str, width: int = 5, percent: int = 80, rounds: int = ROUNDS
) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id is the smallest of their component.

    Rows without id, and texts without words, stay. An id that stands on several rows
    is one document: its rows go when one of them does.
    """
    groups = jaccard_groups(docs.select("doc_id", "text"), f"{folder}/groups", width, percent, rounds)
    gone = saved(
        groups.where(F.col("component_id") < F.col("doc_id"))
        .select(F.col("doc_id").alias("_copy_id"))
        .distinct(),
        f"{folder}/gone",
    )
    discard(docs.sparkSession, f"{folder}/groups")
    return docs.join(gone, docs["doc_id"] == gone["_copy_id"], "left_anti")
