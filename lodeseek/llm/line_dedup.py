"""Line dedup by deletion neighbourhoods: a line goes where an earlier one is within an edit.

Lines are the parts of a text between line breaks; blank lines (ASCII white space only)
take no part. The order of lines is (doc_id, line number). A line is removed if an
earlier line is equal, or, both having ``LEAST`` characters or more, at Levenshtein
distance 1 (in code points). So each group keeps its earliest line.

* Equal lines: one aggregation of 128-bit names gives each line's first occurrence.
* Near lines: one edit leaves the first or the second half of a line as it is. Lines
  that share neither half, at matching lengths, with another line have no neighbour;
  this leaves few. Those emit all their variants with one character deleted in the
  other half, and themselves, as hashed keys. Equal variants deleted at one place are
  one substitution apart, and a variant that equals a whole line is one insertion
  apart. In each group of equal keys every line looks at the earliest only, so groups
  of any size stay linear, and the texts of such pairs are then compared.

Names of lines, not lines, are shuffled; only candidates carry their text. Hot lines
are dealt out when their occurrences look up the first one (``common.attach``).

Defined cases: a null text stays null, an empty one empty; a row without id comes
after all others; rows that repeat id and text get equal results; rows that share an
id are told apart by their text's hash; lines of any length take part; all columns
of the input are kept, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import attach, mix64
from lodeseek.workspace import saved

LEAST = 10
_VISIBLE = r"[^ \t\r\x0B\f]"
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE, _WHOLE = _U(0xD1B54A32D192ED03), _U(0xABC98388FB8FAC03)


def occurrences(docs: DataFrame) -> DataFrame:
    """(id, mark, line_no, line): the lines that take part; id and mark tell rows apart."""
    return docs.select(
        _id().alias("id"),
        F.xxhash64("text").alias("mark"),
        F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"),
    ).where(F.col("line").rlike(_VISIBLE))


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def half_keys() -> list[Column]:
    """(size, side, half) structs of a ``line`` of ``n`` characters: the keys of its halves.

    ``size`` is the length of the shorter line of a pair: a line stands for itself as
    the shorter or equal one, and for one character less as the longer one.
    """
    keys = []
    for less in (0, 1):
        size = f"(n - {less})"
        first = F.expr(f"substring(line, 1, {size} div 2)")
        second = F.expr(f"substring(line, n - ({size} - {size} div 2) + 1, {size} - {size} div 2)")
        for side, part in ((0, first), (1, second)):
            half = F.xxhash64(F.lit(side), F.expr(size), part)
            keys.append(
                F.struct(F.expr(size).alias("size"), F.lit(side).alias("side"), half.alias("half"))
            )
    return keys


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def variants(line: str, size: int, side: int, half: int) -> tuple[np.ndarray, bool]:
    """Hashed keys of a candidate's variants; also whether the last is the line as a whole."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    power = _powers(1 << max(10, int(n).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate(
            ([_U(0)], np.cumsum(mix64(points.astype(np.uint64) + _BASE) * power[:n], dtype=np.uint64))
        )
        # One edit outside of the shared half.
        place = np.arange(size // 2, n) if side == 0 else np.arange(n - (size - size // 2))
        hashes = sums[place] + (sums[-1] - sums[place + 1]) * _INVERSE
        key = mix64(np.array([half], np.int64).view(np.uint64))[0]
        if n == size:
            equal = mix64(mix64(hashes ^ key) + place.astype(np.uint64) * _PLACE)
            own = mix64(mix64(sums[-1:] ^ key) + _WHOLE)
            return np.concatenate((equal, own)), True
        return mix64(mix64(hashes ^ key) + _WHOLE), False


def neighbour_keys(candidates: DataFrame) -> DataFrame:
    """(key, kind, name): kind 0 meets its like, 1 is a whole line, 2 a longer line's variant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, line, size, side, half in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                keys, whole = variants(line, size, side, half)
                kind = np.full(len(keys), 0 if whole else 2, np.int8)
                if whole:
                    kind[-1] = 1
                # One batch per line: a line may be very long.
                yield pa.record_batch(
                    [
                        pa.array(keys.view(np.int64)),
                        pa.array(kind),
                        pa.array([name] * len(keys), pa.binary()),
                    ],
                    ["key", "kind", "name"],
                )

    rows = candidates.select("name", "line", "size", "side", "half")
    return rows.mapInArrow(run, "key long, kind tinyint, name binary")


def near_lines(lines: DataFrame, firsts: DataFrame, folder: str) -> DataFrame:
    """(name): distinct lines with an earlier line at distance 1."""
    long = lines.select("line", F.length("line").alias("n")).where(F.col("n") >= LEAST)
    # A hash tells different lines of one half apart; lines themselves are not copied.
    halves = F.array(*(k["half"] for k in half_keys()))
    slim = long.select(F.xxhash64("line").alias("own"), F.explode(halves).alias("half"))
    shared = saved(
        slim.groupBy("half")
        .agg(F.min("own").alias("low"), F.max("own").alias("high"))
        .where("low <> high")
        .select("half"),
        f"{folder}/halves",
    )
    candidates = saved(
        long.select("line", F.inline(F.array(*half_keys())))
        .join(shared, "half")
        .select(F.unhex(F.md5("line")).alias("name"), "half", "side", "size", "line")
        .groupBy("name", "half", "side", "size")
        .agg(F.first("line").alias("line")),
        f"{folder}/candidates",
    )
    variant = neighbour_keys(candidates)
    met = saved(
        variant.groupBy("key")
        .agg(F.min("name").alias("low"), F.max("name").alias("high"))
        .where("low <> high")
        .select("key"),
        f"{folder}/met",
    )
    placed = saved(
        variant.join(met, "key").distinct().join(firsts.select("name", "first"), "name"),
        f"{folder}/placed",
    )
    groups = saved(
        placed.groupBy("key").agg(
            F.min(F.when(F.col("kind") == 0, F.struct("first", "name"))).alias("equal"),
            F.min(F.when(F.col("kind") == 1, F.struct("first", "name"))).alias("whole"),
            F.min(F.when(F.col("kind") == 2, F.struct("first", "name"))).alias("longer"),
            F.count("*").alias("n"),
        ),
        f"{folder}/groups",
    )
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seen = attach(placed, groups, "key", ["equal", "whole", "longer"], "n", total)
    other = (
        F.when(F.col("kind") == 0, F.col("equal"))
        .when(F.col("kind") == 1, F.col("longer"))
        .otherwise(F.col("whole"))
    )
    pairs = (
        seen.withColumn("other", other)
        .where(F.col("other.first") < F.col("first"))
        .select("name", F.col("other.name").alias("earlier"))
        .distinct()
    )
    texts = candidates.groupBy("name").agg(F.first("line").alias("line"))
    compared = pairs.join(texts, "name").join(
        texts.select(F.col("name").alias("earlier"), F.col("line").alias("earlier_line")), "earlier"
    )
    near = F.levenshtein("line", "earlier_line", 1)
    return compared.where(near.between(0, 1)).select("name").distinct()


def removed_lines(docs: DataFrame, folder: str) -> DataFrame:
    """(id, mark, removed): the numbers of the removed lines of each row that has any."""
    lines = occurrences(docs)
    place = F.struct("id", "line_no", "mark")
    slim = saved(
        lines.select(F.unhex(F.md5("line")).alias("name"), "id", "line_no", "mark"),
        f"{folder}/lines",
    )
    firsts = saved(
        slim.groupBy("name").agg(F.min(place).alias("first"), F.count("*").alias("n")),
        f"{folder}/firsts",
    )
    near = near_lines(lines, firsts, folder).withColumn("near", F.lit(True))
    verdicts = saved(
        firsts.join(near, "name", "left")
        .withColumn("near", F.coalesce("near", F.lit(False)))
        .where(F.col("near") | (F.col("n") > 1)),
        f"{folder}/verdicts",
    )
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    judged = attach(slim, verdicts, "name", ["first", "near"], "n", total)
    gone = judged.where(F.col("first").isNotNull() & (F.col("near") | (place != F.col("first"))))
    # Rows that repeat id and text name the same lines twice.
    return gone.groupBy("id", "mark").agg(F.collect_set("line_no").alias("removed"))


def dedup_lines(docs: DataFrame, folder: str, drop_empty: bool = False) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``, and their number as ``_removed``.

    Where the table has a column of that name, the number's gets one more ``_``. With ``drop_empty``, rows go that lost lines and have only blank ones left, and
    the columns are those of ``docs``.
    """
    gone = saved(removed_lines(docs, folder), f"{folder}/removed")
    # The columns of the table go along in one, so that no name of theirs can clash.
    own = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"),
        F.col("text"),
        _id().alias("id"),
        F.xxhash64("text").alias("mark"),
    )
    joined = own.join(gone, ["id", "mark"], "left")
    lines = F.when(F.col("removed").isNotNull(), F.split("text", "\n", -1))
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(
        F.array_except(numbers, F.col("removed")), lambda i: F.get(F.col("lines"), i)
    )
    rest = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("lines", lines).withColumn("rest", rest)
    if drop_empty:
        visible = _VISIBLE.replace("^", r"^\n")
        out = out.where(F.col("removed").isNull() | F.col("rest").rlike(visible))
    columns = [
        F.col("rest").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    if not drop_empty:
        name = "_removed"
        while name in docs.columns:
            name += "_"
        columns.append(F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias(name))
    return out.select(*columns)
