"""The chunk table: Parquet files by bucket, changed by appending, committed atomically.

Layout below the table path:

    data/commit=N/gen=G/bucket=B/*.parquet     rows that commit N added
    deletes/commit=N/gen=G/bucket=B/*.parquet  (path, id) of older rows that it took away
    commits/commit=N/*.json                    what commit N did to its buckets
    states/commit=N/*.json                     all buckets after commit N, now and then

**Merge on read.** A commit writes the rows that are new and the names of those that are
gone: a path, or a path and an id. A row counts if no later commit names it. So the bytes
written follow the change and not the table. Names are few by rule: where those of all
live buckets would pass ``DELETE_KEYS``, the commit rewrites the buckets it deletes from
instead. A reader therefore broadcasts them. A bucket whose dead rows outnumber its live
ones, or that lies in over ``MAX_SEGMENTS`` pieces, is rewritten after the commit.

**Linear hashing.** With ``n`` buckets, a path's is its hash modulo the next power-of-two
multiple of the first number of buckets, less half of that where there is no such bucket
yet. When buckets hold over ``bucket_rows`` rows on average, as many are added as it
takes, and only the buckets that they part from are rewritten. So a bucket stays within a
factor of two of the others however the table grows, and no growth rewrites it all.

**Batches.** A commit may name the stream and the number of the batch that it applies.
A batch whose number the table has already seen of that stream is not applied again.

Readers see a commit whole or not at all: a job that dies halfway leaves files that no
record refers to. Every commit writes into folders of its own, so that of two writers
which began with the same state the second fails at its record and harms nothing. There
must be one writer at a time.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.ident import linear_bucket, linear_home
from lodeseek.operators.merge import live_rows, orphan_paths
from lodeseek.schemas import STORED_COLUMNS, STORED_SCHEMA
from lodeseek.workspace import discard, saved, work_path

# Names of deleted rows that a reader may have to broadcast, some 20 MB of them.
DELETE_KEYS = 200_000
# Pieces of a bucket after which it is made one again.
MAX_SEGMENTS = 16
# Rows per bucket on average; more buckets are added beyond it.
BUCKET_ROWS = 200_000
# A state of all buckets is written after so many commits.
STATE_EVERY = 16

_KEY_SCHEMA = T.StructType(
    [T.StructField("path", T.StringType()), T.StructField("id", T.StringType())]
)
_PLACE = [
    T.StructField("commit", T.LongType()),
    T.StructField("gen", T.StringType()),
    T.StructField("bucket", T.IntegerType()),
]
_FILE_SCHEMA = T.StructType([*STORED_SCHEMA.fields, *_PLACE])
_DELETE_SCHEMA = T.StructType([*_KEY_SCHEMA.fields, *_PLACE])

# Table path -> (commit, state) as last read by this process.
_STATES: dict[str, tuple[int, State]] = {}


@dataclass
class Bucket:
    """Where a bucket's rows and deletes lie, as (commit, gen), and how many rows are live."""

    rows: list[tuple[int, str]] = field(default_factory=list)
    deletes: list[tuple[int, str]] = field(default_factory=list)
    written: int = 0
    live: int = 0
    keys: int = 0


@dataclass
class State:
    base: int
    buckets: int
    of: dict[int, Bucket] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)  # stream -> its last batch

    @property
    def live(self) -> int:
        return sum(b.live for b in self.of.values())

    @property
    def keys(self) -> int:
        return sum(b.keys for b in self.of.values())

    def apply(self, entries: list[dict]) -> None:
        """What a commit did: its entries hold a bucket's new pieces and numbers."""
        for e in entries:
            self.base, self.buckets, self.applied = e["base"], e["buckets"], e["applied"]
            if e["bucket"] < 0:
                continue
            if e["whole"] or e["bucket"] not in self.of:
                self.of[e["bucket"]] = Bucket()
            own = self.of[e["bucket"]]
            own.rows += [tuple(x) for x in e["rows"]]
            own.deletes += [tuple(x) for x in e["deletes"]]
            own.written, own.live, own.keys = e["written"], e["live"], e["keys"]

    def entries(self) -> list[dict]:
        return [
            _entry(self, bucket, b, b.rows, b.deletes, True) for bucket, b in self.of.items()
        ] or [_entry(self, -1, Bucket(), [], [], False)]


def _entry(state: State, bucket: int, b: Bucket, rows, deletes, whole: bool) -> dict:
    return {
        "base": state.base,
        "buckets": state.buckets,
        "applied": state.applied,
        "bucket": bucket,
        "rows": rows,
        "deletes": deletes,
        "written": b.written,
        "live": b.live,
        "keys": b.keys,
        "whole": whole,
    }


class ChunkTable:
    def __init__(
        self, spark: SparkSession, path: str, buckets: int = 64, bucket_rows: int = BUCKET_ROWS
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.bucket_rows = bucket_rows
        self._new_buckets = buckets

    # -- state ------------------------------------------------------------

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, folder: str, done: bool = False) -> list[int]:
        """Numbers of begun commits below a folder, or of finished ones."""
        fs, p = self._hadoop(f"{self.path}/{folder}")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        found = sorted(int(n[7:]) for n in names if n.startswith("commit="))
        if not done:
            return found
        return [n for n in found if fs.exists(self._hadoop(f"{self.path}/{folder}/commit={n}/_SUCCESS")[1])]

    def _commits(self) -> list[int]:
        """Numbers of all begun commits."""
        return self._numbers("commits")

    def exists(self) -> bool:
        return bool(self._commits())

    def check_writable(self) -> None:
        """Fail before any work is done if nothing can be written here."""
        fs, p = self._hadoop(f"{self.path}/.write-test")
        try:
            fs.create(p, True).close()
            fs.delete(p, False)
        except Exception as e:
            raise RuntimeError(f"table path not writable: {self.path}: {e}") from e

    def _current(self) -> State:
        """The buckets as the latest finished commit left them.

        The state is kept for as long as no commit follows the one it was read from, so
        that a search need not read the records again; otherwise the last written state
        and the commits behind it are read.
        """
        begun = self._commits()
        if not begun:
            return State(self._new_buckets, self._new_buckets)
        known = _STATES.get(self.path)
        if known and known[0] == begun[-1]:
            return known[1]
        state = State(self._new_buckets, self._new_buckets)
        written = self._numbers("states", done=True)
        first = -1
        if written:
            first = written[-1]
            state.apply(self._read_entries([f"{self.path}/states/commit={first}"])[first])
        later = self._read_entries([f"{self.path}/commits/commit={n}" for n in begun if n > first])
        for number in sorted(later):
            state.apply(later[number])
        if begun[-1] in later or begun[-1] == first:
            _STATES[self.path] = (begun[-1], state)
        return state

    def _read_entries(self, folders: list[str]) -> dict[int, list[dict]]:
        """Entries by commit; folders of commits that did not finish hold none."""
        if not folders:
            return {}
        out: dict[int, list[dict]] = {}
        for r in self.spark.read.text(folders, wholetext=False).collect():
            entry = json.loads(r["value"])
            out.setdefault(entry["commit"], []).append(entry)
        return out

    @property
    def buckets(self) -> int:
        return self._current().buckets

    def _next_commit(self) -> int:
        # A number that a dead job began is not used again.
        return max(self._commits(), default=-1) + 1

    def bucket_of(self, path: Column, state: State | None = None) -> Column:
        state = state or self._current()
        return linear_bucket(path, state.base, state.buckets)

    # -- reads ------------------------------------------------------------

    def read(self, only: Iterable[int] | None = None) -> DataFrame:
        """Stored rows plus their bucket, of all or of the given buckets."""
        state = self._current()
        wanted = state.of if only is None else {b: state.of[b] for b in only if b in state.of}
        dirs = self._dirs("data", wanted, "rows")
        if not dirs:
            return self.spark.createDataFrame([], _FILE_SCHEMA).drop("commit", "gen")
        rows = self._parquet("data", _FILE_SCHEMA, dirs)
        gone = self._dirs("deletes", wanted, "deletes")
        if gone:
            rows = live_rows(rows, self._parquet("deletes", _DELETE_SCHEMA, gone))
        return rows.drop("commit", "gen")

    def _dirs(self, kind: str, wanted: dict[int, Bucket], part: str) -> list[str]:
        return [
            f"{self.path}/{kind}/commit={commit}/gen={gen}/bucket={b}"
            for b, own in wanted.items()
            for commit, gen in getattr(own, part)
        ]

    def _parquet(self, kind: str, schema: T.StructType, dirs: list[str]) -> DataFrame:
        return (
            self.spark.read.schema(schema)
            .option("basePath", f"{self.path}/{kind}")
            .parquet(*dirs)
        )

    def rows(self) -> DataFrame:
        return self.read().drop("bucket")

    def paths(self) -> DataFrame:
        return self.read().select("path").distinct()

    def of_paths(self, paths: DataFrame) -> DataFrame:
        """Rows of the buckets that the given paths fall into; others are not listed."""
        return self.read(self.touched(paths)).drop("bucket")

    def touched(self, paths: DataFrame) -> list[int]:
        """Buckets of the given paths; never more than the table has."""
        bucket = self.bucket_of(F.col("path")).alias("bucket")
        return [r["bucket"] for r in paths.select(bucket).distinct().collect()]

    def stats(self) -> dict:
        """Row count from the commit records, without a scan."""
        return {"rows": self._current().live, "table": self.path.rsplit("/", 1)[-1]}

    # -- commits ----------------------------------------------------------

    def create(self) -> None:
        """An empty table, so that later reads find one."""
        if not self.exists():
            self._record(0, State(self._new_buckets, self._new_buckets), [])

    def has_batch(self, batch: tuple[str, int]) -> bool:
        """Whether the table has this batch (stream, number) of a stream, or a later one."""
        return self._current().applied.get(batch[0], -1) >= batch[1]

    def change(
        self,
        rows: DataFrame | None,
        keys: DataFrame | None,
        batch: tuple[str, int] | None = None,
    ) -> int:
        """Commit new `rows`, and take away the stored rows that `keys` (path, id) name.

        A key without an id names all rows of its path. Both tables are read more than
        once. A `batch` that the table has is left alone. Returns the number of new rows.
        """
        if batch and self.has_batch(batch):
            return 0
        state = self._current()
        if batch:
            state = replace(state, applied={**state.applied, batch[0]: batch[1]})
        commit, gen = self._next_commit(), uuid.uuid4().hex
        work = work_path(self.spark, "change")
        try:
            hits = self._hits(state, keys, work) if keys is not None and state.live else {}
            names = sum(n for n, _ in hits.values())
            whole = set(hits) if state.keys + names > DELETE_KEYS else set()
            found = self.spark.read.schema("bucket int, path string, id string").parquet(f"{work}/hits") if hits else None
            counts: dict[int, int] = {}
            if whole:
                kept = self._without(state, found, whole)
                rows = kept if rows is None else kept.unionByName(rows.select(*STORED_COLUMNS))
            elif hits:
                self._write("deletes", found.select("path", "id"), commit, gen, state)
            if rows is not None:
                counts = self._write("data", rows.select(*STORED_COLUMNS), commit, gen, state)
            entries = []
            for b in sorted({*counts, *hits}):
                old = state.of.get(b, Bucket())
                n_keys, n_dead = hits.get(b, (0, 0))
                n = counts.get(b, 0)
                if b in whole:
                    new = Bucket(written=n, live=n)
                else:
                    new = Bucket(
                        written=old.written + n, live=old.live + n - n_dead, keys=old.keys + n_keys
                    )
                place = [(commit, gen)]
                deletes = place if b in hits and b not in whole else []
                entries.append(_entry(state, b, new, place if n else [], deletes, b in whole))
            if entries or batch:
                self._record(commit, state, entries)
                self._tend()
        finally:
            discard(self.spark, work)
        return sum(counts.values()) - sum(state.of[b].live - hits[b][1] for b in whole)

    def _hits(self, state: State, keys: DataFrame, work: str) -> dict[int, tuple[int, int]]:
        """Per bucket the numbers of keys that name live rows, and of these rows; keys are saved.

        Only paths and ids of the stored rows are read and joined.
        """
        keys = saved(
            keys.select(self.bucket_of(F.col("path"), state).alias("bucket"), "path", "id").distinct(),
            f"{work}/keys",
        )
        touched = [r["bucket"] for r in keys.select("bucket").distinct().collect()]
        stored = self.read(b for b in touched if state.of.get(b, Bucket()).live)
        slim = stored.select("bucket", "path", "id")
        by_path = keys.where("id IS NULL").select("path", F.lit(True).alias("_all"))
        by_id = keys.where("id IS NOT NULL").select("path", "id", F.lit(True).alias("_one"))
        named = (
            slim.join(by_path, "path", "left")
            .join(by_id, ["path", "id"], "left")
            .where("_all OR _one")
            .groupBy("bucket", "path", F.when(F.col("_all").isNull(), F.col("id")).alias("id"))
            .agg(F.count("*").alias("n"))
        )
        named = saved(named, f"{work}/hits")
        each = named.groupBy("bucket").agg(F.count("*"), F.sum("n")).collect()
        return {r[0]: (r[1], r[2]) for r in each}

    def _without(self, state: State, keys: DataFrame, buckets: Iterable[int]) -> DataFrame:
        """Live rows of some buckets that no key names, without shuffling them.

        Buckets are taken in groups whose keys may be broadcast.
        """
        per = {r["bucket"]: r["count"] for r in keys.groupBy("bucket").count().collect()}
        groups: list[list[int]] = []
        room = 0
        for b in sorted(buckets):
            if not groups or room < per.get(b, 0):
                groups.append([])
                room = DELETE_KEYS
            groups[-1].append(b)
            room -= per.get(b, 0)
        out = None
        for group in groups:
            named = keys.where(F.col("bucket").isin(group)).select(
                "path", "id", F.lit(1 << 62).alias("commit")
            )
            small = sum(per.get(b, 0) for b in group) <= DELETE_KEYS
            # A single bucket with more keys is joined by a shuffle.
            part = live_rows(self.read(group).withColumn("commit", F.lit(0)), named, small)
            part = part.select(*STORED_COLUMNS)
            out = part if out is None else out.unionByName(part)
        return out

    def _write(self, kind: str, rows: DataFrame, commit: int, gen: str, state: State) -> dict[int, int]:
        """Write rows or keys by bucket; the numbers of rows come from the files' footers."""
        out = rows.withColumn("bucket", self.bucket_of(F.col("path"), state))
        order = ["bucket", "path", *(["start_line"] if kind == "data" else [])]
        folder = f"{self.path}/{kind}/commit={commit}/gen={gen}"
        # Rows are brought together by bucket for few, large files; adaptive
        # execution splits a bucket that a hot path makes too large for a task. Names are
        # so few that it would leave one task to write the files of all buckets, and so
        # bounded that a task can take those of a hot path.
        if kind == "deletes":
            tasks = 2 * self.spark.sparkContext.defaultParallelism
            dealt = out.repartition(min(state.buckets, tasks), "bucket")
        else:
            dealt = out.hint("rebalance", "bucket")
        (
            dealt.sortWithinPartitions(*order)
            .write.mode("errorifexists")
            .partitionBy("bucket")
            .parquet(folder)
        )
        schema = T.StructType([*rows.schema.fields, _PLACE[2]])
        counted = self.spark.read.schema(schema).parquet(folder).groupBy("bucket").count()
        return {r["bucket"]: r["count"] for r in counted.collect()}

    def _record(self, commit: int, state: State, entries: list[dict]) -> None:
        """Make a commit visible: its entries, and from time to time the state after it."""
        entries = entries or [_entry(state, -1, Bucket(), [], [], False)]
        self._write_entries(f"{self.path}/commits/commit={commit}", commit, entries)
        known, begun = _STATES.get(self.path), self._commits()
        if known and len(begun) > 1 and known[0] == begun[-2] and commit == begun[-1]:
            # This process has the state before, so the records need not be read again.
            after = copy.deepcopy(known[1])
            after.apply(json.loads(json.dumps(entries)))
            _STATES[self.path] = (commit, after)
        written = self._numbers("states", done=True)
        if commit - max(written, default=0) >= STATE_EVERY:
            folder = f"{self.path}/states/commit={commit}"
            self._write_entries(folder, commit, self._current().entries())

    def _write_entries(self, folder: str, commit: int, entries: list[dict]) -> None:
        """One small file, under its name only when it is whole; a second writer fails."""
        fs, begun = self._hadoop(f"{folder}/_entries.json")
        _, whole = self._hadoop(f"{folder}/entries.json")
        if fs.exists(whole):
            raise RuntimeError(f"another writer was here: {folder}")
        out = fs.create(begun, False)
        for e in entries:
            out.write(bytearray(json.dumps({**e, "commit": commit}).encode() + b"\n"))
        out.close()
        if not fs.rename(begun, whole):
            raise RuntimeError(f"another writer was here: {folder}")
        fs.create(self._hadoop(f"{folder}/_SUCCESS")[1], True).close()

    # -- upkeep -----------------------------------------------------------

    def _tend(self) -> None:
        """Rewrite buckets that are mostly dead or in many pieces, and part crowded ones."""
        state = self._current()
        worn = [
            b
            for b, own in state.of.items()
            if own.written > 2 * max(own.live, 1) or len(own.rows) + len(own.deletes) > MAX_SEGMENTS
        ]
        wanted = max(state.buckets, -(-state.live // self.bucket_rows))
        if worn or wanted > state.buckets:
            self._rewrite(worn, wanted)

    def compact(self, only: Iterable[int] | None = None) -> None:
        """Make each bucket one piece without dead rows."""
        state = self._current()
        buckets = [b for b in (state.of if only is None else only) if b in state.of]
        self._rewrite(buckets, state.buckets)

    def _rewrite(self, buckets: Iterable[int], wanted: int) -> None:
        """Rewrite some buckets, and those that new ones up to `wanted` buckets part from."""
        state = self._current()
        parents = {linear_home(b, state.base, state.buckets) for b in range(state.buckets, wanted)}
        sources = {b for b in {*buckets, *parents} if b in state.of}
        after = State(state.base, wanted, applied=state.applied)
        commit, gen = self._next_commit(), uuid.uuid4().hex
        counts: dict[int, int] = {}
        if any(state.of[b].live for b in sources):
            counts = self._write("data", self.read(sources).select(*STORED_COLUMNS), commit, gen, after)
        entries = []
        for b in sorted({*sources, *counts}):
            n = counts.get(b, 0)
            entries.append(
                _entry(after, b, Bucket(written=n, live=n), [(commit, gen)] if n else [], [], True)
            )
        if entries or wanted > state.buckets:
            self._record(commit, after, entries)

    # -- changes ----------------------------------------------------------

    def upsert(self, incoming: DataFrame, key: str = "path") -> int:
        """Replace stored rows with the same key (`path` or `id`) by the incoming rows.

        `incoming` is read more than once; pass rows that are written somewhere.
        """
        id_ = F.col("id") if key == "id" else F.lit(None).cast("string")
        self.change(incoming, incoming.select("path", id_.alias("id")).distinct())
        return incoming.count()

    def delete_for_path(self, path: str) -> int:
        """Remove one path; 1 where there is a table, whether or not rows matched."""
        if not self.exists():
            return 0
        self.change(None, self.spark.createDataFrame([(path, None)], _KEY_SCHEMA))
        return 1

    def prune(self, on_disk: DataFrame) -> int:
        """Remove rows whose path is not on disk; returns the number of paths."""
        if not self.exists():
            return 0
        work = work_path(self.spark, "prune")
        try:
            orphans = saved(orphan_paths(self.read(), on_disk), f"{work}/orphans")
            n = orphans.count()
            if n:
                self.change(None, orphans.select("path", F.lit(None).cast("string").alias("id")))
            return n
        finally:
            discard(self.spark, work)

    def vacuum(self) -> int:
        """Delete bucket folders that the current state does not refer to; returns their number."""
        state, removed = self._current(), 0
        for kind, part in (("data", "rows"), ("deletes", "deletes")):
            live = {
                f"commit={commit}/gen={gen}/bucket={b}"
                for b, own in state.of.items()
                for commit, gen in getattr(own, part)
            }
            fs, root = self._hadoop(f"{self.path}/{kind}")
            for commit in self._folders(fs, root, "commit="):
                for gen in self._folders(fs, commit, "gen="):
                    for bucket in self._folders(fs, gen, "bucket="):
                        name = "/".join(p.getName() for p in (commit, gen, bucket))
                        if name not in live:
                            fs.delete(bucket, True)
                            removed += 1
        return removed

    def _folders(self, fs, root, prefix: str) -> list:
        if not fs.exists(root):
            return []
        return [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith(prefix)]
