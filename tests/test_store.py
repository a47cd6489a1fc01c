from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseek.functions import ident
from lodeseek.operators import merge
from lodeseek.plans import store
from lodeseek.plans.store import ChunkTable
from lodeseek.schemas import CHUNK_COLUMNS, STORED_COLUMNS
from lodeseek.sources.tables import all_columns

CHUNK = "path string, symbol string, start_line int, content_hash string, vector array<float>"


def rows(spark, *items):
    """Stored rows from (path, symbol, line, hash)."""
    df = spark.createDataFrame([(*i, [1.0, 2.0]) for i in items], CHUNK)
    for name in set(CHUNK_COLUMNS) - set(df.columns):
        df = df.withColumn(name, F.lit(1) if name == "end_line" else F.lit("x"))
    return merge.with_identity(df, "m").select(*STORED_COLUMNS)


def content(df):
    return sorted((r["path"], r["symbol"], r["content_hash"]) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return ChunkTable(spark, str(tmp_path / "t" / "chunks"), buckets=4)


def test_missing_and_empty_tables(table, spark):
    assert not table.exists() and table.stats() == {"rows": 0, "table": "chunks"}
    assert table.rows().count() == 0 and table.paths().count() == 0
    assert table.delete_for_path("a") == 0 and table.prune(table.paths()) == 0
    table.create()
    assert table.exists() and table.rows().columns == STORED_COLUMNS
    table.create()
    assert table.stats()["rows"] == 0


def test_upsert_replaces_by_path(table, spark):
    assert table.upsert(rows(spark, ("a.py", "f", 1, "1"), ("a.py", "g", 5, "2"), ("b.py", "h", 1, "3"))) == 3
    table.upsert(rows(spark, ("a.py", "f", 1, "9")))
    assert content(table.rows()) == [("a.py", "f", "9"), ("b.py", "h", "3")]
    assert table.stats()["rows"] == 2


def test_upsert_by_id_keeps_other_symbols(table, spark):
    table.upsert(rows(spark, ("a.py", "f", 1, "1"), ("a.py", "g", 5, "2")))
    table.upsert(rows(spark, ("a.py", "f", 1, "9")), key="id")
    assert content(table.rows()) == [("a.py", "f", "9"), ("a.py", "g", "2")]


def test_apostrophe_path_is_one_row(table, spark):
    for _ in range(2):
        table.upsert(rows(spark, ("src/it's.rs", "f", 1, "1")))
    assert table.stats()["rows"] == 1
    assert table.delete_for_path("src/it's.rs") == 1 and table.rows().count() == 0
    assert table.delete_for_path("none") == 1


def size_of(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet"))


def test_bytes_written_follow_the_change(table, spark):
    paths = [f"p{i}.py" for i in range(400)]
    table.upsert(rows(spark, *[(p, f"s{k}", k, "1") for p in paths for k in range(20)]))
    before, size = table._current(), size_of(table.path)
    table.upsert(rows(spark, ("p0.py", "f", 1, "2")))
    table.delete_for_path("p1.py")
    after = table._current()
    changed = {b for b in after.of if after.of[b] != before.of[b]}
    assert 1 <= len(changed) <= 2 and size_of(table.path) - size < size / 10
    assert table.stats()["rows"] == 398 * 20 + 1 == table.rows().count()
    assert size_of(f"{table.path}/deletes") > 0 and table.vacuum() == 0
    table.compact()
    assert table.vacuum() > 0 and size_of(f"{table.path}/deletes") == 0
    assert table.stats()["rows"] == 398 * 20 + 1 == table.rows().count()
    assert ChunkTable(spark, table.path, buckets=99).buckets == 4


def test_rows_of_a_commit_outlive_its_own_deletes_and_older_ones(table, spark):
    for n in range(1, 4):
        table.upsert(rows(spark, ("a.py", "f", 1, str(n)), ("a.py", f"g{n}", 2, "x")), key="id")
    assert content(table.rows()) == [("a.py", "f", "3")] + [("a.py", f"g{n}", "x") for n in range(1, 4)]
    table.delete_for_path("a.py")
    table.upsert(rows(spark, ("a.py", "f", 1, "1")), key="id")
    assert content(table.rows()) == [("a.py", "f", "1")] and table.stats()["rows"] == 1


def test_many_deletes_rewrite_their_buckets(table, spark, monkeypatch):
    monkeypatch.setattr(store, "DELETE_KEYS", 5)
    table.upsert(rows(spark, *[(f"p{i}.py", "f", 1, "1") for i in range(40)]))
    table.upsert(rows(spark, *[(f"p{i}.py", "f", 1, "2") for i in range(20)]))
    assert table._current().keys == 0 and not Path(f"{table.path}/deletes").exists()
    assert content(table.rows()) == sorted((f"p{i}.py", "f", "2" if i < 20 else "1") for i in range(40))
    assert table.stats()["rows"] == 40


def test_worn_buckets_are_made_whole(table, spark, monkeypatch):
    monkeypatch.setattr(store, "MAX_SEGMENTS", 4)
    table.upsert(rows(spark, ("a.py", "f", 1, "0"), *[("a.py", f"s{k}", k, "0") for k in range(9)]))
    for n in range(4):
        table.upsert(rows(spark, ("a.py", "f", 1, str(n))), key="id")
        own = [b for b in table._current().of.values() if b.live]
        assert all(len(b.rows) + len(b.deletes) <= 4 for b in own)
    assert table.stats()["rows"] == 10 == table.rows().count()
    table.delete_for_path("a.py")
    assert [b for b in table._current().of.values() if b.rows] == [] and table.rows().count() == 0


def test_a_table_that_grows_tenfold(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), buckets=3, bucket_rows=50)
    total = 0
    for n in (150, 150, 400, 400, 400):
        total += n
        table.upsert(rows(spark, *[(f"d{total}/p{i}.py", "f", 1, "1") for i in range(n)]))
        state = table._current()
        sizes = [b.live for b in state.of.values()]
        assert state.buckets == -(-total // 50) and len(sizes) == state.buckets
        # Buckets that are parted and those that are not yet differ by a factor of two, give or
        # take what the hash does at so few rows.
        assert max(sizes) <= 2 * 50 * 1.5
    assert table.rows().count() == 1500 == table.stats()["rows"]
    one = spark.createDataFrame([("d300/p7.py",)], "path string")
    assert table.of_paths(one).where("path = 'd300/p7.py'").count() == 1


@given(st.integers(1, 9), st.integers(0, 40), st.integers(0, 40))
def test_linear_buckets_part_from_their_home(base, more, later):
    n, m = base + more, base + more + later

    def of(h, buckets):
        wide = ident._width(base, buckets)
        return h % wide if h % wide < buckets else h % (wide // 2)

    for h in range(200):
        assert 0 <= of(h, n) < n
        assert ident.linear_home(of(h, m), base, n) == of(h, n)


def test_states_replace_old_records(table, spark, monkeypatch):
    monkeypatch.setattr(store, "STATE_EVERY", 3)
    for n in range(5):
        table.upsert(rows(spark, (f"p{n}.py", "f", 1, "1")))
    whole = table._current()
    assert table._numbers("states", done=True) and whole.live == 5
    store._STATES.clear()
    reads = []
    monkeypatch.setattr(
        ChunkTable, "_read_entries",
        lambda self, folders, f=ChunkTable._read_entries: reads.extend(folders) or f(self, folders),
    )
    assert table._current() == whole and len(reads) < 5


def test_unrecorded_files_are_invisible(table, spark):
    table.upsert(rows(spark, ("a.py", "f", 1, "1")))
    stray = rows(spark, ("z.py", "f", 1, "1")).withColumn("bucket", F.lit(1))
    stray.write.partitionBy("bucket").parquet(f"{table.path}/data/commit=1/gen=1")
    assert content(table.rows()) == [("a.py", "f", "1")]
    table.upsert(rows(spark, ("b.py", "f", 1, "1")))
    assert {p for p, _, _ in content(table.rows())} == {"a.py", "b.py"}


def test_a_commit_that_died_is_stepped_over(table, spark):
    table.upsert(rows(spark, ("a.py", "f", 1, "1")))
    Path(f"{table.path}/commits/commit=1/_temporary").mkdir(parents=True)
    assert content(table.rows()) == [("a.py", "f", "1")]
    table.upsert(rows(spark, ("a.py", "f", 1, "2")))
    assert content(table.rows()) == [("a.py", "f", "2")] and table._commits() == [0, 1, 2]


def test_a_second_writer_of_a_commit_fails(table, spark):
    table.upsert(rows(spark, ("a.py", "f", 1, "1")))
    state = table._current()
    table._record(1, state, [])
    with pytest.raises(RuntimeError, match="another writer"):
        table._record(1, state, [])
    store._STATES.clear()
    assert content(table.rows()) == [("a.py", "f", "1")]


def test_another_writer_is_noticed(table, spark):
    table.upsert(rows(spark, ("a.py", "f", 1, "1")))
    assert table.stats()["rows"] == 1
    ChunkTable(spark, table.path).upsert(rows(spark, ("b.py", "f", 1, "1")))
    assert table.stats()["rows"] == 2


def test_prune(table, spark):
    table.upsert(rows(spark, ("src/keep.py", "f", 1, "1"), ("src/ghost.py", "g", 1, "2")))
    disk = spark.createDataFrame([("src/keep.py",), ("src/new.py",)], "path string")
    assert table.prune(disk) == 1 and table.prune(disk) == 0
    assert [r["path"] for r in table.paths().collect()] == ["src/keep.py"]


def test_a_hot_path_is_replaced_whole(table, spark):
    hot = spark.range(20_000).select(F.lit("hot.py").alias("path"), F.col("id").cast("int").alias("n"))
    stored = hot.select(
        "path", F.concat(F.lit("s"), "n").alias("symbol"), F.col("n").alias("start_line"),
        F.lit("h").alias("content_hash"), F.array(F.lit(1.0).cast("float")).alias("vector"),
        *[F.lit("x").alias(c) for c in ("lang", "kind", "content")], F.lit(1).alias("end_line"),
    )
    stored = merge.with_identity(stored, "m").select(*STORED_COLUMNS)
    table.upsert(stored.unionByName(rows(spark, ("cold.py", "f", 1, "1"))))
    assert table.stats()["rows"] == 20_001
    table.upsert(rows(spark, ("hot.py", "f", 1, "2")))
    assert content(table.rows()) == [("cold.py", "f", "1"), ("hot.py", "f", "2")]


def test_writable_check(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    with pytest.raises(RuntimeError, match="not writable"):
        ChunkTable(spark, str(tmp_path / "file" / "t")).check_writable()


def test_existing_hashes(spark):
    stored = rows(
        spark,
        ("src/keep.py", "a", 1, "1"),
        ("src/keep.py", "b", 5, "2"),
        ("src/keep.py", "c", 9, ""),
        ("src/keep.py", "d", 10, None),
        ("src/other.py", "e", 1, "3"),
    )

    def of(*paths):
        p = spark.createDataFrame([(x,) for x in paths], "path string")
        return sorted(tuple(r) for r in merge.existing_hashes(stored, p).collect())

    assert of("src/keep.py") == [("src/keep.py", "a", 1, "1"), ("src/keep.py", "b", 5, "2")]
    assert of("none.py") == [] and of() == []


def test_cache_flags_split_all_chunks(spark):
    stored = rows(spark, ("a", "f", 1, "1"), ("a", "g", 2, "2"), ("a", "g", 2, "2"), ("b", "h", 1, "3"))
    chunks = rows(spark, ("a", "f", 1, "1"), ("a", "g", 2, "changed"), ("a", "new", 3, "2"), ("b", "h", 1, "3"))
    known = merge.existing_hashes(stored, chunks)
    flags = {(r["path"], r["symbol"]): r["cached"] for r in merge.flag_cached(chunks, known).collect()}
    assert flags == {("a", "f"): True, ("a", "g"): False, ("a", "new"): False, ("b", "h"): True}
    hits, misses = merge.cache_hits(chunks, known), merge.cache_misses(chunks, known)
    assert len(content(hits)) == 2 and len(content(misses)) == 2


def test_reconcile_keeps_what_is_unchanged_or_failed(spark):
    stored = rows(
        spark, ("a", "same", 1, "1"), ("a", "edit", 2, "2"), ("a", "gone", 3, "3"),
        ("a", "fail", 4, "4"), ("b", "other", 1, "5"), ("c", "emptied", 1, "6"),
    )
    run = (
        rows(spark, ("a", "same", 1, "1"), ("a", "edit", 2, "2x"), ("a", "fail", 4, "4x"), ("a", "new", 9, "9"))
        .withColumn("cached", F.col("symbol") == "same")
        .withColumn("skip_reason", F.when(F.col("symbol") == "fail", "http_500"))
    )
    touched = spark.createDataFrame([("a",), ("c",)], "path string")
    assert content(merge.reconcile(stored, touched, run)) == [
        ("a", "edit", "2x"), ("a", "fail", "4"), ("a", "new", "9"), ("a", "same", "1"), ("b", "other", "5"),
    ]


def test_filters_and_columns_reach_the_scan(table, spark):
    from lodeseek.operators.rank import nearest
    from lodeseek.plans.search import prefilter

    table.upsert(rows(spark, ("src/a.py", "f", 1, "1")))
    slim = prefilter(table.read(), "x", "src/").select("bucket", "id", "vector")
    plan = nearest(slim, [0.0, 0.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,x)" in plan and "StringStartsWith(path,src/)" in plan
    assert "content" not in plan


def test_names_of_many_buckets_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    table = store.ChunkTable(spark, f"{tmp_path}/t", buckets=64)
    seen = []
    write = store.ChunkTable._write

    def counting(self, kind, rows, commit, gen, state):
        out = write(self, kind, rows, commit, gen, state)
        files = spark.read.parquet(f"{self.path}/{kind}/commit={commit}/gen={gen}").inputFiles()
        seen.append((kind, {f.rsplit("/", 1)[1].split("-")[1] for f in files}))
        return out

    monkeypatch.setattr(store.ChunkTable, "_write", counting)
    rows = spark.range(200).selectExpr(
        "cast(id AS string) AS id", "concat('p', id) AS path", "'x' AS content"
    )
    rows = all_columns(rows)
    table.upsert(rows)
    table.upsert(rows)
    assert table.rows().count() == 200
    assert len(dict(seen)["deletes"]) > 2
