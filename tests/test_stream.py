import datetime
from pathlib import Path

from lodeseek.plans import index as ix
from lodeseek.schemas import CHANGE_SCHEMA
from lodeseek.streaming import watch as wt

T0 = datetime.datetime(2024, 1, 1)


def changes(spark, *rows):
    data = [(c, p, T0 + datetime.timedelta(seconds=t), s) for c, p, t, s in rows]
    return spark.createDataFrame(data, CHANGE_SCHEMA)


def paths(spark, cfg):
    return sorted(r["path"] for r in ix.chunk_table(spark, cfg).paths().collect())


def test_last_change_wins(spark):
    df = changes(
        spark,
        ("added", "a", 0, 0),
        ("deleted", "a", 5, 1),
        ("modified", "a", 5, 0),
        ("deleted", "b", 1, 0),
        ("added", "b", 2, 0),
    ).repartition(3)
    got = {r["path"]: r["change"] for r in wt.latest_changes(df).collect()}
    assert got == {"a": "deleted", "b": "added"}


def test_listing_changes(spark):
    schema = "path string, size bigint, mtime double"
    before = spark.createDataFrame([("same", 1, 1.0), ("gone", 1, 1.0), ("edit", 1, 1.0)], schema)
    after = spark.createDataFrame([("same", 1, 1.0), ("edit", 1, 2.0), ("new", 1, 1.0)], schema)
    got = {r["path"]: r["change"] for r in wt.listing_changes(before, after).collect()}
    assert got == {"gone": "deleted", "edit": "modified", "new": "added"}


def test_changes_are_filtered_and_applied(spark, project):
    cfg = project(
        {"a.py": "def a(): pass", "b.py": "def b(): pass", "c.py": "def c(): pass", "node_modules/x.js": "function x() {}"}
    )
    ix.index_repo(spark, cfg)
    root = Path(cfg.target)
    (root / "a.py").write_text("def a2(): pass")
    (root / "b.py").unlink()
    (root / "d.py").write_text("def d(): pass")
    batch = changes(
        spark,
        ("modified", "a.py", 0, 0),
        ("modified", "b.py", 0, 0),
        ("deleted", "c.py", 0, 0),
        ("added", "d.py", 0, 0),
        ("added", "node_modules/x.js", 0, 0),
        ("added", "e.txt", 0, 0),
    )
    wt.apply_changes(spark, cfg, batch)
    assert paths(spark, cfg) == ["a.py", "d.py"]
    wt.apply_changes(spark, cfg, batch)
    rows = ix.chunk_table(spark, cfg).rows().collect()
    assert sorted(r["symbol"] for r in rows) == ["a2", "d"]


def test_stream_catches_up_from_its_checkpoint(spark, project, tmp_path_factory):
    cfg = project({"a.py": "def a(): pass", "b.py": "def b(): pass"})
    work = str(tmp_path_factory.mktemp("watch"))
    log, state, checkpoint = f"{work}/log", f"{work}/state", f"{work}/checkpoint"

    def follow():
        query = wt.watch_changes(spark, cfg, log, checkpoint, once=True)
        query.awaitTermination()

    wt.record_changes(spark, cfg, log, state, 0)
    follow()
    assert paths(spark, cfg) == ["a.py", "b.py"]
    root = Path(cfg.target)
    (root / "a.py").unlink()
    (root / "c.py").write_text("def c(): pass")
    wt.record_changes(spark, cfg, log, state, 1)
    follow()
    assert paths(spark, cfg) == ["b.py", "c.py"]
    before = ix.chunk_table(spark, cfg)._current()
    wt.record_changes(spark, cfg, log, state, 2)
    follow()
    assert ix.chunk_table(spark, cfg)._current() == before


def test_watch_stops_after_its_rounds(spark, project, tmp_path_factory, monkeypatch):
    monkeypatch.setattr(wt, "DEBOUNCE_SECONDS", 0.2)
    cfg = project({"a.py": "def a(): pass"})
    wt.watch(spark, cfg, str(tmp_path_factory.mktemp("w")), rounds=1)
    assert paths(spark, cfg) == ["a.py"] and not spark.streams.active


def test_a_restart_goes_on_from_the_last_state(spark, project, tmp_path_factory, monkeypatch):
    monkeypatch.setattr(wt, "DEBOUNCE_SECONDS", 0.2)
    cfg = project({"a.py": "def a(): pass", "b.py": "def b(): pass"})
    work = str(tmp_path_factory.mktemp("w"))
    wt.watch(spark, cfg, work, rounds=1)
    assert paths(spark, cfg) == ["a.py", "b.py"]
    (Path(cfg.target) / "a.py").unlink()
    wt.watch(spark, cfg, work, rounds=0)
    assert paths(spark, cfg) == ["b.py"]
    log = spark.read.schema(wt.CHANGE_SCHEMA).json(f"{work}/log")
    assert sorted((r["change"], r["path"]) for r in log.collect()) == [
        ("added", "a.py"), ("added", "b.py"), ("deleted", "a.py"),
    ]
    assert len(wt.states(spark, f"{work}/state")) == 1


def test_changes_that_were_not_logged_are_logged_by_the_next_run(spark, project, tmp_path_factory):
    cfg = project({"a.py": "def a(): pass"})
    work = str(tmp_path_factory.mktemp("w"))
    wt.record_changes(spark, cfg, f"{work}/log", f"{work}/state", 0)
    (Path(cfg.target) / "b.py").write_text("def b(): pass")
    # The listing was kept, but the run ended before the log had its changes.
    wt.discover_files(spark, cfg).write.parquet(f"{work}/state/step=1")
    again = wt.record_changes(spark, cfg, f"{work}/log", f"{work}/state", 2)
    assert [(r["change"], r["path"]) for r in again.collect()] == [("added", "b.py")]


def test_a_batch_is_applied_once(spark, project, tmp_path_factory):
    cfg = project({"a.py": "def a(): pass", "b.py": "def b(): pass"})
    ix.index_repo(spark, cfg)
    root = Path(cfg.target)
    changes = spark.createDataFrame(
        [("deleted", "a.py", None, 1), ("modified", "b.py", None, 2)], wt.CHANGE_SCHEMA
    )
    (root / "b.py").write_text("def b2(): pass")
    assert wt.apply_changes(spark, cfg, changes, ("log", 4))
    before = ix.chunk_table(spark, cfg)._current()
    assert before.applied == {"log": 4} and paths(spark, cfg) == ["b.py"]
    (root / "a.py").write_text("def a(): pass")
    (root / "b.py").write_text("def b3(): pass")
    # Replayed and older batches leave the table as it is; the next one does not.
    for n in (4, 3):
        assert not wt.apply_changes(spark, cfg, changes, ("log", n))
    assert ix.chunk_table(spark, cfg)._current() == before
    added = spark.createDataFrame([("added", "a.py", None, 3)], wt.CHANGE_SCHEMA)
    assert wt.apply_changes(spark, cfg, added, ("log", 5))
    assert wt.apply_changes(spark, cfg, added, ("other", 0))
    state = ix.chunk_table(spark, cfg)._current()
    assert state.applied == {"log": 5, "other": 0} and paths(spark, cfg) == ["a.py", "b.py"]
    ix.chunk_table(spark, cfg).compact()
    assert ix.chunk_table(spark, cfg)._current().applied == state.applied


def test_a_large_file_is_not_opened(spark, project):
    cfg = project({"a.py": "def a(): pass"}, max_file_bytes=100)
    ix.index_repo(spark, cfg)
    (Path(cfg.target) / "a.py").write_text("def big(): pass\n" * 50)
    changes = spark.createDataFrame([("modified", "a.py", None, 1)], wt.CHANGE_SCHEMA)
    assert wt.apply_changes(spark, cfg, changes)
    assert [r["symbol"] for r in ix.chunk_table(spark, cfg).rows().collect()] == ["a"]
