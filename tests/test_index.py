import dataclasses
import json
import subprocess
from pathlib import Path

import pytest

from lodeseek.operators import embed as em
from lodeseek.plans import index as ix
from lodeseek.plans import search as se
from lodeseek.sources.repo import list_tree, submodule_globs
from lodeseek.streaming.watch import apply_changes
from test_embed import Picky

TREE = {
    "src/__init__.py": "x = 1\n",
    "src/a.py": "def alpha(x):\n    return foo(x, 1)\n\nclass B:\n    def m(self):\n        return foo(2)\n",
    "src/l.rs": "mod x;\npub fn hello() -> u8 { 1 }\n",
    ".hidden/h.py": "def hidden(): pass\n",
    "target/big.rs": "fn t() {}",
    "target/nested/deeper.rs": "fn t() {}",
    "node_modules/b.js": "function b() {}",
    "vendor/sub/v.py": "def v(): pass",
    ".gitmodules": '[submodule "s"]\n\tpath = vendor/sub/\n\turl = x%20y\n',
    "README.md": "# Title\nhello world\n## Fees\ntransfer fee\n",
    "notes.txt": "not indexed",
}


def symbols(spark, cfg):
    return sorted((r["path"], r["symbol"]) for r in ix.chunk_table(spark, cfg).rows().collect())


def git(cfg, *args):
    subprocess.run(
        ["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *args],
        cwd=cfg.target, check=True, capture_output=True,
    )


def test_discovery(spark, project):
    cfg = project(TREE)
    got = sorted(r["path"] for r in ix.discover_files(spark, cfg).collect())
    assert got == [".hidden/h.py", "README.md", "src/__init__.py", "src/a.py", "src/l.rs"]
    everything = {r["path"] for r in list_tree(spark, cfg.target).collect()}
    assert everything == set(TREE)


def test_wide_and_deep_trees_are_listed_once(spark, project, monkeypatch):
    import lodeseek.sources.repo as repo

    monkeypatch.setattr(repo, "NAMES_PER_TASK", 7)
    files = {f"d{i}/e{j}/f{k}.py": "" for i in range(4) for j in range(4) for k in range(4)}
    files |= {f"flat{i}.py": "" for i in range(40)}
    cfg = project(files)
    assert sorted(r["path"] for r in list_tree(spark, cfg.target).collect()) == sorted(files)


def test_submodule_files(tmp_path):
    assert submodule_globs(tmp_path) == []
    (tmp_path / ".gitmodules").write_text("[submodule \"a\"]\npath = x/y\n[other]\npath = z\n")
    assert submodule_globs(tmp_path) == ["x/y/**"]
    (tmp_path / ".gitmodules").write_text("not an ini file [[[\n")
    assert submodule_globs(tmp_path) == []


def test_index_search_prune(spark, project):
    cfg = project(TREE | {"big.py": "x = 1\n" * 20_000}, max_file_bytes=50_000)
    stats = ix.index_repo(spark, cfg)
    assert stats == {
        "files": 6, "chunks": 8, "embedded": 8, "skipped": 0, "cache_hits": 0, "chunker_skipped_files": 1,
    }
    assert ("src/a.py", "alpha") in symbols(spark, cfg) and ("README.md", "Fees") in symbols(spark, cfg)
    top = se.semantic_search(spark, cfg, "transfer fee", k=3).collect()
    assert (top[0]["path"], top[0]["symbol"]) == ("README.md", "Fees")
    assert len(top) == 3 and top[0]["rerank_score"] <= top[1]["rerank_score"]
    raw = se.semantic_search(spark, cfg, "transfer fee", k=2, use_rerank=False, lang="python").collect()
    assert {r["lang"] for r in raw} == {"python"} and raw[0]["rerank_score"] is None
    below = se.semantic_search(spark, cfg, "foo", path_prefix="src/l").collect()
    assert {r["path"] for r in below} == {"src/l.rs"}
    assert se.render_hits(spark, cfg, "transfer fee", 2).startswith("1. section Fees, README.md, lines 3 to 4, score ")
    assert "non-empty" in se.render_hits(spark, cfg, "  ")
    with pytest.raises(ValueError, match="non-empty"):
        se.semantic_search(spark, cfg, " \n")
    (Path(cfg.target) / "src/l.rs").unlink()
    assert ix.prune_index(spark, cfg) == 1
    assert ("src/l.rs", "hello") not in symbols(spark, cfg)
    assert ix.index_repo(spark, cfg)["files"] == 5


def test_texts_over_a_megabyte_are_indexed(spark, project):
    cfg = project({})
    text = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(40_000))
    files = spark.createDataFrame([("a.py", len(text), text.encode())], "path string, size long, content binary")
    assert len(text) > cfg.index.max_file_bytes
    ix.index_contents(spark, cfg, files, files)
    assert len(symbols(spark, cfg)) == 40_000


def test_files_that_grow_over_the_limit_keep_their_rows(spark, project):
    cfg = project({"a.py": "def alpha():\n    return 1\n", "b.py": "def b(): pass\n"}, max_file_bytes=500)
    ix.index_repo(spark, cfg)
    (Path(cfg.target) / "a.py").write_text("def other():\n    return 1\n" * 100)
    want = [("a.py", "alpha"), ("b.py", "b")]
    assert ix.index_repo(spark, cfg)["chunker_skipped_files"] == 1 and symbols(spark, cfg) == want
    changes = spark.createDataFrame([("modified", "a.py", 1), ("modified", "b.py", 1)], "change string, path string, seq long")
    apply_changes(spark, cfg, changes.selectExpr("change", "path", "current_timestamp() AS ts", "seq"))
    assert symbols(spark, cfg) == want


def test_search_without_a_table(spark, project):
    cfg = project({})
    assert se.semantic_search(spark, cfg, "x").collect() == []
    assert se.render_hits(spark, cfg, "x") == "Nothing found."


def test_live_file_search(spark, project):
    cfg = project(TREE | {".gitignore": "ignored/\n*.tmp\n", "ignored/x.py": "foo(3)", "b.bin": b"foo(\x00"})
    hits = [(r["path"], r["line"]) for r in se.search_lexical(spark, cfg, r"foo\(").collect()]
    assert hits == [("src/a.py", 2), ("src/a.py", 6)]
    (hit,) = se.search_structural(spark, cfg, "foo($X)", "python").collect()
    assert (hit["path"], hit["line"], hit["snippet"]) == ("src/a.py", 6, "foo(2)")
    with pytest.raises(ValueError):
        se.search_structural(spark, cfg, "foo($X)", "cobol")


def test_incremental_runs(spark, project):
    cfg = project({"a.py": "def alpha():\n    return 1\n\ndef beta():\n    return 2\n", "b.py": "def c(): pass\n"})
    git(cfg, "init", "-q")
    git(cfg, "add", "-A")
    git(cfg, "commit", "-qm", "one")
    assert ix.index_repo(spark, cfg)["embedded"] == 3
    a = Path(cfg.target) / "a.py"
    a.write_text(a.read_text() + "\n")
    unchanged = ix.index_repo(spark, cfg, since="HEAD")
    assert (unchanged["files"], unchanged["cache_hits"], unchanged["embedded"]) == (1, 2, 0)
    a.write_text("def alpha():\n    return 1\n\ndef gamma():\n    return 3\n")
    git(cfg, "add", "-A")
    (Path(cfg.target) / "new.py").write_text("def n(): pass\n")
    edited = ix.index_repo(spark, cfg, since="HEAD")
    assert (edited["files"], edited["cache_hits"], edited["embedded"]) == (2, 1, 2)
    assert symbols(spark, cfg) == [("a.py", "alpha"), ("a.py", "gamma"), ("b.py", "c"), ("new.py", "n")]
    forced = ix.index_repo(spark, cfg, since="HEAD", force=True)
    assert (forced["cache_hits"], forced["embedded"]) == (0, 3)
    git(cfg, "commit", "-qm", "two")
    assert ix.index_repo(spark, cfg, since="HEAD~1")["files"] == 2
    with pytest.raises(RuntimeError, match="git diff failed"):
        ix.index_repo(spark, cfg, since="no-such-ref")


def test_all_chunks_of_a_large_file_are_stored(spark, project):
    cfg = project({"many.py": "\n".join(f"def f{i}(): pass" for i in range(40))}, commits=3)
    assert ix.index_repo(spark, cfg)["embedded"] == 40
    assert len(symbols(spark, cfg)) == 40


def test_a_crash_keeps_finished_parts(spark, project, monkeypatch):
    cfg = project({f"f{i}.py": f"def f{i}(): pass" for i in range(12)}, commits=3)
    done, whole = [], ix.index_contents

    def fail_third(*args, **kwargs):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(whole(*args, **kwargs))
        return done[-1]

    monkeypatch.setattr(ix, "index_contents", fail_third)
    with pytest.raises(KeyboardInterrupt):
        ix.index_repo(spark, cfg)
    monkeypatch.undo()
    assert 0 < len(symbols(spark, cfg)) < 12
    ix.index_repo(spark, cfg)
    assert len(symbols(spark, cfg)) == 12


def test_failed_embeddings_keep_old_rows_and_are_logged(spark, project, monkeypatch):
    cfg = project({"a.md": "# A\none\n## B\ntwo\n"})
    ix.index_repo(spark, cfg)
    monkeypatch.setitem(em.PROVIDERS, "picky", Picky)
    cfg = dataclasses.replace(cfg, embedding=dataclasses.replace(cfg.embedding, provider="picky"))
    (Path(cfg.target) / "a.md").write_text("skip")
    stats = ix.index_repo(spark, cfg)
    assert (stats["chunks"], stats["embedded"], stats["skipped"]) == (1, 0, 1)
    (log,) = [json.loads(r[0]) for r in spark.read.text(cfg.skip_log_path).collect()]
    assert log == {
        "path": "a.md", "symbol": "a", "lang": "markdown", "start_line": 1, "end_line": 1,
        "chars": 4, "reason": "http_500: x",
    }


def test_emptied_files_lose_their_rows(spark, project):
    cfg = project({"a.py": "def a(): pass\n", "b.py": "def b(): pass\n"})
    ix.index_repo(spark, cfg)
    (Path(cfg.target) / "a.py").write_text("\n")
    ix.index_repo(spark, cfg)
    assert symbols(spark, cfg) == [("b.py", "b")]


def test_unknown_provider_fails_before_any_work(spark, project):
    cfg = project({"a.py": "def a(): pass\n"})
    cfg = dataclasses.replace(cfg, embedding=dataclasses.replace(cfg.embedding, provider="nope"))
    with pytest.raises(ValueError, match="unsupported"):
        ix.index_repo(spark, cfg)
    assert not ix.chunk_table(spark, cfg).exists()


def test_modules_and_digests(spark, project):
    cfg = project(TREE | {".lodeseek/digests/src.md": "about src"})
    assert se.modules(cfg) == ["src", "vendor"]
    assert se.digest(cfg, "src") == "about src"
    assert se.digest(cfg, "none") .endswith("write one to .lodeseek/digests/none.md.")
    for bad in ("../x", "a/b", "", ".."):
        with pytest.raises(ValueError):
            se.digest(cfg, bad)
