"""Faults and odd inputs must not change or empty a result."""

import http.client
import os
import subprocess
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodeseek import workspace
from lodeseek.config import EmbeddingConfig
from lodeseek.operators.embed import HttpProvider
from lodeseek.operators.lexical import lexical_search
from lodeseek.operators.rank import nearest, nearest_to_each
from lodeseek.operators.structural import parse_pattern, python_hits
from lodeseek.sources.git import changed_files
from lodeseek.sources.repo import _Shard, _TreeReader, read_contents


@pytest.mark.parametrize("pattern", [";$", ";(?=$)"])
def test_line_ends_with_carriage_returns(spark, pattern):
    texts = spark.createDataFrame(
        [("a", "x = 1;\r\ny = 2\r\n"), ("b", "z;\r\r\n"), ("c", "w;\r"), ("d", "v; \n")],
        "path string, text string",
    )
    got = [(r["path"], r["line"], r["snippet"]) for r in lexical_search(texts, pattern).collect()]
    assert got == [("a", 1, "x = 1;"), ("b", 1, "z;"), ("c", 1, "w;")]


def test_a_vector_that_is_no_number_costs_only_itself(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [inf, 0.0]), (5, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    one = [r["id"] for r in nearest(frame, [0.0, 0.0], 5).collect()]
    queries = spark.createDataFrame([(7, [0.0, 0.0])], "query_id long, vector array<double>")
    each = [r["id"] for r in nearest_to_each(frame, queries, 5).orderBy("rank").collect()]
    assert one == each == [1, 5]


def test_snippets_behind_a_form_feed():
    text = "def f():\n    pass\n\x0c\ndef g():\n    return 42\n"
    (hit,) = python_hits(parse_pattern("return $N"), text)
    assert (hit["line"], hit["snippet"]) == (5, "return 42")


def test_many_arguments_do_not_take_quadratic_time():
    call = f"foo({', '.join(map(str, range(20_000)))}, 1)\n"
    assert len(python_hits(parse_pattern("foo($$$, 1)"), call)) == 1


def test_changes_below_the_top_of_a_work_tree(spark, tmp_path):
    def git(*args):
        who = ("-c", "user.name=t", "-c", "user.email=t@t")
        subprocess.run(["git", "-C", str(tmp_path), *who, *args], check=True, capture_output=True)

    git("init")
    (tmp_path / "sub").mkdir()
    for name in ("a.py", "sub/b.py", "sub/c.py"):
        (tmp_path / name).write_text("x = 1\n")
    git("add", ".")
    git("commit", "-m", "one")
    (tmp_path / "sub/b.py").write_text("x = 2\n")
    (tmp_path / "a.py").write_text("x = 2\n")
    got = changed_files(spark, tmp_path / "sub", "HEAD").collect()
    assert [r["path"] for r in got] == ["b.py"]


def test_a_folder_that_cannot_be_listed_is_an_error(tmp_path, monkeypatch):
    reader = _TreeReader({"path": str(tmp_path)})
    assert list(reader.read(_Shard("gone/", True))) == []

    def refuse(path):
        raise PermissionError(path)

    monkeypatch.setattr(os, "scandir", refuse)
    with pytest.raises(PermissionError):
        list(reader.read(_Shard("", True)))


def test_only_missing_files_are_skipped(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "folder").mkdir()
    names = spark.createDataFrame([("a.txt",), ("gone.txt",)], "path string")
    assert [r["path"] for r in read_contents(names, tmp_path).collect()] == ["a.txt"]
    with pytest.raises(Exception, match="IsADirectoryError"):
        read_contents(spark.createDataFrame([("folder",)], "path string"), tmp_path).collect()


class Reply:
    def __init__(self, body):
        self.body = body

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self):
        if isinstance(self.body, Exception):
            raise self.body
        return self.body


@pytest.mark.parametrize(
    "body",
    [b"[1]", b'"x"', b"{", http.client.IncompleteRead(b""), b'{"embedding": [NaN, 1]}', b'{"embedding": [null, 1]}'],
)
def test_a_faulty_reply_skips_its_text(monkeypatch, body):
    monkeypatch.setattr("urllib.request.urlopen", lambda *a, **k: Reply(body))
    provider = HttpProvider(EmbeddingConfig(provider="ollama", dim=2))
    (got,) = provider.embed(["text"])
    assert got.vector is None and got.skip_reason.startswith("protocol")


def test_a_cluster_needs_a_shared_folder():
    def session(master):
        conf = SimpleNamespace(get=lambda key, default: default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert workspace.shared_folder(session("local[4]"))
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            workspace.shared_folder(session(master))


def test_texts_are_kept_whole(spark):
    from lodeseek.operators.chunk import chunk_texts

    text = "x" * 9_000 + "\n" + "\n".join(f"line {i}" for i in range(900)) + "\n"
    frame = spark.createDataFrame([("a.c", "c", text)], "path string, lang string, text string")
    got = chunk_texts(frame).orderBy("start_line", F.length("symbol"), "symbol").collect()
    assert "".join(r["content"] for r in got).replace("\n", "") == text.replace("\n", "")
    assert max(len(r["content"]) for r in got) <= 2500 and got[-1]["end_line"] == 901
