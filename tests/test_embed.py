import hashlib
import io
import json
import math
import re
import sys
import urllib.error
import urllib.request

import pyarrow as pa
import pytest
from pyspark import cloudpickle

from lodeseek.config import EmbeddingConfig
from lodeseek.functions.batches import slices
from lodeseek.operators import embed as em

CFG = EmbeddingConfig(dim=3, batch_size=2, endpoint="http://embedder.invalid/")


@pytest.fixture
def server(monkeypatch):
    """Answers requests inside of the process; no port is opened."""
    calls = []

    def install(batch=None, single=None):
        def urlopen(request, timeout):
            body = json.loads(request.data)
            calls.append((request.full_url, body))
            answer = batch(body["input"]) if "input" in body else single(body["prompt"])
            if isinstance(answer, Exception):
                raise answer
            if isinstance(answer, int):
                raise urllib.error.HTTPError(request.full_url, answer, "x", {}, io.BytesIO(b"oops"))
            return io.BytesIO(answer if isinstance(answer, bytes) else json.dumps(answer).encode())

        monkeypatch.setattr(urllib.request, "urlopen", urlopen)
        return calls

    return install


def vector(text):
    return [float(len(text)), 0.0, 1.0]


def test_batches(server):
    calls = server(batch=lambda ts: {"embeddings": [vector(t) for t in ts]})
    got = em.HttpProvider(CFG).embed(["a", "bb", "ccc"])
    assert [e.vector for e in got] == [vector("a"), vector("bb"), vector("ccc")]
    assert [len(b["input"]) for _, b in calls] == [2, 1]
    assert calls[0][0] == "http://embedder.invalid/api/embed"


def test_missing_batch_route_is_remembered(server):
    calls = server(batch=lambda ts: 404, single=lambda t: {"embedding": vector(t)})
    got = em.HttpProvider(CFG).embed(["a", "bb", "ccc"])
    assert all(e.vector for e in got)
    assert sum("input" in b for _, b in calls) == 1


def test_one_failure_spares_the_others(server):
    def single(text):
        return {"bad": 500, "gone": urllib.error.URLError("down"), "blank": {"embedding": []}}.get(
            text, {"embedding": vector(text)}
        )

    server(batch=lambda ts: 500, single=single)
    got = em.HttpProvider(CFG).embed(["a", "bad", "gone", "blank", "b"])
    assert [e.vector is not None for e in got] == [True, False, False, False, True]
    assert [e.skip_reason and e.skip_reason.split(":")[0] for e in got[1:4]] == [
        "http_500",
        "transport",
        "protocol",
    ]


@pytest.mark.parametrize("reply", [{"embeddings": [[1.0]]}, {"x": 1}, b"<html>", {"embeddings": [[1.0], [2.0]]}])
def test_malformed_batches_fall_back(server, reply):
    server(batch=lambda ts: reply, single=lambda t: {"embedding": vector(t)})
    assert [e.vector for e in em.HttpProvider(CFG).embed(["a", "b"])] == [vector("a"), vector("b")]


def test_unknown_provider():
    with pytest.raises(ValueError, match="unsupported"):
        em.get_provider(EmbeddingConfig(provider="nope"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Picky:
    name, dim, batch_size = "picky", 2, 3

    def __init__(self, cfg):
        pass

    def embed(self, texts):
        assert len(texts) <= 3
        answers = {"skip": em.Embedded(None, "http_500: x"), "short": em.Embedded([1.0]), "odd": em.Embedded(None)}
        return [answers.get(t, em.Embedded([1.0, float(len(t))])) for t in texts]


def test_column_keeps_rows_and_reasons(spark):
    em.register_provider("picky", Picky)
    try:
        rows = [(i, t) for i, t in enumerate(["a", "skip", "short", None, "odd", "bbb", "c", "d"])]
        df = spark.createDataFrame(rows, "i int, content string").coalesce(1)
        out = {r["i"]: r for r in em.embed_rows(df, EmbeddingConfig(provider="picky")).collect()}
    finally:
        em.PROVIDERS.pop("picky")
    assert out[0]["vector"] == [1.0, 1.0] and out[5]["vector"] == [1.0, 3.0]
    assert out[1]["skip_reason"] == "http_500: x" and out[4]["skip_reason"] == "unknown"
    assert out[2]["vector"] is None and out[2]["skip_reason"].startswith("protocol")
    assert out[3]["vector"] is None and out[3]["skip_reason"] is None


def test_hash_provider():
    p = em.HashProvider(EmbeddingConfig(provider="hash", dim=8))
    a, b, none = p.embed(["Fee transfer", "transfer FEE!", " \n"])
    assert a.vector == b.vector and sum(x * x for x in a.vector) == pytest.approx(1)
    assert none.vector is None and none.skip_reason.startswith("protocol")


def test_cached_provider():
    cfg = EmbeddingConfig(provider="hash", dim=8)
    assert em.cached_provider(cfg) is em.cached_provider(EmbeddingConfig(provider="hash", dim=8))
    assert em.cached_provider(cfg) is not em.cached_provider(EmbeddingConfig(provider="hash", dim=9))


def test_each_content_is_embedded_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.touch()

    class Counting:
        name, dim, batch_size = "counting", 2, 8

        def __init__(self, cfg):
            pass

        def embed(self, texts):
            with open(log, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [em.Embedded(None, "bad") if t == "bad" else em.Embedded([float(len(t)), 1.0]) for t in texts]

    em.register_provider("counting", Counting)
    cfg = EmbeddingConfig(provider="counting", dim=2)
    rows = [(i, "hot", "h") for i in range(300)] + [(i, f"text{i % 7}", f"k{i % 7}") for i in range(300, 400)]
    rows += [(500, "bad", "b"), (501, "bad", "b"), (502, None, "n"), (503, "x", None), (504, "not asked", "q")]
    df = spark.createDataFrame(rows, "i int, content string, content_hash string").repartition(3)
    got = em.embed_distinct(df, cfg, str(tmp_path / "w"), where=em.F.col("i") != 504).collect()
    assert sorted(log.read_text().split()) == sorted(["hot", "bad", *(f"text{k}" for k in range(7))])
    by = {r["i"]: (r["vector"], r["skip_reason"]) for r in got}
    assert len(got) == len(rows) == len(by)
    assert by[0] == ([3.0, 1.0], None) and by[301] == ([5.0, 1.0], None)
    assert by[500] == by[501] == (None, "bad")
    assert by[502] == by[503] == by[504] == (None, None)


def test_vectors_that_are_there_already(spark, tmp_path):
    given = [("a", [1.0, 2.0]), ("b", [1.0]), ("c", [3.0, 4.0]), ("c", [3.0, 4.0])]
    spark.createDataFrame(given, "content_hash string, vector array<double>").write.parquet(str(tmp_path / "v"))
    cfg = EmbeddingConfig(provider="precomputed", endpoint=str(tmp_path / "v"), dim=2)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "a")], "i int, content_hash string")
    got = {r["i"]: r for r in em.embed_distinct(df, cfg, str(tmp_path / "w")).collect()}
    assert [got[i]["vector"] for i in (1, 2, 3, 4, 5)] == [[1.0, 2.0], None, [3.0, 4.0], None, [1.0, 2.0]]
    assert all((got[i]["skip_reason"] is None) == (i in (1, 3, 5)) for i in got)
    assert em.get_provider(cfg).embed(["x"])[0].vector is None


def test_a_large_batch_is_taken_a_megabyte_at_a_time(spark):
    class Wide:
        name, dim, batch_size = "wide", 1, 1_000_000

        def __init__(self, cfg):
            pass

        def embed(self, texts):
            return [em.Embedded([float(sum(map(len, texts)))]) for _ in texts]

    em.register_provider("wide", Wide)
    try:
        rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 2000) AS content")
        out = em.embed_rows(rows, EmbeddingConfig(provider="wide", dim=1)).select("id", "vector").collect()
    finally:
        em.PROVIDERS.pop("wide")
    assert [r["id"] for r in out] == list(range(3000))
    assert max(r["vector"][0] for r in out) <= 1 << 20


def test_slices_are_the_array():
    texts = pa.array(["ab" * i for i in range(60)] + [None] * 9 + ["", "x" * 5000, "y"])
    for some in (texts, texts.slice(7), texts.slice(2, 0)):
        parts = list(slices(some, 500))
        assert [t for p in parts for t in p.to_pylist()] == some.to_pylist()
        assert all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= 500 for p in parts)


def test_words_are_counted_for_many_texts_at_once():
    texts = ["a b a", "", "Kelvin K0 été", "--", "x" * 50, "a"]
    cfg = EmbeddingConfig(provider="hash", dim=8)
    provider = em.get_provider(cfg)
    got = provider.embed(texts)
    # Of bytes, so that no string is made of each word.
    assert provider._slots and all(isinstance(w, bytes) for w in provider._slots)
    assert got == [one for t in texts for one in em.get_provider(cfg).embed([t])]
    assert [g.vector is None for g in got] == [not re.findall("[a-z0-9]+", t.lower()) for t in texts]
    for t, g in zip(texts, got, strict=True):
        counts = [0] * 8
        for w in re.findall("[a-z0-9]+", t.lower()):
            counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 8] += 1
        norm = math.sqrt(sum(c * c for c in counts))
        assert g.vector is None or g.vector == pytest.approx([c / norm for c in counts], abs=1e-6)
