import numpy as np
from pyspark.sql import functions as F

from lodeseek.llm import ann
from lodeseek.llm.common import attach
from lodeseek.workspace import work_path

KINDS = "vec_id long, embedding array<float>, label int"


def plain(rows, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(float)
    out = {}
    for i, v in zip(ids, x):
        if i % 20 == 0:
            score = x @ v
            order = [j for j in np.lexsort((ids, -score.round(12))) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def search(spark, rows, k=20):
    frame = spark.createDataFrame([(i, None if v is None else [None if y is None else float(y) for y in v], 0) for i, v in rows], KINDS)
    got = {}
    out = ann.nearest(frame.repartition(4), F.col("vec_id") % 20 == 0, k, work_path(spark, "ann"))
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for hits in got.values():
        assert [h[0] for h in hits] == list(range(1, len(hits) + 1))
    return {q: [h[1:] for h in hits] for q, hits in got.items()}


def check(got, want, least):
    assert set(got) == set(want)
    found = 0
    for q, hits in want.items():
        assert len(got[q]) == len(hits)
        exact = dict(hits)
        found += sum(v in exact for v, _ in got[q])
        for v, s in got[q]:
            assert v not in exact or abs(s - exact[v]) < 1e-9
        assert got[q] == sorted(got[q], key=lambda h: (-h[1], h[0]))
    assert found >= least * sum(map(len, want.values()))


def test_recall_on_the_sphere_and_off_it(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 500)
    monkeypatch.setattr(ann, "BLOCK", 64)
    x = np.random.default_rng(2).standard_normal((1500, 24))
    unit = [(i, v / np.linalg.norm(v)) for i, v in enumerate(x)]
    check(search(spark, unit), plain(unit, 20), 0.9)
    scaled = [(i, v * (1 + i % 5)) for i, v in enumerate(x)]
    check(search(spark, scaled), plain(scaled, 20), 0.9)


def test_hot_vectors_ties_and_few_rows(spark):
    x = np.random.default_rng(3).standard_normal((300, 8))
    rows = [(i, x[0] if i % 3 == 0 else v) for i, v in enumerate(x)]
    check(search(spark, rows), plain(rows, 20), 0.9)
    few = [(0, [1, 0]), (1, [0.5, 1]), (2, [0.5, -1]), (20, [-1, 0])]
    assert search(spark, few) == {
        0: [(1, 0.5), (2, 0.5), (20, -1.0)], 20: [(1, -0.5), (2, -0.5), (0, -1.0)],
    }


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [1, 1]), (2, None), (3, [0, 0]), (4, [nan, 1]), (5, [inf, 1]), (6, [None, 1]), (7, []), (8, [1, 2, 3]), (None, [1, 0]), (1, [1, 1]), (40, [0, 0])]
    assert search(spark, rows) == {0: [(1, 1.0)]}
    assert search(spark, [(1, [1, 0])]) == {}
    assert search(spark, []) == {}


def test_lookups_keep_every_row(spark):
    rows = [(None if i % 7 == 0 else i % 5, i) for i in range(200)]
    frame = spark.createDataFrame(rows, "k long, i long")
    groups = spark.createDataFrame([(0, "a", 40), (1, "b", 40), (9, "c", 1)], "k long, v string, n long")
    for total in (200, 10_000_000):
        got = sorted((r["i"], r["v"]) for r in attach(frame, groups, "k", ["v"], "n", total).collect())
        assert got == [(i, {0: "a", 1: "b"}.get(k)) for k, i in rows]


def test_vectors_of_very_unlike_length(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16))
    one_long = [(i, v * (1000 if i == 77 else 1)) for i, v in enumerate(x)]
    check(search(spark, one_long), plain(one_long, 20), 0.9)
    spread = [(i, v * 2.0 ** rng.integers(-30, 30)) for i, v in enumerate(x[:400])]
    got = search(spark, spread, 5)
    assert {q: len(hits) for q, hits in got.items()} == {q: 5 for q in range(0, 400, 20)}


def test_bands_span_an_octave():
    bins = [(160, 1000.0), (3, 1.1), (0, 1.0), (-12, 0.6), (-13, 0.57), (-40, 0.1)]
    assert ann.limits_of(bins) == [0.1, 0.57, 1.1, 1000.0]
    many = [(16 * i, float(i)) for i in range(40)]
    assert ann.limits_of(many) == [float(i) for i in range(32, 40)]
    assert ann.limits_of([]) == []
