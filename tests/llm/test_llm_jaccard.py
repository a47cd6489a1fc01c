import os
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodeseek.llm import jaccard_join as jj
from lodeseek.llm.components import components
from lodeseek.llm.shingles import shingles, words
from lodeseek.workspace import work_path

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets(rows, width):
    out = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        if len(w) >= width:
            out.append(frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)))
        else:
            out.append(frozenset([tuple(w)] if w else []))
    return out


def plain(rows, width, percent):
    """(doc_id, n, component) of every row by comparing all pairs that share a shingle."""
    own = sets(rows, width)
    groups = list(range(len(rows)))

    def root(i):
        while groups[i] != i:
            i = groups[i]
        return i

    held = defaultdict(list)
    for i, s in enumerate(own):
        if rows[i][0] is None:
            continue
        for j, n in Counter(j for t in s for j in held[t]).items():
            if 100 * n >= percent * (len(s) + len(own[j]) - n):
                groups[root(i)] = root(j)
        for t in s:
            held[t].append(i)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[root(i)].append(d)
    return [
        (d, len(s), None if d is None and s else min(low[root(i)], default=None) if d is not None else d)
        for i, ((d, _), s) in enumerate(zip(rows, own, strict=True))
    ]


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    vocabulary = [f"W{i}" for i in range(60)] + ["the", "of"] * 20
    for i in range(n):
        yield " ".join(rng.choice(vocabulary, int(rng.integers(1, 90)))), rng


def near(text, edits, rng):
    w = text.split()
    for _ in range(edits):
        w[int(rng.integers(len(w)))] = f"new{rng.integers(99)}"
    return " ".join(w)


@pytest.mark.parametrize("width, percent, leaf, rounds", [(3, 90, 256, 2), (5, 80, 4, 1), (2, 50, 3, 0), (3, 90, 2, 2)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, width, percent, leaf, rounds):
    monkeypatch.setattr(jj, "LEAF", leaf)
    texts = []
    for text, rng in corpus(width * percent, 60):
        texts.append(text)
        for _ in range(int(rng.integers(0, 4))):
            texts.append(near(text, int(rng.integers(0, 5)), rng))
    rng = np.random.default_rng(5)
    base = " ".join(rng.choice([f"x{i}" for i in range(50)], 120))
    texts += [base] * 30 + [near(base, int(rng.integers(1, 6)), rng) for _ in range(60)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts)]
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "One"), (9004, "oNE"), (None, base), rows[3]]
    rows += [(9005, "Ä ä"), (9006, "ä ä"), (9007, " ".join(f"q{i}" for i in range(30_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS n").repartition(6)
    got = [tuple(r) for r in jj.jaccard_groups(docs, work_path(spark, "jj"), width, percent, rounds).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, width, percent), key=str)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_links_across_the_border_of_long_sets(spark, seed):
    names = iter(range(100_000))
    new = lambda n: [f"s{seed}n{next(names)}" for _ in range(n)]
    a, b = new(1002), new(1002)
    texts = [a + b, a + b + new(60), *(half + new(1078) for half in (a, b) for _ in range(6))]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jj.jaccard_groups(docs, work_path(spark, "jj"), 1, 80, 1).collect()]
    assert sorted(got) == sorted(plain(rows, 1, 80))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jj.jaccard_groups(docs, work_path(spark, "jj")).collect() == []


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(5, base), (3, base + " more"), (7, "other"), (8, None), (None, base), (3, base + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS component_id")
    left = jj.representatives(docs, work_path(spark, "jj"))
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == [3, 3, 7, 8, None]


def test_words_are_parted_by_ascii_white_space():
    texts = pa.array(["a\tB  c", None, "", "x y", "\n"])
    _, borders = words(texts)
    assert np.diff(borders).tolist() == [3, 0, 0, 1, 0]
    h, ends = shingles(pa.array(["A b c", "a B C d", "a b"]), 3)
    assert np.diff(ends).tolist() == [1, 2, 1] and h[0] == h[1] and h[3] not in h[:3]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))]
    links += [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long"), work_path(spark, "cc")).collect()}
    want = {x: x for link in links for x in link}
    for _ in range(len(want)):
        before = dict(want)
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
        if before == want:
            break
    assert got == want
    empty = spark.createDataFrame([], "u long, v long")
    assert components(empty, work_path(spark, "cc")).collect() == []


def test_bounds_never_exceed_the_difference(monkeypatch):
    monkeypatch.setattr(jj, "LONG", 300)
    monkeypatch.setattr(jj, "LONG_CLASSES", 512)
    rng = np.random.default_rng(9)
    pool = rng.integers(1, 1 << 63, 900, dtype=np.uint64)
    for n, m in [(290, 310), (310, 330), (10, 12), (1, 900), (300, 301)]:
        for _ in range(20):
            x, y = (np.unique(rng.choice(pool, k, replace=False)) for k in (n, m))
            apart = len(np.setxor1d(x, y))
            (gap,) = jj._gaps([jj._class_counts(x)], [jj._class_counts(y)])
            assert abs(n - m) <= gap <= apart
        assert jj._gaps([jj._class_counts(x)], [jj._class_counts(x)])[0] == 0


def test_stars_take_no_step(spark):
    """Links that are stars already need no step, a chain ends with the step that makes it one."""
    for links, want, steps in (
        ([(1, 2), (3, 1), (7, 9), (5, 5)], {1: 1, 2: 1, 3: 1, 7: 7, 9: 7, 5: 5}, 0),
        ([(1, 2), (2, 3)], {1: 1, 2: 1, 3: 1}, 1),
    ):
        path = work_path(spark, "cc")
        rows = components(spark.createDataFrame(links, "u long, v long"), path).collect()
        assert {r["node"]: r["root"] for r in rows} == want
        assert len([d for d in os.listdir(path) if d.endswith("-s")]) == steps


def test_unrelated_long_sets_are_told_apart_beside_short_ones(spark):
    rng = np.random.default_rng(3)
    sizes = [2500, 3000, 3500, 4000, 4000, 4500, 40, 40]
    own = [rng.integers(1, 1 << 63, n, dtype=np.uint64) for n in sizes]
    own += [np.concatenate([own[0][:-20], rng.integers(1, 1 << 63, 20, dtype=np.uint64)]), own[6][:-1]]
    rows = [(i, len(x), jj._class_counts(x)) for i, x in enumerate(own)]
    nodes = spark.createDataFrame(rows, "node long, n long, counts binary")
    live = nodes.selectExpr("7L AS region", "node", "node AS part")
    pairs = jj.close_pairs(live, nodes, 80, False, work_path(spark, "jj")).collect()
    assert sorted(map(tuple, pairs)) == [(0, 8), (6, 9)]


def test_only_the_names_of_copies_stay_on_disk(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, *(f"n{i}x{k}" for k in range(i % 3))])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = work_path(spark, "jj")
    left = jj.representatives(docs, path)
    assert os.listdir(path) == ["gone"]
    assert [r["doc_id"] for r in left.collect()] == [0]
