import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm import periodic


def plain_runs(words, least=12):
    """Runs by their definition: every period, every maximal stretch."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                found.setdefault((i, length), q)  # the smallest period comes first
            i = j
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


words_of_few = st.one_of(
    st.lists(st.integers(0, 1), max_size=60),
    st.lists(st.integers(0, 3), max_size=80),
    st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=9), st.integers(1, 9), st.lists(st.integers(0, 4), max_size=9)).map(
        lambda t: t[2] + t[0] * t[1] + t[2]
    ),
)


@settings(max_examples=400, deadline=None)
@given(words_of_few, st.integers(2, 14))
def test_runs_are_those_of_the_definition(words, least):
    assert periodic.runs_of(words, least) == plain_runs(words, least)


@settings(max_examples=200, deadline=None)
@given(st.lists(words_of_few, min_size=1, max_size=5))
def test_stretches_lose_no_run(texts):
    borders = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = periodic.runs_of_texts(np.array(sum(texts, []), np.int64), borders)
    for k, t in enumerate(texts):
        assert got.get(k, []) == plain_runs(t)


def test_periods_are_the_smallest():
    words = [0, 0, 0, 0, 1, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 1]
    assert periodic.runs_of(words, 2) == plain_runs(words, 2)
    rng = np.random.default_rng(5)
    for _ in range(300):
        parts = [rng.integers(0, 2, rng.integers(1, 8)).tolist() * int(rng.integers(1, 6)) for _ in range(5)]
        words = sum(parts, []) * 2
        assert periodic.runs_of(words) == plain_runs(words)


def test_long_loops():
    loop = list(range(1000))
    assert periodic.runs_of(loop * 4 + [5]) == [(0, 4000, 1000)]
    assert periodic.runs_of([7] * 30_000) == [(0, 30_000, 1)]
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    assert periodic.runs_of(b) == plain_runs(b)


def expected(doc_id, text):
    words = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id,
        len(runs),
        *best,
        1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(kept),
        runs,
        kept,
    )


def test_rows_of_odd_texts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["ab", "c", "dé", " "], rng.integers(0, 90)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, " \n\t\r"), (None, "x y " * 20), (203, "one two\n" * 4000)]
    rows += [(7, "again " * 12), (7, "again " * 12), (204, "again " * 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'x' AS runs", "1 AS start", "2 AS period"
    )
    got = periodic.find_runs(docs.repartition(3), shape=periodic.looped, with_text=True).collect()
    flat = [(*r[:8], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got]
    want = [expected(d, t) for d, t in rows]
    assert sorted(map(repr, flat)) == sorted(map(repr, want))




def test_an_empty_table_has_no_row(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.find_runs(docs).collect() == []
