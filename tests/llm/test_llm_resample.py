import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm import resample as rs
from lodeseek.workspace import work_path


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def plain(rows, target, percent=10, least=20, orders=1, buckets=10_000):
    def found(text):
        w = words_of(text)
        return [
            zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets
            for k in range(1, orders + 1)
            for i in range(len(w) - k + 1)
        ]

    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for b in found(text):
            s[b] += 1
    for _, text in target:
        for b in found(text):
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
        for b in range(buckets)
    ]
    out = []
    for d, text in rows:
        own = found(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(own), weight, score, len(words_of(text))])
    ready = [r for r in out if r[4] >= least]
    order = sorted(ready, key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: len(ready) * percent // 100]
    ranks = {id(r): i + 1 for i, r in enumerate(drawn)}
    return sorted((repr((*r[:4], ranks.get(id(r)))) for r in out))


@pytest.mark.parametrize("orders", [1, 2])
def test_every_row_as_by_plain_code(spark, orders):
    rng = np.random.default_rng(4)
    vocabulary = ["Alpha", "beta", "ÉTÉ", "x1", "中文", "Beta", "don't"]
    rows = [(int(i) * 37 % 1009 - 300, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(400)]
    rows += [(5000, None), (5001, ""), (5002, " .,\n"), (None, "no id " * 20), (5003, "Long " * 30_000)]
    rows += [(5004, "same " * 25), (5004, "same " * 25)]
    target = [(1, "alpha beta x1"), (2, None), (3, "中文 été")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'x' AS block", "1 AS place", "2 AS score"
    )
    aim = spark.createDataFrame(target, "item_id long, text string")
    got = rs.resample(docs.repartition(5), aim, work_path(spark, "resample"), percent=30, orders=orders)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = plain(rows, target, percent=30, orders=orders)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert rs.resample(none, none, work_path(spark, "resample")).collect() == []
    got = rs.resample(some, none, work_path(spark, "resample"), percent=100, least_words=1)
    assert {(r["doc_id"], r["rank"]) for r in got.collect()} == {(1, 1), (2, None)}


def test_digits_cover_all_of_64_bits():
    low, high = -(2**63), 2**63 - 1
    passes = rs.digits(low, high, 1, 3, 3)
    assert [d.key for d in passes] == ["doc_id"] * 6 + ["missing"]
    import pyarrow as pa

    values = [low, -1, 0, None, 5, high]
    part = pa.record_batch({"doc_id": pa.array(values, pa.int64())})
    key = sum(
        d.of(part).astype(object) << d.shift for d in passes if d.key == "doc_id"
    )
    assert [k for k, v in zip(key, values) if v is not None] == [
        v - low for v in values if v is not None
    ]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.sampled_from([None, 0, 1, 2, 9_000_000_000])), min_size=1, max_size=60))
def test_ranks_by_radix_passes(spark, rows):
    blocks = {}
    state = []
    for i, (score, doc_id) in enumerate(rows):
        b = i % 3
        state.append((doc_id, score, b, blocks.get(b, 0)))
        blocks[b] = blocks.get(b, 0) + 1
    df = spark.createDataFrame(state, "doc_id long, score long, block long, place long")
    got = rs.radix_ranks(df, work_path(spark, "radix"), block_rows=7).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    key = lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0)
    by_place = [key(r) for r in sorted(got, key=lambda r: r["position"])]
    assert by_place == sorted(by_place)
