import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeseek.functions.tokens import query_tokens
from lodeseek.operators import rank
from lodeseek.operators.rank import nearest, nearest_to_each, rerank

HIT = "id int, _distance double, kind string, symbol string"


def reranked(spark, hits, query):
    df = spark.createDataFrame([(i, *h) for i, h in enumerate(hits)], HIT)
    return rerank(df, query_tokens(F.lit(query))).collect()


def test_function_with_overlap_beats_nearer_rows(spark):
    got = reranked(
        spark,
        [
            (0.92, "class", "GenericConfig"),
            (1.08, "function", "calculate_fee"),
            (0.95, "function", "test_calculate_fee"),
        ],
        "calculate token2022 transfer fee",
    )
    assert [r["symbol"] for r in got] == ["calculate_fee", "test_calculate_fee", "GenericConfig"]
    assert [r["_rerank_score"] for r in got] == pytest.approx([0.686664, 0.75181480, 0.92])


def test_coverage_beats_plain_overlap(spark):
    got = reranked(
        spark,
        [(1.02, "function", "parse_transfer_fee_config_value"), (1.08, "function", "calculate_fee")],
        "calculate token2022 transfer fee",
    )
    assert got[0]["symbol"] == "calculate_fee"


def test_kind_counts_without_query_tokens(spark):
    hits = [(1.0, "section", "A"), (1.1, "function", "B"), (1.2, "class", "C")]
    assert [r["symbol"] for r in reranked(spark, hits, "the of")] == ["B", "A", "C"]


def test_exact_name(spark):
    (row,) = reranked(spark, [(1.0, "function", "foo")], "foo")
    assert row["_rerank_score"] == pytest.approx(0.85 * 0.94 * 0.85)


def test_test_names_and_parts(spark):
    got = reranked(
        spark,
        [(1.0, "method", "TestX:part2"), (1.0, "class", "test_y"), (None, "class", "z"), (1.0, "class", None)],
        "nothing",
    )
    scores = {r["symbol"]: r["_rerank_score"] for r in got}
    assert got[0]["symbol"] == "z" and scores["z"] == 0.0
    assert scores["TestX:part2"] == pytest.approx(0.85 * 1.15)
    assert scores["test_y"] == scores[None] == 1.0


def vectors(spark, n=300, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.integers(-2, 3, (n, dim)).astype(np.float32)
    rows = [(i, m[i].tolist()) for i in range(n)]
    return m.astype(float), spark.createDataFrame(rows, "id int, vector array<float>").repartition(5)


def brute(m, q, k):
    d = ((m - q) ** 2).sum(1)
    best = sorted(range(len(m)), key=lambda i: (d[i], i))[:k]
    return [(i, d[i]) for i in best]


def test_nearest_is_exact_with_ties(spark):
    m, df = vectors(spark)
    q = [1.0, 0, 0, 0, 1, 0, 0, -1]
    got = [(r["id"], r["_distance"]) for r in nearest(df, q, 25).collect()]
    assert got == brute(m, np.array(q), 25)


def test_other_lengths_and_nulls_are_left_out(spark):
    rows = [(1, [0.0, 1.0]), (2, None), (3, [1.0]), (4, [0.0, 3.0]), (5, [])]
    df = spark.createDataFrame(rows, "id int, vector array<float>").coalesce(1)
    assert [r["id"] for r in nearest(df, [0.0, 0.0], 10).collect()] == [1, 4]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_nearest_to_each_is_exact(spark, block_bytes):
    m, df = vectors(spark)
    qm, queries = vectors(spark, n=17, seed=2)
    queries = queries.withColumnRenamed("id", "query_id")
    hits = nearest_to_each(df, queries, 7, block_bytes=block_bytes).collect()
    for q in range(17):
        mine = sorted((r for r in hits if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["id"], r["_distance"]) for r in mine] == brute(m, qm[q], 7)


def test_copies_of_one_vector_do_not_crowd_out_ids(spark):
    rows = [(i, [1.0, 1.0]) for i in range(500)] + [(1000, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, vector array<float>").repartition(3)
    queries = spark.createDataFrame([("a", [1.0, 1.0])], "query_id string, vector array<float>")
    hits = nearest_to_each(df, queries, 5).orderBy("rank").collect()
    assert [r["id"] for r in hits] == [0, 1, 2, 3, 4]


def test_no_queries_give_no_hits(spark):
    _, df = vectors(spark)
    none = spark.createDataFrame([], "query_id int, vector array<float>")
    assert nearest_to_each(df, none, 3).count() == 0


def test_top_k_needs_no_full_sort(spark):
    _, df = vectors(spark)
    plan = nearest(df, [0.0] * 8, 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and plan.count("ArrowEvalPython") == 1


def test_blocks_of_queries_are_one_plan(spark):
    _, df = vectors(spark)
    _, queries = vectors(spark, n=40, seed=3)
    queries = queries.withColumnRenamed("id", "query_id")
    plan = nearest_to_each(df, queries, 3, block_bytes=500)._jdf.queryExecution().executedPlan().toString()
    # One exchange deals rows and queries out, one brings the hits of a query together.
    assert plan.count("MapInArrow") == 1 and "Union" in plan and "BroadcastExchange" not in plan
    narrow = spark.createDataFrame([("q", None), ("r", [1.0, 2.0])], "query_id string, vector array<float>")
    assert nearest_to_each(df, narrow, 3, block_bytes=4).count() == 0


def test_rows_are_not_sent_once_per_small_block():
    # The rows are shuffled once per block; 512 blocks of 100 kB did so 512 times.
    for size in (5_000_000, 50_000_000, 300_000_000):
        blocks, shares = rank._grid(size, 100_000, 12)
        assert blocks == shares == 5
    assert rank._grid(700 << 20, 100_000, 12)[0] == 11
    assert rank._grid(250_000, 100_000, 12)[0] == 3


@pytest.mark.parametrize("k", [1, 4, 60])
def test_running_top_k_over_batches_of_any_size(k):
    rng = np.random.default_rng(7)
    m = rng.integers(-2, 3, (200, 6)).astype(np.float32)
    queries = rng.integers(-2, 3, (300, 6)).astype(float)
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(range(a, b)), pa.array(m[a:b].tolist(), pa.list_(pa.float32()))], ["id", "v"]
        )
        for a, b in ((150, 153), (0, 90), (90, 150), (153, 200))
    ]
    ids, dist = rank._task_top_k(queries, k, iter(batches))
    for q in (0, 255, 256, 299):
        assert list(zip(ids[q].tolist(), dist[q])) == brute(m.astype(float), queries[q], k)
