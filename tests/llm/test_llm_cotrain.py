import tracemalloc

import numpy as np

from lodeseek.llm import cotrain

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def pages(n, seed=1):
    rng = np.random.default_rng(seed)
    for i in range(n):
        good = i % 4 > 0
        words = rng.choice(["alpha", "beta", "gamma", "delta"], int(rng.integers(20, 60)))
        text = " ".join(words) if good else " ".join(w + "%%%###" for w in words)
        # The second view: most bad pages come from one source.
        source = "farm" if not good and rng.random() < 0.9 else f"s{i % 7}"
        yield (i, text, "en", source, len(text)), int(good)


def surest_among(keys, text, meta):
    """Lessons from rows that are all in memory."""

    def surest(views, done, good, bad):
        out = []
        for v, x in enumerate((text, meta)):
            raw = np.round(views[v].raw(x).astype(float), 4)
            free = ~np.isin(keys, done[v])
            rows = sorted(zip(raw[free], keys[free], np.flatnonzero(free), strict=True))
            up = sorted((-r, k, i) for r, k, i in rows if r >= np.log(9))[:good]
            down = [(r, k, i) for r, k, i in rows if r <= -np.log(9)][:bad]
            at = [i for _, k, i in sorted(up + down, key=lambda x: x[1])]
            chosen = (text[at], meta[at])
            out.append(cotrain.Lesson(keys[at], (raw[at] > 0).astype(float), chosen))
        return out

    return surest


def test_equals_co_training_in_memory(spark, monkeypatch):
    monkeypatch.setattr(cotrain, "PER_ROUND", 40)
    rows = list(pages(900, seed=5))
    # Copies under other ids teach once; labelled rows are no lesson.
    copies = [((5000 + i, *r[1:]), g) for i, (r, g) in enumerate(rows[300:320] * 10)]
    table = [r for r, _ in rows + copies]
    docs = spark.createDataFrame(table, COLUMNS).repartition(7)
    labels = spark.createDataFrame(
        [(r[0], g) for r, g in rows if r[0] < 150], "doc_id long, quality int"
    )
    keyed = docs.select("*", cotrain.content_key().alias("key")).toPandas().sort_values("doc_id")
    text = cotrain.text_features(keyed["text"].tolist())
    meta = cotrain.viewed(docs, ["doc_id"]).orderBy("doc_id").toArrow().combine_chunks()
    meta = cotrain.meta_features(meta.to_batches()[0])
    ids = keyed["doc_id"].to_numpy()
    few = ids < 150
    keys, first = np.unique(keyed["key"].to_numpy()[~few], return_index=True)
    assert len(keys) == 750
    y = np.array([g for _, g in rows if _[0] < 150], float)
    held = np.array([cotrain.hash_fold(int(d)) == 0 for d in ids[few]])
    lessons = surest_among(keys, text[~few][first], meta[~few][first])
    want = cotrain.train(text[few], meta[few], y, held, lessons)
    got = cotrain.learn(docs, labels)
    for v in ("text", "meta"):
        a, b = getattr(want, v), getattr(got, v)
        x = text if v == "text" else meta
        assert np.abs(a.odds(x) - b.odds(x)).max() < 0.05
    # It is no pool: lessons come from all documents without a label.
    alone = cotrain.train(text[few], meta[few], y, held, lambda *a: surest_among(keys[:0], text[:0], meta[:0])(*a))
    assert np.abs(alone.text.odds(text) - got.text.odds(text)).max() > 0.05


def test_rows_that_share_an_id(spark):
    rows = [r for r, _ in pages(80)]
    rows += [(3, f"other text {i}", "en", "s1", 12) for i in range(50)]
    labels = spark.createDataFrame([(r[0], g) for r, g in pages(80)][:60], "doc_id long, quality int")
    scores = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, COLUMNS).repartition(parts)
        model = cotrain.learn(docs, labels)
        scored = cotrain.score(docs, model, ["doc_id"]).orderBy("doc_id", "score").collect()
        scores.append([r["score"] for r in scored])
    assert np.abs(np.subtract(*scores)).max() < 0.01


def test_both_views_and_their_sum_separate(spark):
    rows = list(pages(600))
    docs = spark.createDataFrame([r for r, _ in rows], COLUMNS)
    labels = spark.createDataFrame(
        [(r[0], g) for r, g in rows if r[0] < 200], "doc_id long, quality int"
    )
    model = cotrain.learn(docs, labels)
    got = {r["doc_id"]: r for r in cotrain.score(docs, model, ["doc_id"]).collect()}
    held = [(got[r[0]], g) for r, g in rows if r[0] >= 200]
    assert np.mean([(r["score"] >= 0.5) == bool(g) for r, g in held]) > 0.98
    assert np.mean([(r["meta_score"] >= 0.5) == bool(g) for r, g in held]) > 0.9
    assert all(0 <= r[c] <= 1 for r, _ in held for c in ("text_score", "meta_score", "score"))
    # Of one row at a time the result is the same.
    one = cotrain.score(docs.where("doc_id = 7"), model, ["doc_id"]).first()
    assert abs(one["score"] - got[7]["score"]) < 1e-6
    kept = cotrain.accepted(docs.selectExpr("*", "'z' AS score", "1 AS tag"), model)
    assert kept.columns == [*docs.columns, "score", "tag"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_views_teach_each_other():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400).astype(float)
    text, meta = rng.standard_normal((2, 400, 5))
    text[:, 0] += 3 * y
    meta[:, 1] += 3 * y
    few = np.arange(400) < 40
    held = np.arange(40) % 5 == 0
    lessons = surest_among(np.arange(360), text[~few], meta[~few])
    model = cotrain.train(text[few], meta[few], y[few], held, lessons)
    odds = model.text.odds(text) + model.meta.odds(meta) - model.prior
    assert np.mean((odds > 0) == y) > 0.95
    assert cotrain.train(text[few], meta[few], np.ones(40), held, lessons) is None


def test_odd_rows(spark):
    rows = [r for r, _ in pages(60)] + [(None, None, None, None, None), (900, "", None, None, None)]
    rows += [(901, "alpha beta " * 50_000, "en", "s1", 1), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, COLUMNS)
    good = [(r[0], g) for r, g in pages(60)]
    odd = [(None, 1), (1, None), (2, 0), (2, 1), (77_777, 1), (3, 5)]
    labels = spark.createDataFrame(good + odd, "doc_id long, quality int")
    model = cotrain.learn(docs, labels)
    assert cotrain.score(docs, model, ["doc_id"]).count() == len(rows)
    assert cotrain.score(docs.where("false"), model, ["doc_id"]).collect() == []
    none = cotrain.learn(docs, labels.where("quality = 1"))
    assert none is None and cotrain.accepted(docs, none).count() == len(rows)
    assert cotrain.learn(docs.where("false"), labels) is None


def test_training_holds_few_copies():
    """Fitting takes one more array of the features' size at a time, not three."""
    rng = np.random.default_rng(4)
    x, y = rng.random((2000, 500), np.float32), rng.integers(0, 2, 2000).astype(float)
    want = cotrain._fit(x.copy(), y, np.ones(2000), steps=3)
    tracemalloc.start()
    got = cotrain._fit(x, y, np.ones(2000), steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * x.nbytes
    assert np.array_equal(got.weights, want.weights) and got.bias == want.bias
