import numpy as np

from lodeseek.llm import lang_id

WORDS = {"en": "the of and that with this", "de": "der die und nicht ein für", "fr": "le la et une où très"}


def texts(seed, n):
    rng = np.random.default_rng(seed)
    for i in range(n):
        lang = list(WORDS)[i % 3]
        yield i, " ".join(rng.choice(WORDS[lang].split(), int(rng.integers(4, 40)))), lang


def brute(train, text):
    """Naive Bayes over a dictionary of hashed n-grams, text by text."""
    counts, docs = {}, {}
    for _, t, lang in train:
        docs[lang] = docs.get(lang, 0) + 1
        points, borders = lang_id.letters_of([t])
        own = counts.setdefault(lang, np.zeros(1 << lang_id.BITS))
        for n in lang_id.SIZES:
            for h in lang_id.buckets(points, borders, n, lang_id.BITS):
                if h < 1 << lang_id.BITS:
                    own[h] += 1
    logs = {}
    points, borders = lang_id.letters_of([text])
    for lang, own in counts.items():
        p = np.log((own + lang_id.SMOOTHING) / (own.sum() + lang_id.SMOOTHING * len(own)))
        logs[lang] = np.log(docs[lang] / sum(docs.values()))
        for n in lang_id.SIZES:
            h = lang_id.buckets(points, borders, n, lang_id.BITS)
            logs[lang] += p[h[h < 1 << lang_id.BITS]].sum()
    best = max(sorted(logs), key=logs.get)
    return best, 1 / sum(np.exp(x - logs[best]) for x in logs.values())


def test_predictions_are_those_of_plain_counting(spark):
    train = list(texts(1, 60))
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string").repartition(4)
    model = lang_id.learn(docs)
    held = list(texts(2, 30)) + [(99, "the der", None)]
    frame = spark.createDataFrame(held, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in lang_id.predict(frame, model, ["doc_id"]).collect()}
    for i, text, lang in held:
        want, score = brute(train, text)
        assert got[i]["lang_pred"] == want and abs(got[i]["score"] - score) < 1e-3
        assert lang in (want, None)


def test_odd_rows(spark):
    train = list(texts(1, 30)) + [(90, None, "xx"), (91, "123", "yy"), (92, "the", None)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = lang_id.learn(docs)
    assert model.languages == ["de", "en", "fr"]
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "und " * 300_000), (None, "the of"), (4, "und")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "'x' AS lang_pred", "2 AS score"
    )
    got = [(r["doc_id"], r["lang_pred"]) for r in lang_id.predict(odd, model, ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (None, "en"), (4, "de")], key=str
    )
    empty = lang_id.learn(docs.where("false"))
    assert [r["lang_pred"] for r in lang_id.predict(odd, empty, ["doc_id"]).collect()] == ["und"] * 6
    assert lang_id.predict(odd.where("false"), model, ["doc_id"]).collect() == []


def test_neighbours_do_not_matter():
    model = lang_id.Model(["a", "b"], np.random.default_rng(1).random(((1 << 15) + 1, 2)).astype("f4"), np.zeros(2))
    model.weights[-1] = 0
    some = ["one text", "", "another", "ü"]
    names, scores = lang_id.score_texts(some, model)
    for t, n, s in zip(some, names, scores):
        (own,), (score,) = lang_id.score_texts([t], model)
        assert (own, round(score, 6)) == (n, round(s, 6))
