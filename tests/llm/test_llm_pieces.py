import itertools
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodeseek.llm import sp_sample as sp

MODEL = public_tokenizers.path("piece_bpe_32k.model")
V = sp.vocabulary(MODEL)


def keys(n):
    return np.arange(1, n + 1, dtype=np.uint64)


def every(text):
    """All segmentations of a normalised text and their probabilities, by hand."""
    pieces = {V.processor.id_to_piece(i): w for i, w in enumerate(V.weights) if np.isfinite(w)}
    out = {}
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1], start=1):
            if c:
                parts.append(text[at:i])
                at = i
        weight, ids = 0.0, []
        for p in parts:
            if p in pieces:
                weight += pieces[p]
                ids.append(V.processor.piece_to_id(p))
            elif len(p) == 1:
                back = V.fall_back(p)
                weight += V.fallback * len(back)
                ids += back
            else:
                break
        else:
            out[tuple(ids)] = weight
    total = np.log(sum(np.exp(w) for w in out.values()))
    return {ids: w - total for ids, w in out.items()}


@pytest.mark.parametrize("text", ["abc", "a the", "x\ny", "ñ☃a"])
def test_all_segmentations_come_once_with_their_probability(text):
    want = every(sp.BLANK + text.replace(" ", sp.BLANK))
    (rows,) = sp.sample_texts([text], keys(1), V, len(want) + 3, 1)
    got = {tuple(r[0].tolist()): r[1] for r in rows}
    assert len(rows) == len(got) == len(want)
    for ids, log in want.items():
        assert got[ids] == pytest.approx(log)
    assert all(r[3] == 1 for r in rows)
    values = [r[2] for r in rows]
    assert values == sorted(values, reverse=True)


def test_samples_are_drawn_by_probability_without_replacement():
    want = every(sp.BLANK + "thin")
    n = 6000
    found = sp.sample_texts(["thin"] * n, keys(n), V, 2, 3)
    ids = list(want)
    first, second, weighted = (dict.fromkeys(ids, 0.0) for _ in range(3))
    for rows in found:
        a, b = (tuple(r[0].tolist()) for r in rows)
        assert a != b
        first[a] += 1 / n
        second[b] += 1 / n
        for r in rows:
            weighted[tuple(r[0].tolist())] += np.exp(r[1]) / r[3] / n
    for x in ids:
        p = np.exp(want[x])
        assert first[x] == pytest.approx(p, abs=0.03)
        after = sum(np.exp(want[y]) * p / (1 - np.exp(want[y])) for y in ids if y != x)
        assert second[x] == pytest.approx(after, abs=0.03)
        # Inclusion scores make weighted samples unbiased.
        assert weighted[x] == pytest.approx(p, abs=0.04)


def test_a_row_does_not_depend_on_its_neighbours():
    texts = ["some words here", "", "other\nlines  and ▁ marks", "x" * 3000, "ärger 😀"]
    together = sp.sample_texts(texts, keys(5), V, 3, 9)
    for i, t in enumerate(texts):
        (alone,) = sp.sample_texts([t], keys(5)[i : i + 1], V, 3, 9)
        assert [(r[0].tolist(), r[1:]) for r in alone] == [(r[0].tolist(), r[1:]) for r in together[i]]
    for t, rows in zip(texts, together):
        assert {sp.decode_ids(r[0], V) for r in rows} == {t.replace("▁", " ")}
    assert len(together[1]) == 1 and together[1][0][1] == 0 and together[1][0][3] == 1


def test_words_split_before_blanks():
    texts = pa.array(["▁▁a▁b", "", "▁c"])
    borders, numbers, distinct = sp.split_words(texts)
    words = [distinct.to_pylist()[i] for i in numbers]
    assert (words, borders.tolist()) == (["▁▁a", "▁b", "▁c"], [0, 2, 2, 3])


def test_rows_and_round_trip(spark):
    rows = [(1, "a b"), (2, None), (3, ""), (None, "none"), (1, "a b"), (5, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS ids", "'s' AS sample")
    drawn = sp.sample(docs, MODEL, ["doc_id"], k=3)
    back = {}
    for r in sp.decode(drawn, MODEL, ["doc_id", "sample"]).collect():
        back.setdefault(r["doc_id"], []).append((r["sample"], r["text"]))
    assert sorted(back[1]) == [(1, "a b")] * 2 + [(2, "a b")] * 2 + [(3, "a b")] * 2
    assert back[2] == back[3] == [(1, "")]
    assert {t for _, t in back[5]} == {"word " * 30_000}
    assert sp.sample(docs.where("false"), MODEL, ["doc_id"]).collect() == []
    same = {r["sample"]: r["ids"] for r in drawn.where("doc_id = 5").collect()}
    again = sp.sample(docs.where("doc_id = 5"), MODEL, ["doc_id"], k=3).collect()
    assert same == {r["sample"]: r["ids"] for r in again}


def test_a_slice_takes_little_memory():
    rng = random.Random(3)
    texts, size = [], 0
    while size < sp.SLICE:
        texts.append(" ".join("".join(rng.choices("etaoinshrd", k=rng.randint(2, 9))) for _ in range(300)))
        size += len(texts[-1])
    tracemalloc.start()
    sp.sample_texts(texts, keys(len(texts)), V, 2, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
