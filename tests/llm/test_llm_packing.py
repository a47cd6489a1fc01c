import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodeseek.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def least_cost(at, kind, window, sentence_cut, inner_cut):
    """All ways of cutting, by a plain recurrence over pairs of places."""
    cost = {at[0]: 0.0}
    for k in range(1, len(at) - 1):
        ways = []
        for j in range(k):
            n = at[k] - at[j]
            if n <= window:
                ways.append(cost[at[j]] + (0 if n & (n - 1) == 0 else window - n))
        cost[at[k]] = min(ways) + [0, sentence_cut, inner_cut][kind[k]]
    ends = []
    for j in range(len(at) - 1):
        n = at[-1] - at[j]
        if n <= window:
            ends.append(cost[at[j]] + min(window - n, (bin(n).count("1") - 1) * inner_cut))
    return min(ends)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 9), st.integers(0, 2)), min_size=1, max_size=25),
    st.sampled_from([9, 12, 16, 31]),
)
def test_cuts_cost_as_little_as_any(steps, window):
    at = np.cumsum([0] + [n for n, _ in steps])
    kind = np.array([0] + [k for _, k in steps])
    kind[-1] = 0
    total, ends = packing.cuts(at, kind, window, 2.0, 5.0)
    assert total == pytest.approx(least_cost(at.tolist(), kind.tolist(), window, 2.0, 5.0))
    sizes = np.diff([0, *ends])
    assert ends[-1] == at[-1] and sizes.min() > 0 and sizes.max() <= window


def test_places_are_never_far_apart():
    at, kind = packing.places(1000, np.array([0, 500, 1000]), np.array([3, 490, 700]))
    assert np.diff(at).max() <= packing.INNER and at[0] == 0 and at[-1] == 1000
    assert kind[np.isin(at, [0, 500, 1000])].tolist() == [0, 0, 0]
    assert kind[np.isin(at, [3, 490, 700])].tolist() == [1, 1, 1]


@settings(max_examples=80, deadline=None)
@given(
    st.lists(
        st.lists(
            st.sampled_from([*"ab. ,'!9#\n\t\ré中\x00́ Σß", "<|endoftext|>", " the", "it's"]),
            max_size=25,
        ).map("".join),
        min_size=1,
        max_size=8,
    )
)
def test_units_give_the_ids_of_the_text(texts):
    ids, starts, ends = packing.encoder_of(PATH).encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[starts[i] : starts[i + 1]].tolist() == PLAIN.encode(t, add_special_tokens=False).ids
    assert set(ends.tolist()) <= set(range(len(ids) + 1))


def test_a_tokenizer_that_keeps_blanks_is_refused():
    with pytest.raises(ValueError, match="white space"):
        packing.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def documents(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "beta.", "gamma", "delta!", "eps\n", "Ünï,"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 900)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, " \n\t"), (None, "no id"), (73, "unbroken " * 9000)]
    rows += [(3, "again"), (3, "again")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'x' AS length", "7 AS sequence_id", "1 AS ids", "2 AS `offset`"
    )


def test_each_id_lies_in_one_piece(spark):
    rows, docs = documents(spark)
    got = packing.pack_pieces(docs.repartition(3), PATH).collect()
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(np.array(PLAIN.encode(t or "").ids + [packing.END_ID], "<u4"))
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, found in by_doc.items():
        if len(texts[d]) > 1:
            assert sum(r["length"] for r in found) == sum(map(len, texts[d]))
            continue
        at, own = 0, texts[d][0]
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(own[r["start"] : at].tobytes())
        assert at == len(own)
    padding = total = 0
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= packing.WINDOW
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padding < 0.01 * total


def test_sequences_hold_the_pieces(spark):
    _, docs = documents(spark)
    docs = docs.coalesce(1)
    sequences = {r["sequence_id"]: r for r in packing.pack_sequences(docs, PATH, pad_id=-1).collect()}
    held = {}
    for r in packing.pack_pieces(docs, PATH).collect():
        ids = sequences[r["sequence_id"]]["ids"][r["offset"] : r["offset"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
        held[r["sequence_id"]] = held.get(r["sequence_id"], 0) + r["length"]
    for name, r in sequences.items():
        n = r["n_tokens"]
        assert held[name] == n and r["ids"][n:] == [-1] * (len(r["ids"]) - n)
        assert len(r["ids"]) == (n if n & (n - 1) == 0 else packing.WINDOW)


def test_an_empty_table_has_no_sequence(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_pieces(docs, PATH).collect() == []
    assert packing.pack_sequences(docs, PATH).collect() == []
