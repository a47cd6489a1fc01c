import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodeseek.llm import token_bin as tb
from lodeseek.workspace import work_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 60_000), st.integers(0, 2**64 - 1))))
def test_words_round_trip(values):
    want = np.array(values, np.uint64)
    words, offsets = tb.pack(want)
    assert offsets[-1] == len(words)
    assert (tb.unpack(words, len(want)) == want).all()


def test_blocks_stand_alone():
    values = np.random.default_rng(1).integers(0, 50_000, 3 * tb.BLOCK + 7).astype(np.uint64)
    values[5000] = 2**63
    words, offsets = tb.pack(values)
    for b in range(4):
        part = values[b * tb.BLOCK : (b + 1) * tb.BLOCK]
        assert (tb.unpack(words[offsets[b] : offsets[b + 1]], len(part)) == part).all()
    with pytest.raises(ValueError, match="instead of"):
        tb.unpack(words[: offsets[1]], tb.BLOCK - 1)


@settings(max_examples=60, deadline=None)
@given(
    st.lists(
        st.lists(
            st.sampled_from([*"ab. ,'!9#\n\t\ré中\x00", "<|endoftext|>", " the"]), max_size=25
        ).map("".join),
        max_size=8,
    )
)
def test_words_give_the_ids_of_the_text(texts):
    got = tb.encoder_of(PATH).encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [
        PLAIN.encode(t, add_special_tokens=False).ids for t in texts
    ]


def test_documents_round_trip(spark):
    rows = [(i * 7 % 31, f"word {i} " * (i % 5)) for i in range(31)]
    rows += [(40, None), (41, ""), (42, "x\n\ny  z "), (None, "no id"), (43, "long " * 20_000)]
    rows += [(3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'a' AS ids", "1L AS start"
    )
    folder = work_path(spark, "tokens")
    manifest = tb.write_tokens(docs.repartition(5), PATH, folder)
    got = [r.asDict() for r in tb.read_tokens(spark, folder, manifest).orderBy("start").collect()]
    assert len(got) == len(rows)
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    at = 0
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(PLAIN.encode(t or "").ids + [tb.END_ID])
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"] in texts[r["doc_id"]]
        at += r["n_tokens"]
    sums = {r["start"]: r["ids_crc32"] for r in tb.read_checksums(spark, folder, manifest).collect()}
    for r in got:
        assert sums[r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())


def test_an_empty_table_has_no_files(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = work_path(spark, "tokens")
    manifest = tb.write_tokens(docs, PATH, folder)
    assert tb.read_tokens(spark, folder, manifest).collect() == []


def test_damage_is_found(tmp_path):
    fs, path = pafs.LocalFileSystem(), str(tmp_path / "a.s8b")
    writer = tb.ShardWriter(fs, path)
    writer.add(1, np.arange(100, dtype=np.uint32))
    writer.close()
    raw = (tmp_path / "a.s8b").read_bytes()
    assert next(tb.read_shard(fs, path))[2].tolist() == list(range(100))
    for bad in (raw[:-1], b"X" + raw[1:], raw[: len(raw) - 60] + b"\xff" * 30 + raw[-30:]):
        (tmp_path / "a.s8b").write_bytes(bad)
        with pytest.raises(ValueError):
            list(tb.read_shard(fs, path))
