import hashlib

import pytest
from pyspark.sql import functions as F

from lodeseek.functions import ident
from lodeseek.functions import text as tx
from lodeseek.functions.tokens import query_tokens, symbol_tokens

SAMPLES = [
    "a",
    "a\n",
    "a\n\n",
    "\n",
    "a\r\nb\rc\n",
    "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i",
    "tail\r\n\r\n",
    "x\ty  z",
    "😀\n😀😀",
    "\r\r\n\n",
]


def test_lines_agree_with_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string")
    rows = df.select("t", tx.split_lines(F.col("t")).alias("l"), tx.line_count(F.col("t")).alias("n"))
    for r in rows.collect():
        assert r["l"] == r["t"].splitlines()
        assert r["n"] == len(r["t"].splitlines())


def test_blank_and_strip_agree_with_python(spark):
    samples = [*SAMPLES, "", " ", "　\x1f\n", " a b  ", "​"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    for r in df.select("t", tx.is_blank(F.col("t")).alias("b"), tx.strip(F.col("t")).alias("s")).collect():
        assert r["b"] == (not r["t"].strip())
        assert r["s"] == r["t"].strip()


def test_decode_replaces_invalid_bytes(spark):
    raw = [b"ok \xc3\xa9", b"bad \xff\xfe end", b"cut \xe2\x82"]
    df = spark.createDataFrame([(bytearray(b),) for b in raw], "c binary")
    got = [r[0] for r in df.select(tx.decode_utf8(F.col("c"))).collect()]
    assert got == [b.decode("utf-8", errors="replace") for b in raw]


@pytest.mark.parametrize(
    ("path", "lang"),
    [
        ("a/b.rs", "rust"),
        ("B.PY", "python"),
        ("x.tar.go", "go"),
        ("x.jsx", "javascript"),
        ("x.tsx", "tsx"),
        ("x.Md", "markdown"),
        ("dir.py/file", None),
        (".py", None),
        ("noext", None),
        ("x.c", None),
    ],
)
def test_detect_lang(spark, path, lang):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(tx.detect_lang(F.col("p"))).first()[0] == lang


def test_identity(spark):
    df = spark.createDataFrame([("src/it's.rs", "f:part2", 7, "é")], "p string, s string, n int, c string")
    row = df.select(
        ident.chunk_id(F.col("p"), F.col("s"), F.col("n")), ident.content_hash(F.col("c"))
    ).first()
    assert row[0] == hashlib.sha256("src/it's.rs::f:part2::7".encode()).hexdigest()[:32]
    assert row[1] == hashlib.sha256("é".encode()).hexdigest()


def test_tokens(spark):
    df = spark.createDataFrame([("TransferFeeConfig", "How to calculate the fee of a Token2022")], "s string, q string")
    row = df.select(symbol_tokens(F.col("s")), query_tokens(F.col("q"))).first()
    assert set(row[0]) == {"transferfeeconfig", "transfer", "fee", "config"}
    assert set(row[1]) == {"how", "calculate", "fee", "token2022"}
    snake = df.select(symbol_tokens(F.lit("calculate_fee"))).first()[0]
    assert sorted(snake) == ["calculate", "fee"]
