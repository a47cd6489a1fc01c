import hashlib
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseek.operators.chunk import chunk_files, chunk_texts
from lodeseek.operators.code import code_pieces
from lodeseek.operators.pack import pack_piece
from lodeseek.schemas import PIECE_SCHEMA


def chunks(spark, path, lang, text, cap=2500):
    df = spark.createDataFrame([(path, lang, text)], "path string, lang string, text string")
    return chunk_texts(df, cap).orderBy("start_line", F.desc("end_line")).collect()


def packed(spark, texts, cap):
    rows = [(i, ("s", "k", 10, 0, t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"i int, p {PIECE_SCHEMA.simpleString()}")
    parts = df.select("i", pack_piece(F.col("p"), cap).alias("parts"))
    out = parts.select("i", F.posexplode("parts").alias("n", "c"))
    return {(r["i"], r["n"]): r["c"] for r in out.collect()}


BREAKS = "\n\r\x0b"


def buffered(text, cap):
    """Line-by-line buffering: (content, start, end) of every part."""
    parts, buf, at = [], [], 10

    def flush():
        if buf:
            parts.append(("".join(buf).rstrip("\n"), at - len(buf), at - 1))
            buf.clear()

    for line in text.splitlines(keepends=True):
        if len(line) > cap:
            flush()
            while len(line) > cap and len(line.rstrip(BREAKS)) > cap:
                parts.append((line[:cap], at, at))
                line = line[cap:]
            if len(line) > cap:
                parts.append((line.rstrip("\n"), at, at))
                at += 1
                continue
        if buf and sum(map(len, buf)) + len(line) > cap:
            flush()
        buf.append(line)
        at += 1
    flush()
    return parts


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.text(st.sampled_from("ab😀é \n\n\r\x0b "), min_size=1, max_size=80),
        min_size=20,
        max_size=40,
    ),
    st.integers(1, 30),
)
def test_parts_agree_with_buffering(spark, texts, cap):
    got = packed(spark, texts, cap)
    for i, text in enumerate(texts):
        mine = [got[k] for k in sorted(got) if k[0] == i]
        if len(text) <= cap:
            assert [p["content"] for p in mine] == [text]
            continue
        assert [(p["content"], p["start_line"], p["end_line"]) for p in mine] == buffered(text, cap)
        assert [p["symbol"] for p in mine] == [f"s:part{n + 1}" for n in range(len(mine))]


def test_a_cap_must_be_positive(spark):
    with pytest.raises(ValueError, match="room"):
        packed(spark, ["abc"], 0)


def test_time_is_linear_in_sections(spark):
    text = "# a\nb\n" * 100_000
    df = spark.createDataFrame([("m.md", "markdown", text)], "path string, lang string, text string")
    start = time.monotonic()
    got = chunk_texts(df).agg(F.count("*"), F.max("end_line")).first()
    assert tuple(got) == (100_000, 200_000)
    assert time.monotonic() - start < 60


def test_markdown_sections(spark):
    text = "# Title\n\nintro\n\n## One\nbody\n### deeper\nx\n## Two\nmore\n"
    got = chunks(spark, "docs/a.md", "markdown", text)
    assert [(r["symbol"], r["start_line"], r["end_line"]) for r in got] == [
        ("Title", 1, 4),
        ("One", 5, 8),
        ("Two", 9, 10),
    ]
    assert {r["kind"] for r in got} == {"section"} and {r["lang"] for r in got} == {"markdown"}
    assert got[1]["content"] == "## One\nbody\n### deeper\nx"
    assert got[1]["content_hash"] == hashlib.sha256(got[1]["content"].encode()).hexdigest()


def test_no_heading_inside_of_fences(spark):
    for mark in ("```", "~~~"):
        text = f"# A\ntext\n{mark}bash\n# Setup\n## no\n{mark}\n## B\nend\n"
        assert [r["symbol"] for r in chunks(spark, "a.md", "markdown", text)] == ["A", "B"]
    open_fence = "# A\n```\n# never\n## closed\n"
    assert [r["symbol"] for r in chunks(spark, "a.md", "markdown", open_fence)] == ["A"]
    either_closes = "# A\n```\n# in\n~~~\n# B\nx\n"
    assert [r["symbol"] for r in chunks(spark, "a.md", "markdown", either_closes)] == ["A", "B"]


def test_preamble_and_bare_headings(spark):
    got = chunks(spark, "x/notes.v2.md", "markdown", "intro\n#  \nbody\n  ## ## Odd ## \nz\n#no\n")
    assert [(r["symbol"], r["start_line"]) for r in got] == [
        ("notes.v2", 1),
        ("section-2", 2),
        ("## Odd ##", 4),
    ]


def test_heading_only_sections_are_dropped(spark):
    text = "# T\nbody\n## Date\n## Version\n\n## Status\n\nlive\n"
    assert [r["symbol"] for r in chunks(spark, "a.md", "markdown", text)] == ["T", "Status"]
    fallback = chunks(spark, "d/only.md", "markdown", "# A\n## B\n## C\n")
    assert [(r["symbol"], r["kind"], r["end_line"]) for r in fallback] == [("only.md", "module", 3)]


def test_blank_sections_and_texts_give_nothing(spark):
    assert [r["symbol"] for r in chunks(spark, "a.md", "markdown", "\n\n# T\nx")] == ["T"]
    assert chunks(spark, "a.md", "markdown", " \n\t\n") == []


def test_crlf_sections(spark):
    got = chunks(spark, "a.md", "markdown", "# A\r\nx\r\n## B\r\ny\r\n")
    assert [(r["symbol"], r["content"]) for r in got] == [("A", "# A\nx"), ("B", "## B\ny")]


def test_big_section_is_split(spark):
    body = "\n".join(f"line {i} " + "x" * 40 for i in range(200))
    got = chunks(spark, "a.md", "markdown", f"# Big\n{body}\n", cap=400)
    assert len(got) > 10 and all(len(r["content"]) <= 400 for r in got)
    assert [r["symbol"] for r in got] == [f"Big:part{i + 1}" for i in range(len(got))]
    ends = [r["end_line"] for r in got]
    assert [r["start_line"] for r in got[1:]] == [e + 1 for e in ends[:-1]] and ends[-1] == 201


def test_long_texts_do_not_overflow_the_matcher(spark):
    text = "# A\n" + "word\n" * 300_000 + "```\n" + "# x\n" * 100_000 + "```\n## B\nend\n"
    df = spark.createDataFrame([("a.md", "markdown", text)], "path string, lang string, text string")
    out = chunk_texts(df).agg(F.count("*"), F.sum(F.length("content") + 1), F.max("end_line"))
    n, chars, last = out.first()
    assert (n > 500, chars, last) == (True, len(text), text.count("\n"))


PYTHON = """import os

def add(a, b):
    return a + b

@cached
class Calc:
    def mul(self, a):
        def inner(): return "é"
        return a
"""


def test_python_chunks(spark):
    got = [r for r in chunks(spark, "m.py", "python", PYTHON) if r["kind"] != "module"]
    assert [(r["symbol"], r["kind"], r["start_line"], r["end_line"]) for r in got] == [
        ("add", "function", 3, 4),
        ("Calc", "class", 7, 10),
        ("mul", "function", 8, 10),
        ("inner", "function", 9, 9),
    ]
    assert got[2]["content"].startswith("def mul(self, a):\n        def inner")
    assert got[3]["content"] == 'def inner(): return "é"'


def test_unparseable_and_flat_modules_fall_back(spark):
    flat = "\n".join(f"x{i} = {i}" for i in range(800))
    got = chunks(spark, "pkg/flat.py", "python", flat, cap=400)
    assert all(r["symbol"].startswith("flat.py:part") and len(r["content"]) <= 400 for r in got)
    assert max(r["end_line"] for r in got) == 800
    for bad in ("def broken(:\n  pass", "x = 1\x00", "def f():\n\tif 1:\n        pass"):
        (row,) = chunks(spark, "bad.py", "python", bad)
        assert (row["symbol"], row["kind"], row["content"]) == ("bad.py", "module", bad)


def test_unknown_language_falls_back(spark):
    (row,) = chunks(spark, "a.c", "c", "int main() {}\n\n")
    assert (row["symbol"], row["kind"], row["end_line"]) == ("a.c", "module", 2)


def test_no_line_of_a_whole_file_is_lost(spark):
    text = "\n".join(["x"] * 199 + ["", "y", "z"])
    (row,) = chunks(spark, "a.c", "c", text)
    assert (row["content"], row["end_line"]) == (text, 202)


def test_text_between_declarations_is_kept(spark):
    text = "import os\n\nLIMIT = 3\ndef f():\n    pass\nprint(LIMIT)\n"
    got = [(r["symbol"], r["kind"], r["content"]) for r in chunks(spark, "m.py", "python", text)]
    assert got == [
        ("module@1", "module", "import os\n\nLIMIT = 3"),
        ("f", "function", "def f():\n    pass"),
        ("module@6", "module", "print(LIMIT)"),
    ]


def test_giant_function_is_split(spark):
    text = "def giant():\n" + "".join(f"    v{i} = {i}\n" for i in range(400))
    got = chunks(spark, "g.py", "python", text)
    assert len(got) > 1 and all(len(r["content"]) <= 2500 for r in got)
    assert {r["symbol"] for r in got} == {f"giant:part{i + 1}" for i in range(len(got))}
    assert len(chunks(spark, "g.py", "python", text, cap=500)) > len(got)


def test_rust_module_declarations(spark):
    text = "pub mod a;\nmod b;\npub(crate) mod c;\n\npub fn hello() {}\npub mod helpers {\n  fn x() {}\n}\n"
    assert [r["symbol"] for r in chunks(spark, "l.rs", "rust", text)] == ["hello", "helpers", "x"]


def test_files_are_filtered_and_decoded(spark):
    rows = [
        ("a.py", 10, bytearray(b"def f(): pass")),
        ("b.txt", 10, bytearray(b"def f(): pass")),
        ("big.py", 99, bytearray(b"def g(): pass")),
        ("bad.py", 10, bytearray(b"# \xff\ndef h(): pass")),
        ("none.py", 0, None),
    ]
    df = spark.createDataFrame(rows, "path string, size bigint, content binary")
    got = sorted((r["symbol"], r["content"]) for r in chunk_files(df, 50).collect())
    assert got == [("f", "def f(): pass"), ("h", "def h(): pass"), ("module@1", "# \ufffd")]


def test_another_parser_can_be_plugged_in(spark):
    df = spark.createDataFrame([("x", "abcdef")], "lang string, text string")
    piece = code_pieces(F.col("lang"), F.col("text"), lambda lang, text: [("n", "class", 1, 4)])
    got = [(p["symbol"], p["content"]) for p in df.select(piece).first()[0]]
    assert got == [("module@1", "a"), ("n", "bcd"), ("module@1#2", "ef")]


def test_chunk_plan_has_no_shuffle(spark):
    df = spark.createDataFrame([("a.md", "markdown", "# A\nx")], "path string, lang string, text string")
    assert "Exchange" not in chunk_texts(df)._jdf.queryExecution().executedPlan().toString()


def test_parts_are_cut_without_backtracking(spark):
    df = spark.createDataFrame([(("s", "k", 1, 0, "a"),)], f"p {PIECE_SCHEMA.simpleString()}")
    plan = df.select(pack_piece(F.col("p"), 2500))._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan


@pytest.mark.parametrize("cap", [1, 3, 4])
def test_breaks_at_the_end_of_a_part(spark, cap):
    texts = ["abcd\r\nab", "abc\r\nab", "\r\n\r\n\r\n", "ab\rc\r\r\nd", "a bcdefg\n", "ab\x85\r\n\n"]
    got = packed(spark, texts, cap)
    for i, t in enumerate(texts):
        parts = re.findall(_part(cap), t) if len(t) > cap else [t]
        mine = [c["content"] for _, c in sorted((k[1], c) for k, c in got.items() if k[0] == i)]
        assert mine == ([p.rstrip("\n") for p in parts] if len(t) > cap else parts)


def _part(cap):
    """One part as a regular expression; tried from each place, it backs off to a break."""
    lone, every = (f"{c}\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029" for c in ("", "\r"))
    fits = rf".{{1,{cap}}}(?:(?<=[{lone}])|(?<=\r)(?!\n)|\Z)"
    return rf"(?s:{fits}|[^{every}]{{1,{cap}}}+(?:\r\n|[{every}])?|\r\n|[{every}])"
