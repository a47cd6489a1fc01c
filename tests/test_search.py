import pytest
from pyspark.sql import functions as F

from lodeseek.operators.lexical import is_binary, lexical_search
from lodeseek.operators.token_match import pattern_tokens, token_hits
from lodeseek.operators.structural import parse_pattern, python_hits, required_words, structural_search
from lodeseek.plans import index as ix
from lodeseek.plans.search import search_stored_each, semantic_search

TEXTS = [
    ("a.py", "python", "x = 1\ndef foo():\n    return foo_bar(x)\n"),
    ("b/c.rs", "rust", "fn foo() {}\r\n// Foo\r\n"),
    ("b/d.py", "python", "foo\nfoo\nfoo\nlast foo"),
    ("e.md", "markdown", "caffè foo\n"),
]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "path string, lang string, text string")


def lines(df):
    return [(r["path"], r["line"], r["snippet"]) for r in df.collect()]


def test_lines_in_order(texts):
    assert lines(lexical_search(texts, r"\bfoo\b")) == [
        ("a.py", 2, "def foo():"),
        ("b/c.rs", 1, "fn foo() {}"),
        ("b/d.py", 1, "foo"),
        ("b/d.py", 2, "foo"),
        ("b/d.py", 3, "foo"),
        ("b/d.py", 4, "last foo"),
        ("e.md", 1, "caffè foo"),
    ]


def test_limits_language_and_glob(texts):
    assert len(lines(lexical_search(texts, "foo", max_results=3))) == 3
    assert {p for p, _, _ in lines(lexical_search(texts, "foo", lang="rust"))} == {"b/c.rs"}
    assert {p for p, _, _ in lines(lexical_search(texts, "foo", path_glob="b/*.py"))} == {"b/d.py"}
    capped = lines(lexical_search(texts, "foo", per_file=2, path_glob="b/**"))
    assert [n for p, n, _ in capped if p == "b/d.py"] == [1, 2]


@pytest.mark.parametrize("pattern", ["foo", "last foo", "^foo$", "^fn|foo$", r"\Afoo", r"\w+\s*$", "[^(]++$", "caff.\\b"])
def test_patterns_apply_to_single_lines(texts, pattern):
    """The whole-text test before splitting must not lose a line."""
    import re

    python = pattern.replace("++", "+")
    want = [
        (p, i + 1, line)
        for p, _, t in sorted(TEXTS)
        for i, line in enumerate(t.splitlines())
        if re.search(python, line)
    ]
    assert lines(lexical_search(texts, pattern, max_results=None).orderBy("path", "line")) == want


def test_binary_content(spark):
    df = spark.createDataFrame([(bytearray(b"a\x10\x01b"),), (bytearray(b"a\x00b"),)], "c binary")
    assert [r[0] for r in df.select(is_binary(F.col("c"))).collect()] == [False, True]


SOURCE = """import os
def f(a, b=1, *args):
    print(a)
    if a == a:
        return os.path.join(a, b)
    x = foo(a, a)
    y = foo(a, b)
    lock()
    unlock()
class K(Base):
    def m(self): return foo()
"""


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("foo($A, $B)", [6, 7]),
        ("foo($A, $A)", [6]),
        ("foo($$$)", [6, 7, 11]),
        ("foo($_, $_)", [6, 7]),
        ("foo($$$ARGS, b)", [7]),
        ("$X == $X", [4]),
        ("os.path.join($$$)", [5]),
        ("def $F($$$): $$$BODY", [2, 11]),
        ("class $C($B)", [10]),
        ("return $X", [5, 11]),
        ("$V = foo($$$)", [6, 7]),
        ("lock()\nunlock()", [8]),
        ("import os", [1]),
        ("bar()", []),
    ],
)
def test_syntax_patterns(pattern, want):
    assert [h["line"] for h in python_hits(parse_pattern(pattern), SOURCE)] == want


def test_snippet_is_the_first_line_of_the_match():
    hits = python_hits(parse_pattern("def f($$$): $$$"), SOURCE)
    assert hits == [{"line": 2, "snippet": "def f(a, b=1, *args):"}]


def test_structural_search(spark):
    rows = [("a.py", "python", SOURCE), ("b.py", "python", "def broken(:"), ("c.rs", "rust", SOURCE)]
    df = spark.createDataFrame(rows, "path string, lang string, text string")
    got = structural_search(df, "foo($A, $B)", "python", max_results=1).collect()
    assert [(r["path"], r["line"], r["snippet"]) for r in got] == [("a.py", 6, "foo(a, a)")]
    plan = structural_search(df, "foo($A)", "python")._jdf.queryExecution().executedPlan().toString()
    assert "Contains(text" in plan


BRACES = """// foo(1)
fn main() {
    foo(a, b[1, 2]);
    foo(a, a); foo();
    let x = bar.baz(|y| { y + 1 }, "foo(z)");
    if x == y.z { return x; }
    /* foo(a) */ foo(
        c,
        d)
}
"""


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("foo($A, $B)", [3, 4, 7]),
        ("foo($A, $A)", [4]),
        ("foo()", [4]),
        ("foo($$$)", [3, 4, 4, 7]),
        ("let $X = $Y;", [5]),
        ("$A == $B {", [6]),
        ("if $C { $$$BODY }", [6]),
        ("fn $F($$$) { $$$ }", [2]),
        ('bar.baz($$$A, "foo(z)")', [5]),
        ("|y| { $E }", [5]),
        ("nothing($$$)", []),
    ],
)
def test_token_patterns(pattern, want):
    hits = token_hits("rust", pattern_tokens("rust", pattern), BRACES)
    assert [h["line"] for h in hits] == want


def test_structural_search_of_brace_languages(spark):
    rows = [("a.rs", "rust", BRACES), ("b.go", "go", BRACES)]
    df = spark.createDataFrame(rows, "path string, lang string, text string")
    got = structural_search(df, "foo($A, $A)", "rust").collect()
    assert [tuple(r) for r in got] == [("a.rs", 4, "foo(a, a)")]


def test_bad_patterns():
    with pytest.raises(ValueError, match="not valid Python"):
        parse_pattern("foo(")
    with pytest.raises(ValueError):
        parse_pattern("")
    assert required_words("foo($A, bar.baz, 'txt')") == ["bar", "baz", "foo"]


def test_searches_of_many_texts_open_the_winners_buckets_only(spark, project):
    files = {f"src/m{i}.py": f"def fee_{i}(x):\n    return x + {i}\n" for i in range(12)}
    cfg = project(files)
    ix.index_repo(spark, cfg)
    queries = spark.createDataFrame([(1, "fee_3"), (2, "fee_7"), (3, None), (4, " ")], "query_id int, query string")
    hits = search_stored_each(spark, cfg, queries, k=1, use_rerank=False)
    got = {r["query_id"]: r["path"] for r in hits.collect()}
    single = {q: semantic_search(spark, cfg, t, 1, use_rerank=False).first()["path"] for q, t in ((1, "fee_3"), (2, "fee_7"))}
    assert got == single
    opened = {f.split("bucket=")[1].split("/")[0] for f in hits.inputFiles() if "bucket=" in f}
    assert 1 <= len(opened) <= 2
    assert search_stored_each(spark, cfg, queries, lang="rust").count() == 0
