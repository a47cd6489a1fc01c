import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.functions.literals import required_literals
from lodeseek.operators.lexical import lexical_search
from lodeseek.plans import line_index
from lodeseek.plans.line_index import LineIndex


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("transfer fee", [["transfer fee"]]),
        (r"\bfee\b.*total", [["fee"], ["total"]]),
        ("(?:alpha|beta)x", [["alpha", "beta"]]),
        ("(?:alpha|b?)x", []),
        ("(abc)+d?(ef){0,2}", [["abc"]]),
        (r"a\.b", [["a.b"]]),
        ("a[bc]d", []),
        # Read otherwise by Java, or with flags: nothing is known.
        ("(?i)alpha", []), ("[a[bc]]alpha", []), (r"\valpha", []), (r"\Qalpha\E", []),
        (r"\p{L}alpha", []), ("(alpha", []), (r"(a)\1alpha", []),
    ],
)
def test_required_literals(pattern, want):
    assert required_literals(pattern) == want


_ATOMS = st.sampled_from(["a", "b", "ab", "ba", "[ab]", ".", "b?", "(?:ab)+", "(?:a|bb)", "(a*)", "^", "$", r"\b"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_ATOMS, min_size=1, max_size=6).map("".join), st.text("ab c", max_size=12))
def test_matches_hold_their_literals(pattern, line):
    if re.search(pattern, line):
        for clause in required_literals(pattern, 1):
            assert any(x in line for x in clause)


PATTERNS = [
    "needle", r"\bneedle\d+", "(?:needle|heron) one", "x", "[a-z]+9$", "(?i)NEEDLE", "größe",
    "no such thing", r"^line\b", "end\\r?$",
]


def test_search_opens_files_that_may_match_only(spark, tmp_path):
    rows = [(f"p{i}", f"line one {i}\nline two x{i}9\n") for i in range(40)]
    rows[7] = ("p7", "a heron one\r\nneedle7 end\r\n")
    rows[21] = ("p21", None)
    rows[22] = ("p22", "")
    rows[33] = ("p33", "größe\nneedle one")
    texts = spark.createDataFrame(rows, "path string, text string").coalesce(1)
    index = LineIndex.build(texts, str(tmp_path / "ix"), group_texts=5)
    for pattern in PATTERNS:
        want = sorted(map(tuple, lexical_search(texts, pattern).collect()))
        assert sorted(map(tuple, index.search(pattern).collect())) == want, pattern
    assert len(index.files("needle")) == 2
    assert len(index.search("needle7").inputFiles()) == 1
    assert index.files("no such thing") == [] and index.files("x") is None
    first = index.search("needle", max_results=1).collect()
    assert [(r["path"], r["line"]) for r in first] == [("p33", 2)]


def test_long_texts_lose_no_trigram(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(line_index, "_BLOCK", 16)
    words = " ".join(f"w{i}q" for i in range(200))
    index = LineIndex.build(spark.createDataFrame([("a", words)], "path string, text string"), str(tmp_path / "ix"))
    assert all(len(index.files(f"w{i}q")) == 1 for i in (0, 57, 199))
    raw = np.frombuffer(words.encode(), np.uint8)
    assert len(line_index.trigrams(raw)) == len({words[i : i + 3] for i in range(len(words) - 2)})


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "path string, text string, lang string")
    index = LineIndex.build(empty, str(tmp_path / "ix"))
    assert index.search("needle", lang="py").collect() == []
    assert index.search("x", path_glob="**").collect() == []
