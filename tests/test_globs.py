import pytest
from pyspark.sql import functions as F

from lodeseek.functions.globs import glob_matcher, matches_globs, selected

CASES = [
    (["**/*.py"], "a.py", True),
    (["**/*.py"], "x/y/a.py", True),
    (["**/*.py"], "a.pyc", False),
    (["*.py"], "x/a.py", True),
    (["/*.py"], "x/a.py", False),
    (["**/target/**"], "target/big.rs", True),
    (["**/target/**"], "a/target/nested/deeper.rs", True),
    (["**/target/**"], "target/", True),
    (["**/target/**"], "src/target.rs", False),
    (["**/target/**"], "mytarget/x", False),
    (["vendor/sub/**"], "vendor/sub/a/b.py", True),
    (["vendor/sub/**"], "x/vendor/sub/a.py", False),
    (["build/"], "build/x/y.c", True),
    (["build/"], "a/build/x.c", True),
    (["build/"], "build", False),
    (["docs"], "docs/a.md", True),
    (["docs"], "docs", True),
    (["a/*/c"], "a/b/c", True),
    (["a/*/c"], "a/b/d/c", False),
    (["a/**/c"], "a/c", True),
    (["a/**/c"], "a/x/y/c", True),
    (["?.md"], "a.md", True),
    (["?.md"], "ab.md", False),
    (["[a-c].md"], "b.md", True),
    (["[!a-c].md"], "b.md", False),
    (["[!a-c].md"], "z.md", True),
    (["*.md", "!keep.md"], "keep.md", False),
    (["*.md", "!keep.md", "x/keep.md"], "x/keep.md", True),
    (["# comment", ""], "# comment", False),
    ([r"\#x"], "#x", True),
    (["a+b(c).md"], "a+b(c).md", True),
    (["**"], "any/thing", True),
    ([".*"], "a/.hidden/x.py", True),
    (["[z-"], "[z-", True),
]


@pytest.mark.parametrize(("globs", "path", "want"), CASES)
def test_matcher(globs, path, want):
    assert glob_matcher(globs)(path) is want


def test_column_agrees_with_matcher(spark):
    df = spark.createDataFrame([(p,) for p in sorted({c[1] for c in CASES})], "p string")
    for globs in {tuple(c[0]) for c in CASES}:
        match = glob_matcher(globs)
        for r in df.select("p", matches_globs(F.col("p"), globs).alias("m")).collect():
            assert r["m"] == match(r["p"]), (globs, r["p"])


def test_exclude_beats_include(spark):
    df = spark.createDataFrame([("src/a.py",), ("node_modules/b.js",), ("src/c.txt",)], "p string")
    keep = selected(F.col("p"), ["**/*.py", "**/*.js"], ["**/node_modules/**"])
    assert [r["p"] for r in df.where(keep).collect()] == ["src/a.py"]
