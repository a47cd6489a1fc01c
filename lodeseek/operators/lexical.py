"""Regular-expression search over the lines of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import text as tx
from lodeseek.functions.globs import matches_globs
from lodeseek.functions.literals import required_literals

# Word characters are Unicode's and only a newline ends a line.
_FLAGS = "dU"

# Constructs that may match a line alone but not the same line inside its text.
_LINE_BOUND = re.compile(r"\(\?[=!<>]|\\[AzZG]|[*+?}]\+")


def holds_literals(text: Column, clauses: list[list[str]]) -> Column:
    """Whether a text has one literal of each list; a plain search of bytes."""
    out = F.lit(True)
    for clause in clauses:
        one = F.lit(False)
        for literal in clause:
            one = one | F.contains(text, F.lit(literal))
        out = out & one
    return out


def line_matches(text: Column, pattern: str, per_file: int | None = None) -> Column:
    """Array of (line, snippet) of matching lines, the first `per_file` of them.

    The cap is applied inside the row's own array, so it needs no window.
    """
    # The last newline ends a line, it does not begin one.
    body = F.when(text.endswith("\n"), tx.drop_last_break(text)).otherwise(text)
    lines = F.split(body, "\n")
    numbered = F.transform(
        lines,
        lambda line, i: F.struct(
            (i + 1).alias("line"), F.rtrim(line, F.lit("\r")).alias("snippet")
        ),
    )
    hits = F.filter(numbered, lambda x: x["snippet"].rlike(f"(?{_FLAGS}){pattern}"))
    return hits if per_file is None else F.slice(hits, 1, per_file)


def matching_lines(texts: DataFrame, pattern: str, per_file: int | None = None) -> DataFrame:
    """(path, line, snippet) of every match in a (path, text) table, unordered."""
    # Most texts match nowhere; one look at the whole text drops them before they are
    # cut into lines. Where the pattern requires literals, these are looked for alone.
    clauses = required_literals(pattern, 3)
    # Else the text is searched as it is shown, without carriage returns at line ends.
    text = F.when(
        F.contains("text", F.lit("\r")), F.regexp_replace("text", r"\r+(?=\n|\z)", "")
    ).otherwise(F.col("text"))
    if clauses:
        texts = texts.where(holds_literals(F.col("text"), clauses))
    elif not _LINE_BOUND.search(pattern):
        texts = texts.where(text.rlike(f"(?m{_FLAGS}){pattern}"))
    return texts.select(
        "path", F.inline(line_matches(F.col("text"), pattern, per_file))
    ).select("path", F.col("line").cast("int"), "snippet")


def lexical_search(
    texts: DataFrame,
    pattern: str,
    path_glob: str | None = None,
    lang: str | None = None,
    max_results: int | None = None,
    per_file: int | None = None,
) -> DataFrame:
    """Matching lines in (path, line) order, at most `max_results` of them.

    `texts` has (path, text) and, where `lang` is given, lang. In (path, line)
    order a cap per file of `max_results` never binds by itself; `per_file`
    sets a tighter one. `max_results=None` returns all lines.
    """
    if lang:
        texts = texts.where(F.col("lang") == lang)
    if path_glob:
        texts = texts.where(matches_globs(F.col("path"), [path_glob]))
    hits = matching_lines(texts, pattern, per_file)
    if max_results is None:
        return hits
    return hits.orderBy("path", "line").limit(max_results)


def is_binary(content: Column) -> Column:
    """Whether bytes hold a NUL, which line search leaves alone."""
    return F.contains(content, F.lit(bytearray(1)))
