"""Code search by syntax pattern: Python by its syntax tree, brace languages by tokens.

`$NAME` stands for one node and must be equal wherever it is repeated, `$_`
for any node, `$$$NAME` or `$$$` for any run of list items.
"""

from __future__ import annotations

import ast
import re
import warnings

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.braces import BRACE_LANGS
from lodeseek.operators.token_match import HOLE, pattern_tokens, token_hits

_MANY, _ONE = "__many_", "__one_"
_IGNORED = {"ctx", "type_comment", "type_ignores", "kind"}
_HIT_TYPE = pa.list_(pa.struct([("line", pa.int32()), ("snippet", pa.string())]))


def parse_pattern(pattern: str) -> list[ast.AST]:
    """The statements of a pattern, or its single expression."""
    source = HOLE.sub(
        lambda m: f"{_MANY}{m[1]}" if m[1] is not None else f"{_ONE}{m[2]}", pattern
    )
    try:
        body = ast.parse(source).body
    except SyntaxError as e:
        try:
            # A bare definition header stands for any body.
            body = ast.parse(f"{source.rstrip().rstrip(':')}:\n    {_MANY}").body
        except SyntaxError:
            raise ValueError(f"pattern is not valid Python: {pattern!r}") from e
    if not body:
        raise ValueError("pattern must be non-empty")
    return [n.value if isinstance(n, ast.Expr) else n for n in body]


def _hole(node, prefix: str) -> str | None:
    """Name of the placeholder that a pattern node consists of."""
    if isinstance(node, ast.Expr):
        node = node.value
    name = None
    if isinstance(node, ast.Name):
        name = node.id
    elif isinstance(node, ast.arg) and node.annotation is None:
        name = node.arg
    elif isinstance(node, ast.alias) and node.asname is None:
        name = node.name
    elif isinstance(node, str):
        name = node
    if name is not None and name.startswith(prefix):
        return name[len(prefix) :]
    return None


def _bind(name: str, value, found: dict) -> bool:
    if name in ("", "_"):
        return True
    shown = ast.dump(value) if isinstance(value, ast.AST) else repr(value)
    return found.setdefault(name, shown) == shown


def _match(pattern, node, found: dict) -> bool:
    one = _hole(pattern, _ONE)
    if one is not None and node is not None:
        return _bind(one, node, found)
    if isinstance(pattern, list):
        return isinstance(node, list) and _match_items(pattern, node, found)
    if not isinstance(pattern, ast.AST):
        return pattern == node
    if type(pattern) is not type(node):
        return False
    if isinstance(pattern, ast.arguments):
        # A lone `$$$` stands for parameters of every sort.
        given = [x for f in pattern._fields for x in [getattr(pattern, f)] if x]
        many = _hole(given[0][0], _MANY) if len(given) == 1 and given[0] == pattern.args else None
        if many is not None and len(pattern.args) == 1:
            return _bind(many, node, found)
    return all(
        _match(getattr(pattern, f, None), getattr(node, f, None), found)
        for f in pattern._fields
        # A decorator is not part of what it decorates.
        if f not in _IGNORED and not (f == "decorator_list" and not pattern.decorator_list)
    )


def _match_items(patterns: list, nodes: list, found: dict) -> bool:
    if not patterns:
        return not nodes
    many = _hole(patterns[0], _MANY)
    if many is None:
        if not nodes:
            return False
        trial = dict(found)
        if _match(patterns[0], nodes[0], trial) and _match_items(patterns[1:], nodes[1:], trial):
            found.update(trial)
            return True
        return False
    # Unnamed placeholders bind nothing, so nothing of what they skip needs to be kept.
    free = many in ("", "_")
    if len(patterns) == 1:
        held = [] if free else [ast.dump(x) if isinstance(x, ast.AST) else x for x in nodes]
        return _bind(many, held, found)
    shown: list = []
    for n in range(len(nodes) + 1):
        trial = dict(found)
        if n and not free:
            last = nodes[n - 1]
            shown.append(ast.dump(last) if isinstance(last, ast.AST) else last)
        if _bind(many, list(shown), trial) and _match_items(patterns[1:], nodes[n:], trial):
            found.update(trial)
            return True
    return False


def python_hits(pattern: list[ast.AST], text: str) -> list[dict]:
    """1-based line and first source line of every match, in document order."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    # The parser ends lines at \n, \r\n and \r only.
    lines = re.split(r"\r\n|[\r\n]", text)
    hits = []
    for node in ast.walk(tree):
        if len(pattern) == 1:
            if hasattr(node, "lineno") and not isinstance(node, ast.Expr) and _match(
                pattern[0], node, {}
            ):
                hits.append(node)
            continue
        for block in ("body", "orelse", "finalbody"):
            items = getattr(node, block, None)
            if not isinstance(items, list):
                continue
            steps = [n.value if isinstance(n, ast.Expr) else n for n in items]
            for i in range(len(steps) - len(pattern) + 1):
                if _match(pattern, steps[i : i + len(pattern)], {}):
                    hits.append(steps[i])
    hits.sort(key=lambda n: (n.lineno, n.col_offset, -n.end_lineno, -n.end_col_offset))
    out = []
    for n in hits:
        first = lines[n.lineno - 1].encode()
        stop = n.end_col_offset if n.end_lineno == n.lineno else len(first)
        snippet = first[n.col_offset : stop].decode(errors="replace")
        out.append({"line": n.lineno, "snippet": snippet})
    return out


def required_words(pattern: str) -> list[str]:
    """Identifiers that every matching source must contain."""
    plain = re.sub(r"'[^']*'|\"[^\"]*\"|`[^`]*`", " ", HOLE.sub(" ", pattern))
    return sorted(set(re.findall(r"[^\W\d]\w*", plain)))


def structural_matches(text: Column, pattern: str, lang: str) -> Column:
    """Array of (line, snippet) of one source."""
    if lang == "python":
        parsed = parse_pattern(pattern)

        def find(source: str) -> list[dict]:
            return python_hits(parsed, source)
    else:
        words = pattern_tokens(lang, pattern)

        def find(source: str) -> list[dict]:
            return token_hits(lang, words, source)

    @F.arrow_udf("array<struct<line:int,snippet:string>>")
    def search(texts: pa.Array) -> pa.Array:
        return pa.array([find(t or "") for t in texts.to_pylist()], type=_HIT_TYPE)

    return search(text)


def structural_search(
    texts: DataFrame, pattern: str, lang: str, max_results: int | None = None
) -> DataFrame:
    """(path, line, snippet) of syntax matches in a (path, lang, text) table.

    Sources that lack one of the pattern's identifiers are dropped by plain
    string tests in the scan stage, before any text is sent to Python.
    """
    if lang != "python" and lang not in BRACE_LANGS:
        raise ValueError(f"structural search does not know {lang!r}")
    sources = texts.where(F.col("lang") == lang)
    for word in required_words(pattern):
        sources = sources.where(F.contains(F.col("text"), F.lit(word)))
    hits = sources.select(
        "path", F.inline(structural_matches(F.col("text"), pattern, lang))
    ).select("path", "line", "snippet")
    if max_results is None:
        return hits
    return hits.orderBy("path", "line", "snippet").limit(max_results)
