"""Function- and class-level pieces of source code.

Parsing needs the whole text of one file and nothing else, so it runs as an
Arrow UDF inside the row's task: only (lang, text) go to Python and only the
pieces come back.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseek.functions.batches import slices
from lodeseek.operators.braces import BRACE_LANGS, brace_spans
from lodeseek.schemas import PIECE_SCHEMA

# (symbol, kind, start, end): half-open code point offsets into the text.
Span = tuple[str, str, int, int]

CODE_LANGS = ("python", *BRACE_LANGS)

# Fixed pattern: a Rust module declaration without a body.
RUST_MODULE_DECL = re.compile(r"\s*(pub(\s*\([^)]*\))?\s+)?mod\s+\w+\s*;\s*")

_ARROW_PIECES = pa.list_(
    pa.struct(
        [
            ("symbol", pa.string()),
            ("kind", pa.string()),
            ("start_line", pa.int32()),
            ("end_line", pa.int32()),
            ("content", pa.string()),
        ]
    )
)


def python_spans(text: str) -> list[Span]:
    """Functions and classes at any depth; a decorator is not part of its function."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    # Python ends lines at \n, \r\n and \r only, and counts columns in bytes.
    lines = re.findall(r"[^\r\n]*(?:\r\n|[\r\n])|[^\r\n]+\Z", text)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))

    def offset(row: int, col: int) -> int:
        line = lines[row - 1]
        shift = col if line.isascii() else len(line.encode()[:col].decode())
        return starts[row - 1] + shift

    spans = []
    for node in _statements(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            start = offset(node.lineno, node.col_offset)
            spans.append((node.name, kind, start, offset(node.end_lineno, node.end_col_offset)))
    return spans


def _statements(tree: ast.Module) -> Iterator[ast.AST]:
    """All statements; definitions cannot stand inside of expressions."""
    stack: list[ast.AST] = [tree]
    while stack:
        node = stack.pop()
        for block in ("body", "orelse", "finalbody", "handlers", "cases"):
            stack.extend(getattr(node, block, ()))
        yield node


def _builtin_spans(lang: str, text: str) -> list[Span]:
    return python_spans(text) if lang == "python" else brace_spans(lang, text)


def _place(span: Span) -> tuple[int, int]:
    return span[2], -span[3]


def _between(text: str, spans: list[Span]) -> Iterator[Span]:
    """Spans of what no declaration covers, from its first visible character to its last."""
    at = 0
    for start, end in [*((s[2], s[3]) for s in spans), (len(text), len(text))]:
        gap = text[at:start]
        if gap.strip():
            lead = len(gap) - len(gap.lstrip())
            yield "", "module", at + lead, at + lead + len(gap.strip())
        at = max(at, end)


def pieces_of(lang: str, text: str, find: Callable[[str, str], Iterable[Span]]) -> list[dict]:
    """Pieces in document order: one per span, and `module` pieces of the text between them."""
    try:
        spans = sorted(set(find(lang, text)), key=_place)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    if not spans:
        return []
    pieces: dict[tuple[str, int], dict] = {}
    line, seen = 1, 0
    for symbol, kind, start, end in sorted([*spans, *_between(text, spans)], key=_place):
        content = text[start:end]
        if not content.strip():
            continue
        if lang == "rust" and kind == "module" and RUST_MODULE_DECL.fullmatch(content):
            continue
        line += text.count("\n", seen, start)
        seen = start
        own = symbol or f"{'module' if kind == 'module' else 'anon'}@{line}"
        # Rows are named by symbol and line; a second one of both gets a name of its own.
        name, n = own, 2
        while (name, line) in pieces:
            name, n = f"{own}#{n}", n + 1
        pieces[name, line] = {
            "symbol": name,
            "kind": kind,
            "start_line": line,
            "end_line": line + content.count("\n"),
            "content": content,
        }
    return list(pieces.values())


def code_pieces(
    lang: Column, text: Column, find: Callable[[str, str], Iterable[Span]] = _builtin_spans
) -> Column:
    """Array of code pieces; empty where the text is NULL, unparseable or has none.

    `find(lang, text)` returns spans and may be replaced by another parser. However many
    texts an Arrow batch has, a megabyte of them is cut at a time.
    """

    @F.arrow_udf(f"array<{PIECE_SCHEMA.simpleString()}>")
    def scan(langs: pa.Array, texts: pa.Array) -> pa.Array:
        done, at = [pa.array([], type=_ARROW_PIECES)], 0
        for some in slices(texts):
            rows = zip(langs.slice(at, len(some)).to_pylist(), some.to_pylist(), strict=True)
            cut = [pieces_of(lg, tx, find) if tx is not None else [] for lg, tx in rows]
            done.append(pa.array(cut, type=_ARROW_PIECES))
            at += len(some)
        return pa.concat_arrays(done)

    return scan(lang, text)
