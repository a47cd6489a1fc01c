"""Syntax patterns for brace languages, matched on tokens.

Where no parser is at hand, brackets say what belongs together: `$NAME` stands
for a balanced run of tokens without a comma, semicolon or line end of its own,
`$$$NAME` for any balanced run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from lodeseek.operators.braces import MASKS

HOLE = re.compile(r"\$\$\$([A-Z0-9_]*)|\$([A-Z_][A-Z0-9_]*)")
_WORDS = r"[^\W\d]\w*|\d[\w.]*|[^\w\s]"
_OPEN, _CLOSE = set("([{"), set(")]}")

# (text, start offset, end offset, whether a line ends before it)
Token = tuple[str, int, int, bool]


def tokens_of(lang: str, text: str) -> list[Token]:
    """Words, literals and single signs; comments and white space are left out."""
    out: list[Token] = []
    last = 0
    for m in re.finditer(rf"(?:{MASKS[lang]})|{_WORDS}", text, re.S):
        word = m.group().strip()
        if word.startswith(("//", "/*")):
            continue
        out.append((word, m.start(), m.end(), "\n" in text[last : m.start()]))
        last = m.end()
    return out


def pattern_tokens(lang: str, pattern: str) -> list[str]:
    """The pattern's tokens with its placeholders kept whole."""
    out: list[str] = []
    at = 0
    for hole in HOLE.finditer(pattern):
        out += [t[0] for t in tokens_of(lang, pattern[at : hole.start()])]
        out.append(hole.group())
        at = hole.end()
    out += [t[0] for t in tokens_of(lang, pattern[at:])]
    if not out:
        raise ValueError("pattern must be non-empty")
    return out


def _runs(tokens: list[Token], i: int, many: bool) -> Iterator[int]:
    """Ends of the balanced runs that begin at a token, the shortest first."""
    if many:
        yield i
    depth = 0
    for j in range(i, len(tokens)):
        text, _, _, new_line = tokens[j]
        if depth == 0 and (
            text in _CLOSE or (not many and (text in ",;" or (new_line and j > i)))
        ):
            return
        depth += (text in _OPEN) - (text in _CLOSE)
        if depth == 0:
            yield j + 1


def _end(pattern: list[str], tokens: list[Token], p: int, i: int, bound: dict) -> int | None:
    """Where the rest of the pattern ends when it goes on at token i."""
    while p < len(pattern):
        hole = HOLE.fullmatch(pattern[p])
        if hole is not None:
            break
        if i >= len(tokens) or tokens[i][0] != pattern[p]:
            return None
        p, i = p + 1, i + 1
    else:
        return i
    many = hole[1] is not None
    name = hole[1] if many else hole[2]
    for j in _runs(tokens, i, many):
        run = tuple(t[0] for t in tokens[i:j])
        if name in ("", "_") or bound.get(name, run) == run:
            end = _end(pattern, tokens, p + 1, j, {**bound, name: run})
            if end is not None:
                return end
    return None


def token_hits(lang: str, pattern: list[str], text: str) -> list[dict]:
    """1-based line and first source line of every match, in document order."""
    tokens = tokens_of(lang, text)
    hits, reached = [], set()
    line, seen = 1, 0
    for i, (_, start, _, _) in enumerate(tokens):
        end = _end(pattern, tokens, 0, i, {})
        # A later start with the same end is a tail of the match before it.
        if end is None or end == i or end in reached:
            continue
        reached.add(end)
        line += text.count("\n", seen, start)
        seen = start
        hits.append({"line": line, "snippet": text[start : tokens[end - 1][2]].splitlines()[0]})
    return hits
