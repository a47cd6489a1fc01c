"""Literals that every match of a regular expression holds."""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as op
from re import _parser as parser

# What Java reads otherwise than Python, and flags, which change what a literal matches.
_UNLIKE = re.compile(r"\\[vN0-9]|\(\?[a-zA-Z-]|\[[^\]]*(?:\[|&&)")
_REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)


def required_literals(pattern: str, least: int = 2) -> list[list[str]]:
    """Lists of literals: a match of the Java pattern holds at least one of each list.

    Literals take `least` bytes or more. Of a pattern that Java and Python may read
    differently nothing is said, nor of one without such literals.
    """
    if _UNLIKE.search(pattern):
        return []
    try:
        tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return []
    return [c for c in _clauses(tree) if _worth(c) >= least]


def _worth(clause: list[str]) -> int:
    return min(len(x.encode("utf-8", "surrogatepass")) for x in clause)


def _clauses(items: Iterable) -> list[list[str]]:
    out: list[list[str]] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            out.append(["".join(run)])
            run.clear()

    for kind, value in items:
        if kind is op.LITERAL:
            run.append(chr(value))
            continue
        # Borders and line ends take no character, so what is around them stays together.
        if kind is op.AT:
            continue
        flush()
        if kind is op.SUBPATTERN:
            out += _clauses(value[3])
        elif kind is op.ATOMIC_GROUP:
            out += _clauses(value)
        elif kind in _REPEATS and value[0] >= 1:
            out += _clauses(value[2])
        elif kind is op.BRANCH:
            ways = [_clauses(way) for way in value[1]]
            if all(ways):
                best = [max(way, key=_worth) for way in ways]
                out.append(sorted({x for clause in best for x in clause}))
    flush()
    return out
