"""gitignore-style globs as one anchored regular expression per list."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(part: str) -> str:
    """Regex of one path segment: `*`, `?`, `[...]` and backslash escapes."""
    out = []
    for escaped, charset, star, mark, plain in re.findall(
        r"\\(.)|\[((?:[!^]?\]?)[^\]]*)\]|(\*+)|(\?)|(.)", part, flags=re.S
    ):
        if charset:
            negate = charset[0] in "!^"
            body = re.sub(r"([\\\[&~])", r"\\\1", charset[1:] if negate else charset)
            out.append(f"(?!/)[{'^' if negate else ''}{body}]")
        elif star:
            out.append("[^/]*")
        elif mark:
            out.append("[^/]")
        else:
            out.append(re.escape(escaped or plain))
    return "".join(out)


def glob_regex(glob: str) -> str | None:
    """Regex that a whole path must match, NULL for blank and comment lines.

    A path below a matched directory matches too. Directories are given with a
    trailing slash, so that `name/` tells them from files.
    """
    glob = re.sub(r"(?<!\\)\s+$", "", glob)
    if not glob or glob.startswith("#"):
        return None
    dirs_only = glob.endswith("/")
    parts = [p for p in glob.strip("/").split("/") if p]
    if not parts:
        return None
    anchored = glob.startswith("/") or len(parts) > 1
    if not anchored and parts[0] != "**":
        parts = ["**", *parts]
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += _segment(part) + ("" if last else "/")
    if parts[-1] == "**":
        return out
    return out + ("/.*" if dirs_only else "(?:/.*)?")


def split_globs(globs: Iterable[str]) -> list[tuple[bool, str]]:
    """(matches, regex) per line in order; `!glob` lines have matches=False."""
    rules = []
    for line in globs:
        keep = not line.startswith("!")
        rx = glob_regex(line if keep else line[1:])
        if rx is not None:
            rules.append((keep, rx))
    return rules


def merge_rules(rules: list[tuple[bool, str]]) -> list[tuple[bool, str]]:
    """Join neighbouring rules of one sign into a single alternation."""
    merged: list[tuple[bool, list[str]]] = []
    for sign, rx in rules:
        if merged and merged[-1][0] == sign:
            merged[-1][1].append(rx)
        else:
            merged.append((sign, [rx]))
    return [(sign, rf"(?s)\A(?:{'|'.join(rxs)})\z") for sign, rxs in merged]


def matches_globs(path: Column, globs: Iterable[str]) -> Column:
    """Whether the last rule that fits the path is a positive one."""
    verdict = F.lit(False)
    for sign, rx in merge_rules(split_globs(globs)):
        hit = path.rlike(rx)
        verdict = (verdict | hit) if sign else (verdict & ~hit)
    return verdict


def glob_matcher(globs: Iterable[str]):
    """The same test as a plain function, for walks outside of a query plan."""
    rules = [
        (sign, re.compile(rx.replace(r"\z", r"\Z")))
        for sign, rx in merge_rules(split_globs(globs))
    ]

    def match(path: str) -> bool:
        verdict = False
        for sign, rx in rules:
            if rx.match(path):
                verdict = sign
        return verdict

    return match


def selected(path: Column, include: Iterable[str], exclude: Iterable[str]) -> Column:
    """Excluded paths lose even where an include glob fits."""
    return ~matches_globs(path, exclude) & matches_globs(path, include)
