"""Decoding, line splitting and language detection as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a text line may end with, and those that count
# as white space, as Python's str.splitlines and str.strip define them.
LONE_BREAKS = r"\n\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
BREAK_CHARS = rf"\r{LONE_BREAKS}"
SPACE_CHARS = (
    r"\t\n\r\x0B\x0C\x1C-\x1F \x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
)
RARE_BREAKS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
LINE_BREAK = rf"\r\n|[{BREAK_CHARS}]"
# White space that does not end a line.
INLINE_SPACE = r"[\t\x1F \u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"

# File suffix (lower case) to language name.
SUFFIX_LANG = {
    ".rs": "rust",
    ".py": "python",
    ".go": "go",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".jsx": "javascript",
    ".java": "java",
    ".kt": "kotlin",
    ".md": "markdown",
}


def decode_utf8(content: Column) -> Column:
    """Bytes to text; invalid sequences become U+FFFD instead of an error."""
    return F.make_valid_utf8(content.cast("string"))


def has_rare_breaks(text: Column) -> Column:
    """Whether lines end in anything but newlines.

    Plain substring tests cost a small part of what a regular expression over
    every character does, and most texts pass none of them.
    """
    return reduce(or_, [F.contains(text, F.lit(c)) for c in RARE_BREAKS])


def unify_breaks(text: Column) -> Column:
    """Every line ends in exactly one newline, the last one included."""
    unended = rf"(?<=[^{BREAK_CHARS}])\z"
    return (
        F.when(has_rare_breaks(text), F.regexp_replace(text, rf"{LINE_BREAK}|{unended}", "\n"))
        .when(text.endswith("\n") | (text == ""), text)
        .otherwise(F.concat(text, F.lit("\n")))
    )


def drop_last_break(text: Column) -> Column:
    """Undo the single newline that `unify_breaks` leaves at the end."""
    return F.substring(text, F.lit(1), F.length(text) - 1)


def split_lines(text: Column) -> Column:
    """Lines without their breaks and without an empty line after the last break."""
    return F.split(drop_last_break(unify_breaks(text)), "\n", -1)


def newline_count(text: Column) -> Column:
    return F.size(F.split(text, "\n")) - 1


def line_count(text: Column) -> Column:
    """Number of lines, counting a last line that has no break."""
    unended = F.when(text.endswith("\n") | (text == ""), 0).otherwise(1)
    return F.when(
        has_rare_breaks(text),
        F.regexp_count(text, F.lit(rf"{LINE_BREAK}|[^{BREAK_CHARS}]\z")),
    ).otherwise(newline_count(text) + unended)


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE_CHARS}]")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE_CHARS}]+|[{SPACE_CHARS}]+\z", "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for `.profile`, `name` and `name.`."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(file_suffix(path)))


def detect_lang(path: Column) -> Column:
    """Language of a path by its suffix, NULL where none is known."""
    known = F.create_map(*[F.lit(x) for pair in SUFFIX_LANG.items() for x in pair])
    return known[file_suffix(path)]
