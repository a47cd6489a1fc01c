"""Markdown sections by H1/H2 heading, aware of fenced code blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseek.functions import text as tx
from lodeseek.functions.lines import numbered_pieces
from lodeseek.schemas import PIECE_SCHEMA

_LINE = r"[^\n]*\n"
_FENCE = rf"{tx.INLINE_SPACE}*+(?:```|~~~)"
_HEADING = rf"{tx.INLINE_SPACE}*+##? "
_FENCED_BLOCK = rf"{_FENCE}{_LINE}(?:(?!{_FENCE}){_LINE})*+(?:{_FENCE}{_LINE}|\z)"
_BODY_LINE = rf"(?!{_HEADING})(?!{_FENCE}){_LINE}"

# A section is an optional heading line and then body lines and fenced blocks.
# Matches follow one another without gaps, so successive matching carries the
# fence state that a window over exploded lines would need a shuffle for.
# Possessive quantifiers keep the matcher iterative on long texts.
SECTION = rf"(?!\z)(?:{_HEADING}{_LINE})?+(?:{_FENCED_BLOCK}|{_BODY_LINE})*+"

_IS_HEADING = rf"\A{_HEADING}"


def raw_sections(text: Column) -> Column:
    """Array of section texts; each ends in a newline, all together are the text."""
    return F.regexp_extract_all(tx.unify_breaks(text), F.lit(SECTION), F.lit(0))


def _first_line(section: Column) -> Column:
    # An anchored search still visits every character of what it is given.
    return F.substring_index(section, "\n", 1)


def section_title(section: Column, start_line: Column, stem: Column) -> Column:
    """Heading text, `section-N` for a bare heading, the file stem before any heading."""
    line = _first_line(section)
    heading = tx.strip(F.regexp_replace(tx.strip(line), r"\A#+", ""))
    return (
        F.when(~line.rlike(_IS_HEADING), stem)
        .when(F.length(heading) == 0, F.concat(F.lit("section-"), start_line.cast("string")))
        .otherwise(heading)
    )


def numbered_sections(text: Column) -> Column:
    """Array of (text, start_line, end_line) of the sections."""
    return numbered_pieces(raw_sections(text), F.lit(1))


def is_heading_only(section: Column) -> Column:
    """A heading line followed by blank lines only."""
    line = _first_line(section)
    rest = F.substring(section, F.length(line) + 1, F.length(section))
    return line.rlike(_IS_HEADING) & tx.is_blank(rest)


def markdown_pieces(path: Column, text: Column) -> Column:
    """Array of section pieces; heading-only and blank sections are left out."""
    kept = F.filter(
        numbered_sections(text),
        lambda s: ~is_heading_only(s["text"]) & ~tx.is_blank(s["text"]),
    )
    stem = tx.file_stem(path)
    return F.transform(
        kept,
        lambda s: F.struct(
            section_title(s["text"], s["start_line"], stem).alias("symbol"),
            F.lit("section").alias("kind"),
            s["start_line"].alias("start_line"),
            s["end_line"].alias("end_line"),
            tx.drop_last_break(s["text"]).alias("content"),
        ).cast(PIECE_SCHEMA),
    )
