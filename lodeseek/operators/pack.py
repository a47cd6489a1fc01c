"""Splitting an oversized piece of text at line breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseek.functions import text as tx
from lodeseek.functions.lines import numbered_parts
from lodeseek.schemas import PIECE_SCHEMA


def _strip_newlines(text: Column) -> Column:
    # General trimming visits every character; most texts end in one newline.
    return (
        F.when(text.endswith("\n\n"), F.rtrim(text, F.lit("\n")))
        .when(text.endswith("\n"), tx.drop_last_break(text))
        .otherwise(text)
    )


def pack_piece(piece: Column, cap: int) -> Column:
    """Array of one piece as it is, or of its numbered parts where it exceeds the cap."""
    if cap <= 0:
        raise ValueError(f"a part needs room for characters, not {cap}")
    content = piece["content"]
    over = F.length(content) > cap
    parts = numbered_parts(F.when(over, F.make_valid_utf8(content)), piece["start_line"], cap)

    def part(p: Column, i: Column) -> Column:
        return F.struct(
            F.concat(piece["symbol"], F.lit(":part"), (i + 1).cast("string")).alias("symbol"),
            piece["kind"].alias("kind"),
            p["start_line"].alias("start_line"),
            p["end_line"].alias("end_line"),
            _strip_newlines(p["text"]).alias("content"),
        ).cast(PIECE_SCHEMA)

    return F.when(over, F.transform(parts, part)).otherwise(F.array(piece))
