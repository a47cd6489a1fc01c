"""Line numbers of consecutive pieces of a text, in time linear in their number, and parts at line breaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeseek.functions.batches import slices
from lodeseek.functions.text import RARE_BREAKS

# The line breaks of `text.LINE_BREAK` as Arrow's regular expressions spell them.
_BREAK = r"[\n\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_BREAKS = rf"\r\n|\r|{_BREAK}"
_ENDED = rf"(?:\r|{_BREAK})\z"
# The breaks that end a line whatever follows.
_LONE = ("\n", *(c for c in RARE_BREAKS if c != "\r"))

_PIECE = pa.struct([("text", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])


def _numbered(pieces: pa.Array, first_line: pa.Array) -> pa.Array:
    count = pc.list_value_length(pieces).fill_null(0).to_numpy(zero_copy_only=False)
    flat = pieces.flatten()
    breaks = pc.count_substring_regex(flat, _BREAKS).to_numpy(zero_copy_only=False)
    ended = pc.match_substring_regex(flat, _ENDED).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(count)))
    before = np.concatenate(([0], np.cumsum(breaks)))
    own = np.repeat(first_line.fill_null(0).to_numpy(zero_copy_only=False) - before[offsets[:-1]], count)
    start = before[:-1] + own
    fields = [flat, pa.array(start, pa.int32()), pa.array(start + breaks - ended, pa.int32())]
    items = pa.StructArray.from_arrays(fields, fields=list(_PIECE))
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), items, mask=pieces.is_null() if pieces.null_count else None
    )


def numbered_pieces(pieces: Column, first_line: Column) -> Column:
    """(text, start_line, end_line) of pieces that follow one another without a gap.

    A piece that ends inside a line leaves the next one in that line. NULL stays NULL.
    Marked as nondeterministic: of an array that is exploded, the optimizer would infer a
    filter and evaluate it a second time below any exchange, on as few cores as the scan has.
    """
    number = F.arrow_udf("array<struct<text:string,start_line:int,end_line:int>>")(_numbered).asNondeterministic()
    return number(pieces, first_line)


def _parts(text: str, cap: int) -> Iterator[str]:
    """A text's parts of up to `cap` characters, see `numbered_parts`."""
    breaks = [c for c in _LONE if c in text]
    returns = "\r" in text
    at, size = 0, len(text)
    while size - at > cap:
        stop = at + cap
        end = max([at, *(text.rfind(c, at, stop) + 1 for c in breaks)])
        if returns:
            # Behind the last of the others only one before the window's end can precede a newline.
            own = text.rfind("\r", end, stop) + 1
            if own and text.startswith("\n", own):
                own = text.rfind("\r", end, own - 1) + 1
            end = max(end, own)
        if end == at:
            if text.startswith("\r\n", stop - 1):
                end = stop + 1
            elif text.startswith("\r\n", stop):
                end = stop + 2
            else:
                end = stop + (text[stop] == "\r" or text[stop] in _LONE)
        yield text[at:end]
        at = end
    if at < size:
        yield text[at:]


def numbered_parts(text: Column, first_line: Column, cap: int) -> Column:
    """(text, start_line, end_line) of the parts of `cap` characters, at line breaks if possible.

    A part has as many whole lines as fit; an overlong line is cut and goes on in the next
    part; a break right behind a cut stays with the cut. NULL stays NULL. Nondeterministic
    for the reason that `numbered_pieces` is.
    """

    @F.arrow_udf("array<struct<text:string,start_line:int,end_line:int>>")
    def split(texts: pa.Array, first: pa.Array) -> pa.Array:
        done, at = [], 0
        for some in slices(texts):
            parts = [t if t is None else [*_parts(t, cap)] for t in some.to_pylist()]
            done.append(_numbered(pa.array(parts, pa.list_(pa.string())), first.slice(at, len(some))))
            at += len(some)
        return pa.concat_arrays(done) if done else pa.array([], pa.list_(_PIECE))

    return split.asNondeterministic()(text, first_line)
