"""Texts to chunks: routing by language, fallback, packing, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions import text as tx
from lodeseek.functions.ident import content_hash
from lodeseek.operators.code import CODE_LANGS, code_pieces
from lodeseek.operators.markdown import markdown_pieces
from lodeseek.operators.pack import pack_piece
from lodeseek.schemas import CHUNK_COLUMNS, PIECE_SCHEMA

MAX_CHUNK_CHARS = 2500

def whole_piece(path: Column, text: Column) -> Column:
    """A whole file as one module piece named after the file."""
    whole = tx.drop_last_break(tx.unify_breaks(text))
    return F.struct(
        tx.file_name(path).alias("symbol"),
        F.lit("module").alias("kind"),
        F.lit(1).alias("start_line"),
        (tx.newline_count(whole) + 1).alias("end_line"),
        whole.alias("content"),
    ).cast(PIECE_SCHEMA)


def chunk_texts(
    texts: DataFrame, max_chunk_chars: int = MAX_CHUNK_CHARS, keep: list[str] | None = None
) -> DataFrame:
    """Chunk a (path, lang, text) table; columns named in `keep` are carried along.

    Nothing here needs rows of two files to meet, so the plan has no shuffle:
    each text is cut inside its own row, and only the chunks are exploded.
    """
    keep = keep or []
    path, lang, text = F.col("path"), F.col("lang"), F.col("text")
    code_text = F.when(lang.isin(*CODE_LANGS), text)
    cut = texts.where(~tx.is_blank(text)).select(
        "path",
        "lang",
        "text",
        *keep,
        F.when(lang == "markdown", markdown_pieces(path, F.when(lang == "markdown", text)))
        .otherwise(code_pieces(lang, code_text))
        .alias("pieces"),
    )
    whole = F.array(whole_piece(path, text))
    pieces = F.when(F.size("pieces") > 0, F.col("pieces")).otherwise(whole)
    packed = pack_piece(F.col("piece"), max_chunk_chars)
    parts = (
        cut.select("path", "lang", *keep, F.explode(pieces).alias("piece"))
        .select("path", "lang", *keep, packed.alias("parts"))
        .select("path", "lang", *keep, F.explode("parts").alias("c"))
        .select("path", "lang", *keep, "c.*")
    )
    return parts.withColumn("content_hash", content_hash(F.col("content"))).select(
        *CHUNK_COLUMNS, *keep
    )


def chunk_files(
    files: DataFrame, max_file_bytes: int | None, max_chunk_chars: int = MAX_CHUNK_CHARS
) -> DataFrame:
    """Chunk a (path, size, content) table; unknown files, and those over a limit, give no rows."""
    if max_file_bytes is not None:
        files = files.where(F.col("size") <= max_file_bytes)
    texts = (
        files.withColumn("lang", tx.detect_lang(F.col("path")))
        .where(F.col("lang").isNotNull() & F.col("content").isNotNull())
        .select("path", "lang", tx.decode_utf8(F.col("content")).alias("text"))
    )
    return chunk_texts(texts, max_chunk_chars)
