"""Texts kept for many line searches, with the trigrams that each file of them holds.

A search takes the literals that its pattern requires, and opens only files whose
summary has all of a literal's trigrams. Summaries are sets of hashed trigrams, so a
file may be opened in vain but never left out wrongly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.literals import required_literals
from lodeseek.operators.lexical import lexical_search

BITS = 20
GROUP_TEXTS = 1000
_BLOCK = 1 << 20


def trigrams(data: np.ndarray) -> np.ndarray:
    """The distinct hashed trigrams of UTF-8 bytes, as numbers of `BITS` bits."""
    data = data.astype(np.uint32)
    packed = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    return np.unique((packed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, word, bits) of a task's texts: the set's words that are not empty."""
    held: dict[str, np.ndarray] = {}
    for part in batches:
        files = part.column(0).to_pylist()
        for file, text in zip(files, part.column(1), strict=True):
            seen = held.setdefault(file, np.zeros(1 << BITS, bool))
            # A view of the text's own bytes; null has none.
            raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
            # Blocks overlap by two bytes, so that a long text loses no trigram.
            for at in range(0, max(len(raw) - 2, 0), _BLOCK):
                seen[trigrams(raw[at : at + _BLOCK + 2])] = True
    for file, seen in held.items():
        words = np.packbits(seen, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.record_batch(
            [pa.array([file] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(words[at])],
            ["file", "word", "bits"],
        )


@dataclass
class LineIndex:
    """A folder of texts (path, text, and what else they have) and its summaries."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, texts: DataFrame, path: str, group_texts: int = GROUP_TEXTS) -> LineIndex:
        """Write `texts`, at most `group_texts` to a file, without a shuffle, and sum them up."""
        spark = texts.sparkSession
        texts.write.option("maxRecordsPerFile", group_texts).parquet(f"{path}/texts")
        kept = spark.read.schema(texts.schema).parquet(f"{path}/texts")
        # A file that several tasks read has several summaries; they are united.
        rows = (
            kept.select(F.col("_metadata.file_name").alias("file"), F.col("text").cast("string"))
            .mapInArrow(_summaries, "file string, word int, bits long")
            .groupBy("file", "word")
            .agg(F.bit_or("bits").alias("bits"))
        )
        # In order of words, so that a search reads the row groups of its own words.
        ordered = rows.repartitionByRange("word").sortWithinPartitions("word", "file")
        ordered.write.parquet(f"{path}/trigrams")
        return cls(spark, path)

    def files(self, pattern: str) -> list[str] | None:
        """Names of the files that may hold a match; None where the pattern tells nothing."""
        clauses = required_literals(pattern, 3)
        if not clauses:
            return None
        held: dict[int, Column] = {}

        def has(literal: str) -> Column:
            out = F.lit(True)
            for h in trigrams(np.frombuffer(literal.encode(), np.uint8)).tolist():
                mask = int(np.array([1 << (h % 64)], np.uint64).view(np.int64)[0])
                hit = (F.col("word") == h // 64) & (F.col("bits").bitwiseAND(F.lit(mask)) != 0)
                held.setdefault(h, F.bool_or(hit).alias(f"h{h}"))
                out = out & F.col(f"h{h}")
            return out

        wanted = F.lit(True)
        for clause in clauses:
            one = F.lit(False)
            for literal in clause:
                one = one | has(literal)
            wanted = wanted & one
        words = sorted({h // 64 for h in held})
        rows = self.spark.read.parquet(f"{self.path}/trigrams").where(F.col("word").isin(words))
        # Names of files, which a scan of them holds on the driver anyway.
        found = rows.groupBy("file").agg(*held.values()).where(wanted).select("file").collect()
        return sorted(r["file"] for r in found)

    def search(self, pattern: str, **limits) -> DataFrame:
        """As `lexical_search` over all texts, opening only files that may hold a match."""
        everything = self.spark.read.parquet(f"{self.path}/texts")
        names = self.files(pattern)
        if names is None:
            texts = everything
        elif names:
            paths = [f"{self.path}/texts/{n}" for n in names]
            texts = self.spark.read.schema(everything.schema).parquet(*paths)
        else:
            texts = everything.where("false")
        return lexical_search(texts, pattern, **limits)
