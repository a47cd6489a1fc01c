"""Token sets of queries and symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query words that carry no meaning for symbol overlap.
STOPWORDS = (
    "the", "a", "an", "of", "for", "to", "in", "on", "and", "or",
    "is", "are", "with", "by", "at", "as", "be", "this", "that",
)
# The shapes of a lower-case word and of a camel-case part.
WORD = "[a-z0-9]+"
CAMEL_PART = "[A-Z]+(?:[a-z0-9]+)?|[a-z0-9]+"


def query_tokens(query: Column) -> Column:
    """Distinct lower-case words of a query without stopwords."""
    words = F.regexp_extract_all(F.lower(query), F.lit(WORD), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))


def symbol_tokens(symbol: Column) -> Column:
    """Distinct lower-case words of a symbol, snake-case and camel-case parts alike."""
    words = F.regexp_extract_all(F.lower(symbol), F.lit(WORD), F.lit(0))
    parts = F.regexp_extract_all(symbol, F.lit(CAMEL_PART), F.lit(0))
    return F.array_union(words, F.transform(parts, F.lower))
