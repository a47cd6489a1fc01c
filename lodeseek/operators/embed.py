"""Embedding providers and the column that calls them in batches."""

from __future__ import annotations

import hashlib
import http.client
import json
import math
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.config import EmbeddingConfig
from lodeseek.functions.batches import slices
from lodeseek.workspace import saved


class Embedded(NamedTuple):
    """A vector, or the reason why there is none."""

    vector: list[float] | None
    skip_reason: str | None = None


class EmbeddingProvider(Protocol):
    name: str
    dim: int
    batch_size: int

    def embed(self, texts: list[str]) -> list[Embedded]:
        """One result per text, in order."""


class _Malformed(Exception):
    """The server answered, but not with vectors of the expected shape."""


class HttpProvider:
    """An embedding server with a batch endpoint and a one-text endpoint."""

    name = "ollama"

    def __init__(self, cfg: EmbeddingConfig):
        self.dim = cfg.dim
        self.batch_size = max(1, cfg.batch_size)
        self._cfg = cfg
        self._has_batches = True

    def _post(self, route: str, **body) -> dict:
        request = urllib.request.Request(
            self._cfg.endpoint.rstrip("/") + route,
            data=json.dumps({"model": self._cfg.model, **body}).encode(),
            headers={"Content-Type": "application/json"},
        )
        with urllib.request.urlopen(request, timeout=self._cfg.timeout_seconds) as reply:
            try:
                answer = json.loads(reply.read())
            except (ValueError, http.client.HTTPException) as e:
                raise _Malformed(f"reply is not JSON: {e}") from e
            if not isinstance(answer, dict):
                raise _Malformed(f"reply is no object but {type(answer).__name__}")
            return answer

    def _checked(self, vector, text: str) -> list[float]:
        if not isinstance(vector, list) or len(vector) != self.dim:
            got = len(vector) if isinstance(vector, list) else "no vector"
            raise _Malformed(f"vector length {got}, expected {self.dim} ({len(text)} chars)")
        if not all(isinstance(x, (int, float)) and math.isfinite(x) for x in vector):
            raise _Malformed(f"vector holds what is no finite number ({len(text)} chars)")
        return vector

    def _batch(self, texts: list[str]) -> list[Embedded]:
        vectors = self._post("/api/embed", input=texts).get("embeddings")
        if not isinstance(vectors, list) or len(vectors) != len(texts):
            raise _Malformed("batch reply does not match its input")
        return [Embedded(self._checked(v, t)) for v, t in zip(vectors, texts, strict=True)]

    def _single(self, text: str) -> Embedded:
        try:
            reply = self._post("/api/embeddings", prompt=text)
            return Embedded(self._checked(reply.get("embedding"), text))
        except urllib.error.HTTPError as e:
            detail = e.read().decode(errors="replace")[:200]
            return Embedded(None, f"http_{e.code}: {detail!r}")
        except _Malformed as e:
            return Embedded(None, f"protocol: {e}")
        except (OSError, http.client.HTTPException) as e:
            return Embedded(None, f"transport: {e!r}")

    def embed(self, texts: list[str]) -> list[Embedded]:
        out: list[Embedded] = []
        for i in range(0, len(texts), self.batch_size):
            batch = texts[i : i + self.batch_size]
            try:
                if self._has_batches:
                    out += self._batch(batch)
                    continue
            except urllib.error.HTTPError as e:
                self._has_batches = e.code != 404
            except (_Malformed, OSError, http.client.HTTPException):
                pass
            # One bad text must not cost its neighbours their vectors.
            out += [self._single(t) for t in batch]
        return out


# Bytes of words as they are, all others as blanks.
_IN_WORDS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


class _Slots(dict):
    """Token -> slot, worked out once; the caller empties it when it has grown too large."""

    def __init__(self, dim: int):
        super().__init__()
        self._dim = dim

    def __missing__(self, token: bytes) -> int:
        digest = hashlib.md5(token, usedforsecurity=False).digest()
        slot = self[token] = int.from_bytes(digest[:4]) % self._dim
        return slot


class HashProvider:
    """Normalised word counts, hashed into the vector's slots; needs no server."""

    name = "hash"

    def __init__(self, cfg: EmbeddingConfig):
        self.dim = cfg.dim
        self.batch_size = max(1, cfg.batch_size)
        self._slots = _Slots(cfg.dim)

    def embed(self, texts: list[str]) -> list[Embedded]:
        # Words are parted as bytes and counted for all texts at once.
        lowered = (t.lower().encode("utf-8", "surrogatepass") for t in texts)
        words = [t.translate(_IN_WORDS).split() for t in lowered]
        count = np.fromiter(map(len, words), np.int64, len(words))
        slots = np.fromiter(
            map(self._slots.__getitem__, chain.from_iterable(words)), np.int64, int(count.sum())
        )
        if len(self._slots) > 1 << 16:
            self._slots.clear()
        slots += np.repeat(np.arange(len(words)) * self.dim, count)
        found = np.bincount(slots, minlength=len(words) * self.dim).reshape(-1, self.dim)
        vectors = found.astype(np.float64)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        vectors /= np.maximum(norms, 1.0)[:, None]
        return [
            Embedded(v) if n else Embedded(None, "protocol: no words to embed")
            for v, n in zip(vectors.astype(np.float32).tolist(), count.tolist(), strict=True)
        ]


class PrecomputedProvider:
    """Vectors that lie in a table by content, see `embed_distinct`; new texts have none."""

    name = "precomputed"

    def __init__(self, cfg: EmbeddingConfig):
        self.dim = cfg.dim
        self.batch_size = max(1, cfg.batch_size)

    def embed(self, texts: list[str]) -> list[Embedded]:
        return [Embedded(None, "precomputed: no vector of this content") for _ in texts]


PROVIDERS: dict[str, Callable[[EmbeddingConfig], EmbeddingProvider]] = {
    "ollama": HttpProvider,
    "hash": HashProvider,
    "precomputed": PrecomputedProvider,
}


def register_provider(name: str, make: Callable[[EmbeddingConfig], EmbeddingProvider]) -> None:
    PROVIDERS[name.lower()] = make


def provider_factory(cfg: EmbeddingConfig) -> Callable[[EmbeddingConfig], EmbeddingProvider]:
    make = PROVIDERS.get(cfg.provider.lower())
    if make is None:
        raise ValueError(
            f"unsupported embedding provider {cfg.provider!r}; known: {sorted(PROVIDERS)}"
        )
    return make


def get_provider(cfg: EmbeddingConfig) -> EmbeddingProvider:
    return provider_factory(cfg)(cfg)


@lru_cache(maxsize=16)
def cached_provider(cfg: EmbeddingConfig) -> EmbeddingProvider:
    """One provider per settings and process, so connections and caches live on."""
    return get_provider(cfg)


EMBEDDED_TYPE = "struct<vector:array<float>,skip_reason:string>"
_ARROW_EMBEDDED = pa.struct([("vector", pa.list_(pa.float32())), ("skip_reason", pa.string())])


def embed_column(text: Column, cfg: EmbeddingConfig) -> Column:
    """Struct of (vector, skip_reason); both NULL where the text is NULL.

    Only the text crosses to Python. Tasks hand it to the provider in its own
    batch size; a vector of the wrong length counts as skipped. However many texts an
    Arrow batch has, a megabyte of them is taken at a time.
    """
    # The factory travels with the task, so providers registered on the driver
    # work on executors too.
    factory = provider_factory(cfg)

    @F.arrow_udf(EMBEDDED_TYPE)
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        provider = factory(cfg)
        for batch in batches:
            done = [_embedded(provider, some.to_pylist()) for some in slices(batch)]
            yield pa.concat_arrays(done) if done else pa.array([], type=_ARROW_EMBEDDED)

    return embed.asNondeterministic()(text)


def _embedded(provider: EmbeddingProvider, texts: list[str | None]) -> pa.Array:
    wanted = [i for i, t in enumerate(texts) if t is not None]
    vectors: list[list[float] | None] = [None] * len(texts)
    reasons: list[str | None] = [None] * len(texts)
    step = max(1, provider.batch_size)
    for at in range(0, len(wanted), step):
        rows = wanted[at : at + step]
        results = provider.embed([texts[i] for i in rows])
        if len(results) != len(rows):
            raise RuntimeError(
                f"provider {provider.name} gave {len(results)} results for {len(rows)} texts"
            )
        for i, r in zip(rows, results, strict=True):
            vectors[i], reasons[i] = _checked_result(r, provider.dim)
    return pa.StructArray.from_arrays(
        [pa.array(vectors, pa.list_(pa.float32())), pa.array(reasons, pa.string())],
        fields=list(_ARROW_EMBEDDED),
    )


def _checked_result(result: Embedded, dim: int) -> tuple[list[float] | None, str | None]:
    if result.vector is None:
        return None, result.skip_reason or "unknown"
    if len(result.vector) != dim:
        return None, f"protocol: vector length {len(result.vector)}, expected {dim}"
    return result.vector, None


def embed_rows(
    rows: DataFrame, cfg: EmbeddingConfig, text: str = "content", where: Column | None = None
) -> DataFrame:
    """Add vector and skip_reason; rows outside `where` keep both NULL, unembedded."""
    wanted = F.col(text) if where is None else F.when(where, F.col(text))
    return (
        rows.withColumn("_embedded", embed_column(wanted, cfg))
        .select("*", "_embedded.vector", "_embedded.skip_reason")
        .drop("_embedded")
    )


# A content that at least one row in so many has is hot: there are no more hot ones than this.
HOT_SHARE = 1024


def with_vectors(rows: DataFrame, vectors: DataFrame, total: int, key: str = "content_hash") -> DataFrame:
    """`rows` with the vector and skip_reason of their key, NULL where `vectors` has none.

    `vectors` has (key, n, vector, skip_reason), n being how many of `total` rows ask for
    it; its keys are unique and not NULL. Hot keys, 1,024 at most by that count, are
    broadcast; rows of others are joined by a shuffle, which is even without the hot ones.
    Both tables are read twice.
    """
    named = vectors.withColumnRenamed(key, "_key")
    is_hot = F.col("n") * HOT_SHARE >= F.lit(total)
    hot = F.broadcast(named.where(is_hot).drop("n"))
    cold = named.where(~is_hot).drop("n")
    # Rows without a key are dealt out by themselves, since NULL is equal to nothing.
    known = rows.where(F.col(key).isNotNull())
    none = rows.where(F.col(key).isNull())
    same = F.col(key) == F.col("_key")
    return (
        known.join(hot, same)
        .unionByName(known.join(hot, same, "left_anti").join(cold, same, "left"), allowMissingColumns=True)
        .drop("_key")
        .unionByName(none, allowMissingColumns=True)
    )


def distinct_vectors(
    rows: DataFrame, cfg: EmbeddingConfig, text: str = "content", key: str = "content_hash"
) -> DataFrame:
    """(key, n, vector, skip_reason): each distinct key's text goes to the provider once.

    Equal texts meet map-side first, so a text that very many rows have is sent once per task.
    """
    wanted = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    texts = wanted.groupBy(key).agg(F.min(text).alias("_text"), F.count("*").alias("n"))
    return embed_rows(texts, cfg, "_text").drop("_text")


def embed_distinct(
    rows: DataFrame,
    cfg: EmbeddingConfig,
    folder: str,
    text: str = "content",
    key: str = "content_hash",
    where: Column | None = None,
) -> DataFrame:
    """As `embed_rows`, with each distinct content embedded once; `rows` is read three times.

    With the provider "precomputed" nothing is embedded: vectors come from the Parquet table
    at `cfg.endpoint`, (content_hash, vector), and a content without one is skipped.
    """
    asks = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    asked, rest = rows.where(asks), rows.where(~asks)
    if cfg.provider.lower() == "precomputed":
        given = rows.sparkSession.read.parquet(cfg.endpoint).select(
            F.col("content_hash").alias(key), F.col("vector").cast("array<float>").alias("vector")
        )
        fits = F.size("vector") == cfg.dim
        counts = asked.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNotNull())
        vectors = counts.join(given.where(fits).dropDuplicates([key]), key, "left").withColumn(
            "skip_reason", F.when(F.col("vector").isNull(), "precomputed: no vector of this content")
        )
    else:
        vectors = distinct_vectors(asked, cfg, text, key)
    vectors = saved(vectors, f"{folder}/vectors")
    total = vectors.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return with_vectors(asked, vectors, total, key).unionByName(rest, allowMissingColumns=True)


def skipped_rows(embedded: DataFrame) -> DataFrame:
    """What the skip log records of every chunk without a vector."""
    return embedded.where(F.col("skip_reason").isNotNull()).select(
        "path",
        "symbol",
        "lang",
        "start_line",
        "end_line",
        F.length("content").alias("chars"),
        F.col("skip_reason").alias("reason"),
    )
