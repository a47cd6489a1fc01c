"""One query per operator on the analytic tables."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.config import Config, EmbeddingConfig, StoreConfig
from lodeseek.functions import text as tx
from lodeseek.functions.globs import matches_globs, selected
from lodeseek.functions.tokens import query_tokens, symbol_tokens
from lodeseek.operators import merge
from lodeseek.operators.chunk import chunk_texts, whole_piece
from lodeseek.operators.embed import distinct_vectors, embed_distinct, embed_rows, skipped_rows
from lodeseek.operators.lexical import lexical_search
from lodeseek.operators.markdown import is_heading_only, numbered_sections
from lodeseek.operators.pack import pack_piece
from lodeseek.operators.rank import nearest, nearest_to_each, rerank, squared_l2
from lodeseek.operators.structural import structural_search
from lodeseek.plans.index import chunk_table, index_contents, index_in_parts, write_skip_log
from lodeseek.plans.line_index import LineIndex
from lodeseek.plans.search import prefilter, search_stored_each, semantic_search_each
from lodeseek.plans.search import semantic_search as search_stored
from lodeseek.plans.store import ChunkTable
from lodeseek.sources import tables as tb
from lodeseek.sources.git import union_changes
from lodeseek.sources.repo import list_modules
from lodeseek.streaming.watch import (
    apply_changes,
    latest_changes,
    listing_changes,
    stream_latest_changes,
)
from lodeseek.workspace import saved, work_path

# Fixed parameters of the registered queries; the expected results use the same.
QUERY_VECTOR = 7
QUERY_TEXT = "the small ring of a red gear"
INDEX_PATTERN = r"(ation|tions) [a-z]+"
WORD_PATTERN = r"(^| )(the|les?) [a-z]{9,}"
PAGE_PATTERN = "<h[1-6]>"
PAGE_GLOB = "**/*.example.com/**"
PACK_CAP = 400
HASHED = EmbeddingConfig(provider="hash", dim=64)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def six(x: str) -> Column:
    return F.round(x, 6)


def _query_vector(chunks: DataFrame) -> list[float]:
    return chunks.where(F.col("id") == QUERY_VECTOR).select("vector").first()["vector"]


# -- nearest neighbours and ranking ------------------------------------------


@query
def knn_l2_topk(spark, sf_dir):
    chunks = tb.vector_chunks(spark, sf_dir)
    hits = nearest(chunks, _query_vector(chunks), 10)
    return hits.select("id", "symbol", six("_distance").alias("distance"))


@query
def knn_filtered(spark, sf_dir):
    chunks = tb.vector_chunks(spark, sf_dir)
    rows = prefilter(chunks, lang="typescript", path_prefix="lib3/")
    hits = nearest(rows, _query_vector(chunks), 10)
    return hits.select("id", "path", "lang", six("_distance").alias("distance"))


@query
def knn_batch(spark, sf_dir):
    """The nearest of every twentieth vector."""
    chunks = tb.vector_chunks(spark, sf_dir).select("id", "vector")
    queries = chunks.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")
    near = nearest_to_each(chunks, queries, 10)
    return near.select("query_id", "id", six("_distance").alias("distance"), "rank")


@query
def knn_all(spark, sf_dir):
    """The nearest of every vector, in blocks of queries within one job."""
    chunks = tb.vector_chunks(spark, sf_dir).select("id", "vector")
    queries = chunks.withColumnRenamed("id", "query_id")
    near = nearest_to_each(chunks, queries, 3, block_bytes=100_000)
    return near.select("query_id", "id", six("_distance").alias("distance"), "rank")


@query
def rerank_hits(spark, sf_dir):
    chunks = tb.vector_chunks(spark, sf_dir)
    hits = nearest(chunks, _query_vector(chunks), 60)
    ranked = rerank(hits, query_tokens(F.lit(QUERY_TEXT))).limit(20)
    return ranked.select(
        "id",
        "symbol",
        "kind",
        six("_distance").alias("distance"),
        six("_rerank_score").alias("rerank_score"),
    )


@query
def rerank_all(spark, sf_dir):
    """The score of every chunk, not just of the nearest."""
    chunks = tb.vector_chunks(spark, sf_dir)
    distance = squared_l2(F.col("vector"), _query_vector(chunks))
    ranked = rerank(
        chunks.withColumn("_distance", distance), query_tokens(F.lit(QUERY_TEXT))
    )
    return ranked.select("id", six("_rerank_score").alias("rerank_score"))


@query
def semantic_search(spark, sf_dir):
    """Every benchmark text against all document chunks."""
    chunks = merge.with_identity(
        embed_rows(chunk_texts(tb.document_texts(spark, sf_dir)), HASHED), "hash"
    )
    rows = chunks.where(F.col("vector").isNotNull()).select(
        "id", "path", "symbol", "kind", "start_line", "vector"
    )
    return _five_best(spark, sf_dir, saved(rows, work_path(spark, "chunks")))


def _benchmark_queries(spark, sf_dir) -> DataFrame:
    return tb.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def _five_best(spark, sf_dir, rows: DataFrame) -> DataFrame:
    return _five(semantic_search_each(_benchmark_queries(spark, sf_dir), rows, HASHED, k=5))


def _five(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id",
        "rank",
        "path",
        "symbol",
        "start_line",
        six("_distance").alias("score"),
        six("_rerank_score").alias("rerank_score"),
    )


@query
def symbol_token_sets(spark, sf_dir):
    name = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    symbol = F.concat(name, F.lit("_"), F.col("p_type"), F.lit(":part1"))
    return tb.table(spark, sf_dir, "part").select(
        "p_partkey", F.explode(symbol_tokens(symbol)).alias("token")
    )


@query
def query_token_sets(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(query_tokens(F.col("text"))).alias("token")
    )


# -- line and syntax search ---------------------------------------------------


@query
def lexical_top(spark, sf_dir):
    return lexical_search(tb.document_texts(spark, sf_dir), WORD_PATTERN, max_results=50)


@query
def lexical_all(spark, sf_dir):
    return lexical_search(tb.document_texts(spark, sf_dir), WORD_PATTERN, max_results=None)


@query
def lexical_indexed(spark, sf_dir):
    """Lines of the files of texts whose trigram summaries hold the pattern's literals."""
    texts = tb.document_texts(spark, sf_dir)
    index = LineIndex.build(texts, work_path(spark, "line-index"))
    return index.search(INDEX_PATTERN)


@query
def lexical_per_file_cap(spark, sf_dir):
    texts = tb.document_texts(spark, sf_dir)
    return lexical_search(texts, WORD_PATTERN, max_results=None, per_file=2)


@query
def lexical_pages(spark, sf_dir):
    pages = tb.page_texts(spark, sf_dir)
    return lexical_search(pages, PAGE_PATTERN, path_glob=PAGE_GLOB, lang="html", max_results=None)


@query
def lexical_crlf(spark, sf_dir):
    """Line ends of texts whose lines end in a carriage return and a newline."""
    texts = tb.document_texts(spark, sf_dir).withColumn(
        "text", F.replace("text", F.lit("\n"), F.lit("\r\n"))
    )
    return lexical_search(texts, r"[a-z]\.$", max_results=None)


@query
def structural_python(spark, sf_dir):
    return structural_search(tb.python_sources(spark, sf_dir), "return $N", "python", None)


@query
def structural_rust(spark, sf_dir):
    sources = tb.brace_sources(spark, sf_dir)
    return structural_search(sources, "fn $F(x: u8) -> u64 { $N }", "rust", None)


# -- chunking -----------------------------------------------------------------


@query
def markdown_sections(spark, sf_dir):
    return _chunks(chunk_texts(tb.turn_markdown(spark, sf_dir)))


@query
def markdown_fenced(spark, sf_dir):
    return _chunks(chunk_texts(tb.turn_fenced(spark, sf_dir)))


@query
def heading_only_drop(spark, sf_dir):
    """How many sections of each file are nothing but a heading."""
    sections = tb.turn_markdown(spark, sf_dir).select(
        "path", F.explode(numbered_sections(F.col("text"))).alias("s")
    )
    return sections.groupBy("path").agg(
        F.count("*").alias("sections"),
        F.count_if(is_heading_only(F.col("s.text"))).alias("heading_only"),
    )


@query
def whole_file_chunk(spark, sf_dir):
    sentence_lines = F.replace(F.col("text"), F.lit(". "), F.lit(".\n"))
    docs = tb.document_texts(spark, sf_dir)
    return docs.select("path", sentence_lines.alias("text")).select(
        "path", F.inline(F.array(whole_piece(F.col("path"), F.col("text"))))
    )


@query
def pack_oversized(spark, sf_dir):
    piece = F.struct(
        F.lit("doc").alias("symbol"),
        F.lit("section").alias("kind"),
        F.lit(5).alias("start_line"),
        F.lit(0).alias("end_line"),
        F.col("text").alias("content"),
    )
    docs = tb.document_texts(spark, sf_dir).where(F.length("text") > PACK_CAP)
    packed = pack_piece(F.col("p"), PACK_CAP).alias("parts")
    return docs.select("path", piece.alias("p")).select("path", packed).select(
        "path", F.inline("parts")
    )


@query
def chunk_coverage(spark, sf_dir):
    """Characters of each text and of its chunks, line breaks aside: only bare headings go."""
    kept = chunk_texts(tb.document_texts(spark, sf_dir)).groupBy("path").agg(
        F.sum(F.length(F.replace("content", F.lit("\n")))).alias("kept_chars")
    )
    return (
        tb.document_texts(spark, sf_dir)
        .select("path", F.length(F.replace("text", F.lit("\n"))).alias("chars"))
        .join(kept, "path")
        .select("path", F.col("chars").cast("long"), "kept_chars")
    )


@query
def chunk_documents(spark, sf_dir):
    return _chunks(chunk_texts(tb.document_texts(spark, sf_dir)))


@query
def code_chunks_python(spark, sf_dir):
    return _chunks(chunk_texts(tb.python_sources(spark, sf_dir)))


@query
def code_chunks_braces(spark, sf_dir):
    return _chunks(chunk_texts(tb.brace_sources(spark, sf_dir)))


def _chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "path", "lang", "symbol", "kind", "start_line", "end_line", "content", "content_hash"
    )


@query
def decoded_invalid(spark, sf_dir):
    """Texts with bytes behind them that are no UTF-8."""
    docs = tb.document_texts(spark, sf_dir)
    broken = F.concat(F.col("text").cast("binary"), F.lit(bytearray(b"\xff-\xc3")))
    return docs.select("path", F.sha2(tx.decode_utf8(broken), 256).alias("digest"))


@query
def chunk_ids(spark, sf_dir):
    return tb.stored_documents(spark, sf_dir).select("path", "id", "content_hash")


# -- paths, languages, text ----------------------------------------------------


@query
def glob_filter(spark, sf_dir):
    docs = tb.document_texts(spark, sf_dir)
    keep = selected(F.col("path"), ["**/*.md", "!src/src1?/**"], ["**/src3/**", "/src/*/1*.md"])
    return docs.where(keep).select("path")


@query
def glob_pages(spark, sf_dir):
    pages = tb.page_texts(spark, sf_dir)
    hit = matches_globs(F.col("path"), ["**/*.example.*/[a-e]?/**", "*.net", "!**/9*"])
    return pages.select("path", hit.alias("hit"))


@query
def lang_detect(spark, sf_dir):
    """Languages of the derived paths of all sources."""
    braces = tb.brace_sources(spark, sf_dir)
    suffix = F.create_map(
        *[F.lit(x) for p in (("rust", "RS"), ("kotlin", "kt"), ("go", "go")) for x in p]
    )[F.col("lang")]
    path = F.concat(F.regexp_replace("path", r"\.\w+$", "."), F.coalesce(suffix, F.col("lang")))
    return braces.select(path.alias("path"), tx.detect_lang(path).alias("detected"))


@query
def size_cap(spark, sf_dir):
    files = tb.document_files(tb.document_texts(spark, sf_dir))
    return files.agg(
        F.count("*").alias("files"), F.count_if(F.col("size") > 4000).alias("oversize")
    )


@query
def decoded_lines(spark, sf_dir):
    files = tb.document_files(tb.document_texts(spark, sf_dir))
    text = tx.decode_utf8(F.col("content"))
    return files.where(~tx.is_blank(text)).select(
        "path",
        "size",
        F.length(text).alias("chars"),
        tx.line_count(text).alias("lines"),
        tx.strip(text).alias("stripped"),
    )


@query
def modules(spark, sf_dir):
    return list_modules(tb.page_texts(spark, sf_dir), ["[1-3]*/"])


# -- table changes --------------------------------------------------------------


@query
def indexed_paths(spark, sf_dir):
    return merge.indexed_paths(tb.stored_documents(spark, sf_dir))


@query
def existing_hashes(spark, sf_dir):
    stored, incoming = tb.stored_documents(spark, sf_dir), tb.incoming_documents(spark, sf_dir)
    return merge.existing_hashes(stored, incoming)


def _cache_inputs(spark, sf_dir):
    incoming = tb.incoming_documents(spark, sf_dir)
    hashes = merge.existing_hashes(tb.stored_documents(spark, sf_dir), incoming)
    return incoming, hashes


@query
def cache_hits(spark, sf_dir):
    return merge.cache_hits(*_cache_inputs(spark, sf_dir)).select("path", "content_hash")


@query
def cache_misses(spark, sf_dir):
    return merge.cache_misses(*_cache_inputs(spark, sf_dir)).select("path", "content_hash")


@query
def upsert_by_path(spark, sf_dir):
    stored, incoming = tb.stored_documents(spark, sf_dir), tb.incoming_documents(spark, sf_dir)
    return merge.replace_by_path(stored, incoming).select("id", "path", "content_hash")


@query
def upsert_by_id(spark, sf_dir):
    stored, incoming = tb.stored_documents(spark, sf_dir), tb.incoming_documents(spark, sf_dir)
    return merge.replace_by_id(stored, incoming).select("id", "path", "content_hash")


@query
def delete_path(spark, sf_dir):
    stored = tb.stored_documents(spark, sf_dir)
    return merge.delete_path(stored, "src/src0/0.md").select("id", "path")


@query
def orphan_paths(spark, sf_dir):
    return merge.orphan_paths(
        tb.stored_documents(spark, sf_dir), tb.incoming_documents(spark, sf_dir)
    )


@query
def prune_orphans(spark, sf_dir):
    return merge.prune_orphans(
        tb.stored_documents(spark, sf_dir), tb.incoming_documents(spark, sf_dir)
    ).select("id", "path")


# -- embedding -------------------------------------------------------------------


def _hashed_documents(spark, sf_dir) -> DataFrame:
    docs = tb.document_texts(spark, sf_dir).withColumnRenamed("text", "content")
    return embed_rows(docs, HASHED)


@query
def embed_stage(spark, sf_dir):
    embedded = _hashed_documents(spark, sf_dir)
    return embedded.select("path", F.posexplode("vector").alias("slot", "weight")).select(
        "path", "slot", F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


@query
def embed_once(spark, sf_dir):
    """The same through one call per distinct text."""
    docs = tb.stored_documents(spark, sf_dir).select("path", "content", "content_hash")
    embedded = embed_distinct(docs, HASHED, work_path(spark, "embed-once"))
    embedded = embedded.where(F.col("vector").isNotNull())
    return embedded.select("path", F.posexplode("vector").alias("slot", "weight")).select(
        "path", "slot", F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


@query
def embed_calls(spark, sf_dir):
    """How many texts a provider gets, and for how many documents."""
    docs = tb.stored_documents(spark, sf_dir).select("content", "content_hash")
    return distinct_vectors(docs, HASHED).agg(
        F.count("*").alias("calls"), F.sum("n").alias("documents")
    )


@query
def embed_precomputed(spark, sf_dir):
    """Documents with the vectors of a table: those of `embeddings` whose id is their own."""
    docs = tb.stored_documents(spark, sf_dir).select("path", "content_hash", "symbol")
    given = tb.table(spark, sf_dir, "embeddings").join(
        docs.where("symbol % 2 = 0").select(F.col("symbol").cast("long").alias("vec_id"), "content_hash"),
        "vec_id",
    )
    first = given.groupBy("content_hash").agg(F.min_by("embedding", "vec_id").alias("vector"))
    path = work_path(spark, "precomputed")
    first.write.parquet(path)
    cfg = EmbeddingConfig(provider="precomputed", endpoint=path, dim=64)
    out = embed_distinct(docs, cfg, work_path(spark, "embed-precomputed"))
    return out.select(
        "path", F.round(F.col("vector")[0].cast("double"), 6).alias("first"), "skip_reason"
    )


@query
def skip_log(spark, sf_dir):
    """Chunks of the pages' link texts; those without a word cannot be embedded."""
    return skipped_rows(embed_rows(_link_chunks(spark, sf_dir), HASHED))


@query
def skip_log_file(spark, sf_dir):
    """The same, written as a log of JSON lines and read back."""
    path = work_path(spark, "skip-log")
    run = embed_rows(_link_chunks(spark, sf_dir), HASHED)
    write_skip_log(run, path)
    return spark.read.schema(skipped_rows(run).schema).json(path)


def _link_chunks(spark, sf_dir) -> DataFrame:
    digits = F.regexp_replace("html", "[a-zA-Z0-9]+", "")
    return tb.table(spark, sf_dir, "pages").select(
        F.col("url").alias("path"),
        F.lit("page").alias("symbol"),
        F.lit("html").alias("lang"),
        F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"),
        F.when(F.contains("url", F.lit("#")), digits).otherwise(F.col("html")).alias("content"),
    )


# -- index runs on a real table -----------------------------------------------------


def _index_config(spark, name: str) -> Config:
    return Config(
        embedding=HASHED, store=StoreConfig(path=work_path(spark, name), buckets=16)
    )


def first_index(spark, sf_dir, name: str) -> tuple[Config, DataFrame]:
    cfg = _index_config(spark, name)
    files = tb.document_files(tb.document_texts(spark, sf_dir))
    return cfg, index_contents(spark, cfg, files, files)


def _reviewed_files(spark, sf_dir) -> DataFrame:
    docs = tb.incoming_documents(spark, sf_dir)
    return tb.document_files(docs.select("path", F.col("content").alias("text")))


@query
def index_run(spark, sf_dir):
    cfg, _ = first_index(spark, sf_dir, "index-run")
    return chunk_table(spark, cfg).rows().select(
        "id", "path", "symbol", "start_line", "end_line", "content_hash"
    )


@query
def index_commits(spark, sf_dir):
    """The same run in three commits, each of a third of the paths."""
    cfg = _index_config(spark, "index-commits")
    cfg = dataclasses.replace(cfg, index=dataclasses.replace(cfg.index, commits=3))
    files = tb.document_files(tb.document_texts(spark, sf_dir))
    index_in_parts(spark, cfg, files, lambda f: f, False, work_path(spark, "parts"))
    return chunk_table(spark, cfg).rows().select("id", "path", "symbol", "content_hash")


def _document_table(spark, sf_dir, name: str) -> ChunkTable:
    """A stored table with one row per document."""
    table = ChunkTable(spark, f"{work_path(spark, name)}/chunks", buckets=8)
    table.upsert(tb.all_columns(tb.stored_documents(spark, sf_dir)))
    return table


@query
def table_upsert_path(spark, sf_dir):
    """The stored table after labelled documents replaced their paths' rows."""
    table = _document_table(spark, sf_dir, "upsert-path")
    table.upsert(tb.all_columns(tb.incoming_documents(spark, sf_dir)))
    return table.rows().select("id", "path", "content_hash")


@query
def table_upsert_id(spark, sf_dir):
    """The same with new names for toxic documents' chunks, whose old rows stay."""
    table = _document_table(spark, sf_dir, "upsert-id")
    table.upsert(tb.all_columns(tb.renamed_documents(spark, sf_dir)), key="id")
    return table.rows().select("id", "path", "content_hash")


@query
def table_delete_path(spark, sf_dir):
    """The stored table without two paths, of which one was never in it."""
    table = _document_table(spark, sf_dir, "delete-path")
    table.delete_for_path("src/src0/0.md")
    table.delete_for_path("src/none.md")
    return table.rows().select("id", "path")


@query
def table_grown(spark, sf_dir):
    """The stored table after it grew from the labelled documents to all, buckets added on the way."""
    table = ChunkTable(spark, f"{work_path(spark, 'grown')}/chunks", buckets=2, bucket_rows=50)
    table.upsert(tb.all_columns(tb.incoming_documents(spark, sf_dir)))
    table.upsert(tb.all_columns(tb.stored_documents(spark, sf_dir)))
    return table.rows().select("id", "path", "content_hash")


@query
def stored_search(spark, sf_dir):
    """One text against the stored chunks below a path, with all that a hit shows."""
    cfg, _ = first_index(spark, sf_dir, "stored-search")
    hits = search_stored(spark, cfg, QUERY_TEXT, lang="markdown", path_prefix="src/src1")
    return hits.withColumns({"score": six("score"), "rerank_score": six("rerank_score")})


@query
def stored_search_each(spark, sf_dir):
    """Every benchmark text against the stored chunks."""
    cfg, _ = first_index(spark, sf_dir, "stored-each")
    return _five(search_stored_each(spark, cfg, _benchmark_queries(spark, sf_dir), k=5))


@query
def index_update(spark, sf_dir):
    """The table after labelled documents were indexed again."""
    cfg, _ = first_index(spark, sf_dir, "index-update")
    files = _reviewed_files(spark, sf_dir)
    index_contents(spark, cfg, files, files, use_cache=True)
    return chunk_table(spark, cfg).rows().select("id", "path", "symbol", "content_hash")


@query
def change_apply(spark, sf_dir):
    """The table after a batch of changes: poor pages go, other labelled ones are read again.

    The batch comes twice; the second time it is already there.
    """
    cfg, _ = first_index(spark, sf_dir, "change-apply")
    files = _reviewed_files(spark, sf_dir)
    changes = tb.label_changes(spark, sf_dir)
    for _ in range(2):
        apply_changes(
            spark, cfg, changes, ("labels", 0), lambda live: files.join(live, "path", "left_semi")
        )
    return chunk_table(spark, cfg).rows().select("id", "path", "symbol", "content_hash")


@query
def index_stats(spark, sf_dir):
    """The counters of that second run."""
    cfg, _ = first_index(spark, sf_dir, "index-stats")
    files = _reviewed_files(spark, sf_dir)
    run = index_contents(spark, cfg, files, files, use_cache=True)
    return merge.run_stats(files, run, 4000)


@query
def index_prune(spark, sf_dir):
    """Paths left after files without a label are gone."""
    cfg, _ = first_index(spark, sf_dir, "index-prune")
    table = chunk_table(spark, cfg)
    table.prune(tb.incoming_documents(spark, sf_dir).select("path"))
    return ChunkTable(spark, cfg.table_path).paths()


@query
def table_stats(spark, sf_dir):
    cfg, _ = first_index(spark, sf_dir, "table-stats")
    stats = chunk_table(spark, cfg).stats()
    return spark.createDataFrame([(stats["rows"], stats["table"])], "rows bigint, table string")


# -- changes ----------------------------------------------------------------------


@query
def changes_union(spark, sf_dir):
    docs, incoming = tb.stored_documents(spark, sf_dir), tb.incoming_documents(spark, sf_dir)
    return union_changes(docs, incoming, tb.event_changes(spark, sf_dir))


@query
def change_latest(spark, sf_dir):
    return latest_changes(tb.event_changes(spark, sf_dir))


@query
def change_stream(spark, sf_dir):
    return stream_latest_changes(
        tb.event_change_stream(spark, sf_dir), work_path(spark, "change-stream")
    )


@query
def change_listing(spark, sf_dir):
    """What a second listing shows that holds the labelled documents only."""
    before = tb.document_files(tb.document_texts(spark, sf_dir))
    after = _reviewed_files(spark, sf_dir)
    stamp = F.lit(0.0).alias("mtime")
    return listing_changes(before.select("path", "size", stamp), after.select("path", "size", stamp))
