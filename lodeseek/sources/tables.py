"""Retrieval inputs derived from the analytic tables, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions import text as tx
from lodeseek.functions.ident import chunk_id, content_hash
from lodeseek.schemas import STORED_COLUMNS, STORED_SCHEMA
from lodeseek.workspace import spread

KINDS = ("function", "method", "class", "impl", "module", "section")
LANGS = ("rust", "go", "javascript", "typescript", "tsx", "java", "kotlin")
# Fixed formats: the first line, the line per text line and the last line of a
# derived source; %1$d is the line's number, %2$d its length.
SOURCES = {
    "rust": ("mod a;", "pub fn f%1$d(x: u8) -> u64 { %2$d }", "// end }"),
    "go": ("package a", "func f%1$d(x int) int { return %2$d }", "// end }"),
    "javascript": ("// {", "function f%1$d(x) { return %2$d }", '"}"'),
    "typescript": ("// {", "export function f%1$d(x: number): number { return %2$d }", '"}"'),
    "tsx": ("// {", "async function f%1$d(x: number) { return %2$d }", '"}"'),
    "java": ("class D {", "  int f%1$d(int x) { return %2$d; }", "}"),
    "kotlin": ("package a", "fun f%1$d(x: Int): Int { return %2$d }", "// end }"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path(suffix: str = ".md") -> Column:
    return F.concat(
        F.lit("src/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(suffix)
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as markdown files."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id", document_path().alias("path"), F.lit("markdown").alias("lang"), "text"
    )


def document_files(texts: DataFrame) -> DataFrame:
    """A (path, text) table as (path, size, content) file rows."""
    content = F.encode("text", "UTF-8")
    return texts.select(
        "path", F.octet_length("text").cast("bigint").alias("size"), content.alias("content")
    )


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their URL, without scheme, query and fragment, as path."""
    bare = F.regexp_replace("url", "^https?://|[?#].*$", "")
    path = F.concat(F.col("page_id").cast("string"), F.lit("/"), bare)
    return spread(table(spark, sf_dir, "pages")).select(
        path.alias("path"), F.lit("html").alias("lang"), F.col("html").alias("text")
    )


def turn_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as markdown: a title, then a section per text line."""
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n## Next\n"))
    text = F.concat(F.lit("\nby a user\n# "), F.col("role"), F.lit("\n## Empty\n\n## Said\n"), body)
    return spread(table(spark, sf_dir, "conversations")).select(
        _turn_path(), F.lit("markdown").alias("lang"), text.alias("text")
    )


def turn_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with fenced code whose `#` lines are no headings."""
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n# not a heading\n"))
    text = F.concat(
        F.lit("# Log\n```sh\n"), body, F.lit("\n~~~\n## After\n"), F.col("role"), F.lit("\n  ```\n# x")
    )
    return spread(table(spark, sf_dir, "conversations")).select(
        _turn_path(), F.lit("markdown").alias("lang"), text.alias("text")
    )


def _turn_path() -> Column:
    parts = [F.lit("chats/"), F.col("conv_id").cast("string"), F.lit("/")]
    return F.concat(*parts, F.col("turn").cast("string"), F.lit(".md")).alias("path")


def _numbered(template: str) -> Column:
    """One entry per text line, made of its number and length."""
    return F.transform(
        tx.split_lines(F.col("text")),
        lambda line, i: F.format_string(template, i, F.length(line)),
    )


def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python module per document: one class, one function per text line."""
    functions = _numbered("def f%1$d(x):\n    return %2$d")
    head = F.format_string("class D%d:\n    size = %d\n\n", "doc_id", "n_chars")
    return spread(table(spark, sf_dir, "documents")).select(
        document_path(".py").alias("path"),
        F.lit("python").alias("lang"),
        F.concat(head, F.array_join(functions, "\n\n")).alias("text"),
    )


def brace_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source per document in one of the brace languages, one function per text line."""
    docs = spread(table(spark, sf_dir, "documents"))
    nth = F.pmod("doc_id", F.lit(len(LANGS)))
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]), (nth + 1).cast("int"))
    text = F.lit(None).cast("string")
    for i, name in enumerate(LANGS):
        first, each, last = SOURCES[name]
        lines = _numbered(each)
        body = F.concat(F.lit(first + "\n"), F.array_join(lines, "\n"), F.lit("\n" + last))
        text = F.when(nth == i, body).otherwise(text)
    return docs.select(
        F.concat(document_path(""), F.lit("."), lang).alias("path"),
        lang.alias("lang"),
        text.alias("text"),
    )


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with path, language, kind and a symbol made from a part name."""
    vectors = table(spark, sf_dir, "embeddings")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("vec_id"), "p_name")
    label = F.col("label")
    kinds = F.array(*[F.lit(k) for k in KINDS])
    langs = F.array(*[F.lit(x) for x in LANGS])
    snake = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    symbol = (
        F.when(label < 3, F.concat(F.lit("test_"), snake))
        .when(label < 7, snake)
        .otherwise(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")))
    )
    return vectors.join(parts, "vec_id", "left").select(
        F.col("vec_id").alias("id"),
        F.format_string("lib%d/v%d", "label", "vec_id").alias("path"),
        F.element_at(langs, F.pmod(label, F.lit(len(LANGS))) + 1).alias("lang"),
        F.element_at(kinds, F.pmod(label, F.lit(len(KINDS))) + 1).alias("kind"),
        F.coalesce(symbol, F.lit("anon")).alias("symbol"),
        "label",
        F.col("embedding").alias("vector"),
    )


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a chunk table, one chunk each, without vectors."""
    return _as_stored(document_texts(spark, sf_dir))


def incoming_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: toxic ones with a new text, the others unchanged."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    texts = document_texts(spark, sf_dir).join(labels, "doc_id")
    changed = F.when(F.col("toxic") == 1, F.concat("text", F.lit("\nreviewed")))
    return _as_stored(texts.withColumn("text", changed.otherwise(F.col("text"))))


def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as changes: documents that are poor but not toxic are deleted, others modified."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    gone = (F.col("quality") == 0) & (F.coalesce("toxic", F.lit(0)) == 0)
    return document_texts(spark, sf_dir).join(labels, "doc_id").select(
        F.when(gone, "deleted").otherwise("modified").alias("change"),
        "path",
        F.timestamp_seconds(F.lit(0)).alias("ts"),
        F.col("doc_id").alias("seq"),
    )


def renamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents, toxic ones under another symbol and thus another id."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    docs = document_texts(spark, sf_dir).join(labels, "doc_id")
    symbol = F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(tx.file_stem(F.col("path")))
    return _as_stored(docs, symbol)


def all_columns(rows: DataFrame) -> DataFrame:
    """Rows of a chunk table with nulls for what they do not have."""
    missing = [f for f in STORED_SCHEMA.fields if f.name not in rows.columns]
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).select(
        *STORED_COLUMNS
    )


def _as_stored(texts: DataFrame, symbol: Column | None = None) -> DataFrame:
    symbol = tx.file_stem(F.col("path")) if symbol is None else symbol
    line = F.lit(1)
    return texts.select(
        chunk_id(F.col("path"), symbol, line).alias("id"),
        "path",
        symbol.alias("symbol"),
        line.alias("start_line"),
        F.col("text").alias("content"),
        content_hash(F.col("text")).alias("content_hash"),
        F.timestamp_seconds(F.lit(0)).alias("indexed_at"),
    )


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as file changes: the user is the file, the event type the change."""
    return table(spark, sf_dir, "events").select(*_event_columns())


def _event_columns() -> list[Column]:
    change = F.create_map(
        *[F.lit(x) for x in ("signup", "added", "error", "deleted")]
    )[F.col("event_type")]
    return [
        F.coalesce(change, F.lit("modified")).alias("change"),
        F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    ]


def event_change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes, read as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
        .select(*_event_columns())
    )
