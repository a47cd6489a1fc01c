"""The dealt operators as queries on the analytic tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import (
    ann,
    cotrain,
    jaccard_join,
    lang_id,
    line_dedup,
    packing,
    periodic,
    pii,
    qgram_decon,
    resample,
    sp_sample,
    token_bin,
    warc,
)
from lodeseek.workspace import work_path

Query = Callable[[SparkSession, str], DataFrame]
LLM_QUERIES: dict[str, Query] = {}
LLM_EXPECTED: dict[str, str] = {}


def query(f: Query) -> Query:
    LLM_QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents through Simple-8b files and back."""
    folder = work_path(spark, "tokens")
    docs = table(spark, sf_dir, "documents")
    manifest = token_bin.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_bin.read_checksums(spark, folder, manifest)


@query
def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through Zstandard archives and back."""
    folder = work_path(spark, "warc")
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


LLM_EXPECTED["op2_warc_zstd"] = """
WITH named AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha1(coalesce(html, '')) AS hex
  FROM pages
), grouped AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS response FROM named
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT)
               >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32 + 1 AS BIGINT), 1)
         FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM grouped
"""


@query
def op3_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; counts and digest are those of the base spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find_spans(docs, pii.learn(docs), ["doc_id"])

    def listed(spans: Column) -> Column:
        one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        return F.array_join(F.transform(spans, one), ",")

    def counted(spans: Column, kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(counted(base, kind) for kind in pii.KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@query
def op4_gumbel_topk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document, and whether they decode to its text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents")
    drawn = sp_sample.sample(docs, model, ["doc_id"], verify=True)
    return drawn.withColumn("n_pieces", F.size("ids"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    )
    model = lang_id.learn(docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return lang_id.predict(docs, model, ["doc_id", "held_out"])


@query
def op6_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by its text and its metadata."""
    docs = table(spark, sf_dir, "documents")
    model = cotrain.learn(docs, table(spark, sf_dir, "labels"))
    return cotrain.score(docs, model, ["doc_id"])


@query
def op7_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a part of a benchmark text, with the part."""
    return qgram_decon.leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query
def op8_jaccard_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets agree to nine tenths."""
    docs = table(spark, sf_dir, "documents")
    return jaccard_join.jaccard_groups(docs, work_path(spark, "jaccard"), width=3, percent=90)


LLM_EXPECTED["op8_jaccard_metric_join"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(
    CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s
  FROM split
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM items a JOIN items b
  ON a.item = b.item AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id AS node, doc_id AS root FROM sets
  UNION
  SELECT v, root FROM reached JOIN links ON u = node WHERE root < v
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(root) AS component_id
FROM sets JOIN reached ON node = doc_id GROUP BY doc_id, s
"""


@query
def op9_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, by inner product."""
    return ann.nearest(
        table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20, work_path(spark, "ann")
    )


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that have an earlier equal or near line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, work_path(spark, "lines"))
    return out.withColumnRenamed("_removed", "n_removed")


LLM_EXPECTED["op10_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
        FROM documents)
), visible AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM lines
  WHERE regexp_matches(line, '[^ \t\r\x0b\f]')
), firsts AS (
  SELECT line, length(line) AS n, min(place) AS place FROM visible GROUP BY line
), keyed AS (
  SELECT line, n, place, size, unnest([
    '0' || size || ' ' || substr(line, 1, size // 2),
    '1' || size || ' ' || substr(line, n - (size - size // 2) + 1, size - size // 2)]) AS half
  FROM (SELECT *, unnest([n, n - 1]) AS size FROM firsts) WHERE n >= 10 AND size >= 10
), pairs AS (
  SELECT DISTINCT a.line, a.n, b.line AS earlier, b.n AS m
  FROM keyed a JOIN keyed b ON a.half = b.half AND b.place < a.place AND abs(a.n - b.n) <= 1
), near AS (
  SELECT DISTINCT line FROM pairs
  WHERE CASE WHEN n = m
    THEN list_sum([CASE WHEN substr(line, i, 1) <> substr(earlier, i, 1) THEN 1 ELSE 0 END
                   FOR i IN range(1, n + 1)]) <= 1
    ELSE list_bool_or([
      CASE WHEN n > m THEN substr(line, 1, i - 1) || substr(line, i + 1) = earlier
           ELSE substr(earlier, 1, i - 1) || substr(earlier, i + 1) = line END
      FOR i IN range(1, greatest(n, m) + 1)]) END
), gone AS (
  SELECT v.doc_id, v.line_no FROM visible v JOIN firsts f USING (line)
  WHERE v.place <> f.place OR v.line IN (SELECT line FROM near)
)
SELECT l.doc_id,
       coalesce(string_agg(CASE WHEN g.doc_id IS NULL THEN l.line END, chr(10) ORDER BY l.line_no), '')
         AS text,
       CAST(count(g.doc_id) AS BIGINT) AS n_removed
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no
GROUP BY l.doc_id
"""


@query
def op11_radix_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words or more, drawn towards the benchmark's words."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample.resample(docs, target, work_path(spark, "resample"))


# The checksum of a word's bytes is folded over the table of 256 remainders.
LLM_EXPECTED["op11_radix_resample"] = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) t(i))
), docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), aims AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), pairs AS (
  SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM docs) GROUP BY ALL
), named AS (
  SELECT word, xor(list_reduce(
      list_prepend(4294967295::BIGINT,
        [CAST('0x' || substr(hex(encode(word)), 2 * k + 1, 2) AS BIGINT)
         FOR k IN range(octet_length(encode(word)))]),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM pairs UNION SELECT word FROM aims), crc_table
), source AS (
  SELECT bucket, sum(n) AS s FROM pairs JOIN named USING (word) GROUP BY bucket
), target AS (
  SELECT bucket, count(*) AS t FROM aims JOIN named USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(
      CAST((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM source) + 10000) AS DOUBLE)
      / CAST((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM target) + 10000) AS DOUBLE)))
    AS BIGINT) AS gain
  FROM source FULL JOIN target USING (bucket)
), sums AS (
  SELECT r, sum(n * gain) AS total, sum(n) AS n FROM pairs JOIN named USING (word)
  JOIN gains USING (bucket) GROUP BY r
), weighed AS (
  SELECT r, doc_id, len(words) AS n_features,
         CAST(coalesce(floor(CAST(total AS DOUBLE) / CAST(n AS DOUBLE)), 0) AS BIGINT) AS weight
  FROM docs LEFT JOIN sums USING (r)
), scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln(
      (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))
    AS BIGINT) AS score
  FROM weighed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS total
  FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= total * 10 // 100 THEN place END AS rank
FROM ranked
"""


@query
def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4,096 ids, by the pieces of each."""
    model = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_pieces(table(spark, sf_dir, "documents"), model)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document, one document in ten ending in a loop."""
    return periodic.find_runs(table(spark, sf_dir, "documents"), shape=periodic.looped)


# Runs by pairs of equal stretches of six words: those of one period form islands.
LLM_EXPECTED["op13_periodic_runs"] = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) t(i))
), split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         xor(list_reduce(
           list_prepend(4294967295::BIGINT, [CAST(ascii(substr(doc_id::VARCHAR, CAST(k AS BIGINT), 1)) AS BIGINT)
                                             FOR k IN range(1, len(doc_id::VARCHAR) + 1)]),
           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, crc_table
), placed AS (
  SELECT *, len(words) AS n, (h // 10) % greatest(len(words), 1) AS a FROM split
), shaped AS (
  SELECT doc_id, n, CASE WHEN h % 10 <> 0 OR n = 0 THEN words
    ELSE [words[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END
                     + 1 AS BIGINT)] FOR i IN range(n)] END AS words
  FROM placed
), word AS (
  SELECT doc_id, i - 1 AS i, words[i] AS w
  FROM (SELECT doc_id, words, unnest(range(1, n + 1)) AS i FROM shaped)
), grams AS (
  SELECT doc_id, i, hash(g) AS g FROM (
    SELECT doc_id, i, list(w) OVER (PARTITION BY doc_id ORDER BY i
                                    ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS g FROM word)
  WHERE len(g) = 6
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y
  ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i
), islands AS (
  SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 6 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM islands
  WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), collapsed AS (
  SELECT word.doc_id, string_agg(w, ' ' ORDER BY word.i) AS kept
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY word.doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
         first({'s': start, 'n': length, 'q': period} ORDER BY length DESC, start, period) AS best
  FROM runs GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period,
       1000 * best.n // best.q AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM shaped LEFT JOIN listed USING (doc_id) LEFT JOIN collapsed USING (doc_id)
"""
