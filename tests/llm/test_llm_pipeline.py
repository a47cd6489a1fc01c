import time
from pathlib import Path

import pyarrow as pa
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from compare import difference, duck
from lodeseek.llm import jaccard_join, line_dedup, qgram_decon
from lodeseek.llm.queries import LLM_EXPECTED, LLM_QUERIES
from lodeseek.workspace import saved

SF_DIR = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry_point.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(LLM_QUERIES) <= set(names)


@pytest.mark.parametrize("name", sorted(LLM_EXPECTED))
def test_query_agrees_with_sql(spark, name):
    assert difference(spark, duck(SF_DIR), SF_DIR, name) is None


@pytest.mark.parametrize("name", sorted(set(LLM_QUERIES) - set(LLM_EXPECTED)))
def test_query_runs(spark, name):
    assert LLM_QUERIES[name](spark, SF_DIR).count() > 0


def test_each_stage_takes_the_rows_of_the_one_before(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
        assert ids and (before is None or ids <= before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        if name == "line_dedup":
            again = line_dedup.removed_lines(out, f"{tmp_path}/again")
            assert again.count() == 0
        if name == "near_duplicates":
            groups = jaccard_join.jaccard_groups(out, f"{tmp_path}/groups")
            assert groups.where("component_id <> doc_id").count() == 0
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
            assert qgram_decon.leaks(out, bench).count() == 0
        docs, before = out, ids


def test_stages_take_small_arrow_batches(spark):
    corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: docs)(spark, None, "")
    text = spark.range(0, 60, 1, 1).selectExpr("repeat('x', 1000000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])

    got = [r["n"] for r in text.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 60e6 and max(got) < 12e6


def test_what_a_step_shuffled_goes_with_it(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [Path(f.getPath()) for f in disk.localDirs()]

    def files():
        return {f for d in folders for f in d.rglob("shuffle_*.data")}

    docs = corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: docs)(spark, spark.range(1000), "")
    before = files()
    saved(docs.groupBy((docs["id"] % 7).alias("k")).count(), f"{tmp_path}/step")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
