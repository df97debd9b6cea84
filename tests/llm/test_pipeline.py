"""The pipeline against its stages' plain versions, and the registry of queries."""

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from tests.llm import brute
from tests.llm.test_operators import check_packing
from tidewright.llm import langid, line_dedup
from tidewright.llm.common import cut


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    known = langid.learn(docs)
    rejected = {r.doc_id for r in langid.classify(docs, known).where("rejected").collect()}
    want = [{i: t for i, t in rows.items() if i not in rejected}]
    lines = brute.line_dedup(want[-1])
    want.append({i: t for i, (n, gone, t) in lines.items() if gone < n or not gone})
    groups = {i: c for i, _, c in brute.components(sorted(want[-1].items()), 5, 80)}
    want.append({i: t for i, t in want[-1].items() if groups[i] == i})
    found = brute.repeats(want[-1])
    want.append({i: found[i][3] for i in found if found[i][1] < found[i][0] or not found[i][1]})
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = cut(stage(spark, docs, sf_dir))
        assert docs.columns == names
        got = {r.doc_id: r for r in docs.collect()}
        assert set(got) == set(want[k])
        if k < 3:
            assert {i: r.text for i, r in got.items()} == want[k]
        assert all(r.n_chars == len(r.text) for r in got.values())
    texts = sorted((i, r.text) for i, r in got.items())
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), texts)


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [(1, None, None), (2, "", "en"), (3, "ab", "en"), (3, "ab", "en"), (4, "x y z " * 300, None), (None, "some words here", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for table in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, sf_dir).collect()


def test_registry():
    queries = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in queries) == 1
    assert "pipeline" in queries and set(__spark_entry__.oracle_sql()) <= set(queries)
