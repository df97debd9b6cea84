"""Whole results where a narrower rule gave less: each case would be missed by it."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import docs_of
from tidewright.llm import line_dedup, packing, stages
from tidewright.llm.corpus_queries import op8_line_dedup

A, B = "first line of forty characters, or nearly", "second line of forty characters or nearly"


def test_line_blocks_whose_lines_have_other_earliest_holders(spark, tmp_path):
    short = "\n".join(f"short line {k}" for k in range(8))
    texts = {1: f"{A}\nown text of one", 2: f"own text of two\n{B}", 3: f"x\n{A}\n{B}\ny", 4: f"p\n{A}\n{B}\nq", 5: f"r\n{short}", 6: f"{short}\ns"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 2, 5: 0, 6: 8}


def test_line_runs_against_plain(spark):
    r = random.Random(4)
    lines = ["".join(r.choice("abcdefghij ") for _ in range(r.choice([0, 3, 15, 25, 55, 70]))) for _ in range(60)]
    rows = [(i, "\n".join(lines[(s + j) % 60] if r.random() < 0.9 else f"own line {i} {j}" for j in range(r.randint(0, 20)))) for i in range(80) for s in [r.randrange(60)]]
    rows += [(90 + k, "\n".join(r.sample(lines, 30))) for k in range(10)]  # in any order
    got = {x.doc_id: tuple(x)[1:] for x in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == brute.line_dedup(dict(rows))


def test_stages_tell_rows_apart(spark):
    t = ["\n".join(" ".join(f"{w}{k}{line}{n}" for n in range(20)) for line in "xyz") for k in range(6) for w in ["word"]]
    near = t[0].replace("word0x3", "other", 1)

    def run(stage, rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, "").collect()), key=str)

    # clean rows without an id, and of one id, each keep their own text; a row deleted whole does not come back by its id
    rows = [(1, t[0]), (5, t[0]), (5, t[1]), (5, t[2]), (None, t[3]), (None, t[4])]
    clean = sorted((r for r in rows if r != (5, t[0])), key=str)
    assert run(stages.drop_repeated_lines, rows) == clean
    assert run(stages.drop_repeated_passages, rows) == clean
    # one row of each group: a copy does not stay through another text of its id, nor an equal row beside its like
    rows = [(2, t[0]), (5, t[1]), (5, near), (6, t[2]), (6, t[2]), (None, t[3]), (None, t[3]), (None, t[4]), (None, t[0]), (7, t[4])]
    assert run(stages.keep_one_of_each_group, rows) == sorted([(2, t[0]), (5, t[1]), (6, t[2]), (None, t[3]), (7, t[4])], key=str)


def test_neighbours_are_scored_by_all_terms():
    r = np.random.default_rng(0)
    documents = [r.integers(0, 400, 150).astype(np.uint32) for _ in range(80)]
    held = np.array([np.bincount(d, minlength=400) for d in documents])
    n = (held > 0).sum(0)
    idf = np.log(1 + (80 - n + 0.5) / (n + 0.5))
    weight = idf * held * (packing.K1 + 1) / (held + packing.K1)  # all are of the mean length
    index = packing.Index(documents, n, 80, 150.0)
    for seed in range(80):
        used = np.zeros(80, bool)
        used[seed] = True
        score = weight[:, held[seed] > 0].sum(1)
        score[seed] = 0
        assert index.neighbours(seed, used, 10).tolist() == np.argsort(-score, kind="stable")[:10].tolist()
