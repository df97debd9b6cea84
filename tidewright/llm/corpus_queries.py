"""One query for each operator of this subpackage, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Oracles, by query.
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; it is read where it lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.common import shared_dir
    from tidewright.llm.token_blocks import read_token_files, write_token_files

    manifest = write_token_files(_table(spark, sf_dir, "documents"), shared_dir(spark), _vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, manifest, ids=False)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.pieces import piece_digests

    return piece_digests(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.quality import assess

    return assess(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.langid import classify, learn

    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return classify(docs, learn(docs)).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op2_exact_top_k"] = """
WITH x AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM x q JOIN x c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.jaccard_join import link_documents

    return link_documents(_table(spark, sf_dir, "documents"), words=4, similarity=85)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.llm.line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("kept_sha256"))
