"""The pipeline's stages, each through one operator. All but the last return the columns of documents.

A row is known by its id and a hash of its text together: ids may be null, or be shared by several texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the compression classifier rejects; it learns from the folds of documents that it may."""
    from tidewright.llm.langid import classify, learn

    return classify(docs, learn(docs), keep=docs.columns, prefix="_found_").where(~F.col("_found_rejected")).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes line blocks that align with an earlier document; documents of which nothing is left go."""
    from tidewright.llm.line_dedup import dedup_lines

    left = dedup_lines(docs, with_key=True).where((F.col("n_removed") < F.col("n_lines")) | (F.col("n_removed") == 0))
    return _with_text(docs, left.select("doc_id", "key", "text"), F.xxhash64("text"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group linked at similarity 0.8 over five-word shingles, one row: of the smallest id, a null one last."""
    from tidewright.llm.jaccard_join import link_documents

    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    groups = link_documents(keyed, words=5, similarity=80, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id").distinct()
    ids = keyed.select("_row", "doc_id").distinct()
    least = groups.join(ids, "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("least"))
    # fully equal rows become one before they are dealt
    one = keyed.groupBy("_row").agg(F.first("text").alias("text"), F.min(F.struct(*[c for c in docs.columns if c != "text"])).alias("rest"))
    return one.join(least.select("least._row").hint("merge"), "_row", "left_semi").select("text", "rest.*").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes byte strings of 100 and more that occur earlier; cut characters go whole, and so do emptied documents."""
    from tidewright.llm.suffix_dedup import remove_repeats

    left = remove_repeats(docs, with_text=True, with_key=True).where((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_removed") == 0))
    return _with_text(docs, left.select("doc_id", "key", F.col("kept_text").alias("text")), F.xxhash64(F.coalesce("text", F.lit(""))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens, lexical neighbours together."""
    from tidewright.llm.corpus_queries import _vocabulary
    from tidewright.llm.packing import pack_documents

    return pack_documents(docs, _vocabulary("word_bpe_49k.json"))


def _with_text(docs: DataFrame, texts: DataFrame, key: Column) -> DataFrame:
    """The rows that have a new text by id and ``key`` (of the old text), with it and its length in place of the old ones."""
    # rows with both equal are one document, whose new text is the same
    new = texts.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.first("text").alias("_new"))
    old = docs.withColumn("_old", key).drop("text")
    kept = old.join(new.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_old") == F.col("_key"))).withColumn("text", F.col("_new"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)
