"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontaminate, embedding_join, importance, lm_scoring, ngram_join, one_bit_search, packing, periodic_runs, pii, sharding, token_alignment, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), with_tiles=False)
    return marked.select("doc_id", "contaminated", "coverage", "item_ids")


def op3_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.join(table(spark, sf_dir, "embeddings"))


def op4_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, chain).drop("text")


def op5_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_elias_fano_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op10_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op11_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_bit_search.embeddings(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.documents(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_table(table(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"))


def queries() -> dict[str, Query]:
    found = [
        op1_ngram_jaccard_join, op2_greedy_string_tiling, op3_subspace_pigeonhole, op4_classifier_chain, op5_disclosure_sanitiser,
        op6_url_vocabulary, op7_concatenate_and_cut, op8_importance_resampling, op9_elias_fano_trie, op10_weighted_hash_tree,
        op11_one_bit_search, op12_periodic_runs, op13_token_alignment,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_vocabulary": url_filter.judge_urls_sql()}
