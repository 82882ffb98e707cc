"""The registered queries of this subpackage, over whole tables with production parameters. Empty
tables give no row, other columns are ignored, texts may be of any length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, embedding, lmscore, mixing, pii, sharding, simhash, tokencount, toxicity, warc, wavelet


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark, sf_dir):
    """doc_id, n_tokens of each row; null and empty texts have 0, null ids and repeated rows keep theirs."""
    return tokencount.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_sharding(spark, sf_dir):
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row; a null text has size 1, a null id is a key, repeated rows get a slot each."""
    return sharding.assign(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_simhash(spark, sf_dir):
    """doc_id, fingerprint, component_id of each row; null and empty texts have fingerprint 0, a null id never names a component that has another."""
    return simhash.near_duplicate_rows(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark, sf_dir):
    """doc_id, held_out, score, predicted of each row; null and empty texts get the score of no words, without usable labels all get the prior."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op5_embedding_dedup(spark, sf_dir):
    """vec_id, n_links, component_id, kept of each row; null, empty, zero and non-finite vectors link with nothing, repeated rows link with each other."""
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_warc(spark, sf_dir):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each row; null html is empty, a null id only refers to others, repeated rows give a record each."""
    return warc.archived_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_mixing(spark, sf_dir):
    """doc_id, size, source_size, target, taken of each row; null texts have size 0, null sources are one source, of equal rows some may be taken."""
    return mixing.mixed_rows(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_pii(spark, sf_dir):
    """doc_id, n_entities, kinds, text of each row; null texts stay null, repeated rows are treated alike."""
    return pii.pseudonymized_rows(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_token_output(spark, sf_dir):
    """doc_id, start, n_tokens, ids_crc32 of each row; null and empty texts have the end id alone, a null id sorts first."""
    return wavelet.token_output(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontamination(spark, sf_dir):
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row; null texts have no words, items without an id count and add no string."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op11_lm_scoring(spark, sf_dir):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; null and empty texts are an end mark alone, a null id is learned from, repeated rows get a row each."""
    return lmscore.scores(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_collocations(spark, sf_dir):
    """lang, rank, phrase, a, l, r, n, score of each language's first 2000; null texts are empty, a null language is ``und``, repeated rows count as often as they are there."""
    return collocations.phrases(_table(spark, sf_dir, "documents").select("lang", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_token_counts, op2_sharding, op3_simhash, op4_toxicity, op5_embedding_dedup, op6_warc, op7_mixing, op8_pii, op9_token_output, op10_decontamination, op11_lm_scoring, op12_collocations]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return dict(oracles.SQL)
