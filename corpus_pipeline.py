"""A training corpus from raw documents: five stages, each one operator of planweave.llm.

Every stage gets all that its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planweave.llm import decontaminate, mixing, nearcopies, toxicity, wavelet
from planweave.llm.store import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity classifier (threshold 0.7) rejects go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or
    more) stays: that with the smallest doc_id. SimHash links are searched and verified first; a
    prefix filter then finds what lies beyond 2 bits."""
    return nearcopies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a window of a benchmark item go."""
    return decontaminate.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is read as often as its target asks: some documents not at all, some up to three times."""
    return mixing.repeat(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: doc_id, start, n_tokens, ids_crc32."""
    return wavelet.token_output(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_sources", mix_sources),
    ("token_output", write_tokens),
]

#: The first stages are a trained classifier and XXH64 fingerprints, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the corpus, a row for each reading of a document.

    Null and wordless texts are alike for the near-duplicate stage and have nothing to mix, so
    they go; a null id is an id like any other, sorted first; of repeated rows one stays; further
    columns pass up to the last stage, whatever their names; empty tables give no row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
