"""The corpus pipeline: five stages from raw documents to files of token ids.

Each stage takes what its predecessor kept, all of it, and its decisions take effect: toxic documents go, one
document of each near-duplicate group stays, documents with benchmark items go, sources are mixed to their target
weights, and the mix is encoded.  All but the last return the columns of ``documents``, and further ones that the input has.

Every stage takes null and empty texts, null ids and sources, texts of any length, ties, repeated rows and an empty
table; what each does with them is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import decontaminate, minhash, mixing, store, tokens, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold; labels are learnt from those documents.

    Null and empty texts score the bias, rows without an id are scored by their text, repeated rows alike; without labels nothing is rejected."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group over five-word shingles at 0.8: the one with the smallest id.

    Rows that repeat an id with different texts are documents of their own; of equal rows one stays.  Documents without words or without an id link with nothing and stay."""
    return minhash.unique(docs, minhash.NearDup(words=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; null and empty texts contain none, repeated rows are judged each."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: what is taken of each document, once for each time it is taken.

    Documents without words take no part; a null source is one of its own; repeated rows have places of their own."""
    return mixing.mixed(docs, mixing.Mix(weights=(5, 2, 1), most=3))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row, read back from the files written; null ids come first, rows of one id one after another."""
    return tokens.digests(tokens.write(docs, tokens.TokenFiles(public_tokenizers.path("byte_bpe_50k.json"))))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_ids", write_token_ids),
]

#: Classifiers, permutations and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
