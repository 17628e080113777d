"""From raw documents to token ids: language ID, exact and near deduplication, mixing, encoding.

Each stage takes all that its predecessor kept, from Parquet, and its decisions take effect: rejected and repeated documents
are gone, documents of sources above their target are dropped and those of sources below it repeated, and what remains
is encoded.

Defined cases: documents without a letter (null and empty texts too) are rejected by the first stage; of repeated rows one
stays, and the mix may repeat it; a null identifier is kept where its text is new; columns that documents has besides are
carried through all stages; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import bpe, exact_dedup, language_id, minhash, mixing
from mnemospark.llm.common import documents, scratch, ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The models are learned from a bounded sample of the labelled rows of docs."""
    ship(spark)
    return language_id.keep_identified(docs, language_id.learn(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one document stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity 0.8), the least identifier stays."""
    ship(spark)
    return minhash.keep_first(docs, size=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their other columns and their token ids; the text is what the ids decode to.

    A column that has the name of a new one is replaced.
    """
    import public_tokenizers

    ship(spark)
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded_col="decoded")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_tokens", "token_ids", "decoded")]
    return encoded.select(*kept, F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids", "decoded")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
