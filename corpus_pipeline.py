"""The corpus pipeline: five stages of quillon.llm in a row, each on all its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import gumbel, radix, rtree, suffixauto, toxcnn
from quillon.llm.common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects by their language's threshold go. Null and empty texts have a score
    like any other and share it; repeated rows share their fate; an empty table stays empty; no column is changed."""
    return toxcnn.without_toxic(docs, _table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays; of repeated rows with one doc_id and text, one row.

    Null and empty texts and those of white space alone are equal: one of all these stays. Other columns are kept as they are."""
    return radix.without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents at a Jaccard similarity of 0.8 or more over five-word shingles, the smallest doc_id stays.

    Null and empty texts have no shingles and are near nothing; shorter texts are one shingle; repeated rows of a doc_id
    that stays all stay, and so do rows with null doc_id. Other columns are kept as they are."""
    return rtree.without_near(docs, 5, 80, 100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go.

    Null and empty texts have no words and stay as they are; repeated rows are each judged; n_chars follows a text that
    was cut, other columns are kept as they are. Punctuation between a passage and what stays is left."""
    return suffixauto.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def sampled_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document that is left, with what their ids decode to, as hashes.

    Null and empty texts have one, without ids; so has any text of one segmentation only. Repeated rows are each sampled,
    alike; other columns are left out."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return gumbel.sampled_digest(docs, model, k=2)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece_sampling", sampled_encoding),
]

#: The first and the last stage have no SQL: a trained network, and seeded sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
