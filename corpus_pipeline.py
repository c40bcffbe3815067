"""The corpus pipeline: five stages, each calling one operator on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, and no others: columns of the caller's that clash with
ours keep their names and values.

Defined cases, for every stage: an empty table gives an empty one; a null text counts as empty; nulls in doc_id, lang,
source or n_chars are kept as they are; rows may repeat; texts of any length are read whole. What else a case means is said
with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replicalens.llm import common, jaccard, mixing, pieces, pii, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the trees, learned from labels, score below a half.

    Empty and null texts are scored like others; rows of equal texts are kept or rejected alike; without labels every score
    is a half and all stay. A score of exactly a half stays.
    """
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest doc_id.

    Documents without words are in no group and all stay, repeated ones too. A null doc_id stays only where its group has no
    other; of rows that share the smallest doc_id and differ in text the one with the least hash stays, of rows that are
    alike in both one.
    """
    return jaccard.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts and counts their characters anew.

    A null text stays null, with a null count; spans that overlap are masked as one, by the kind of the first; rows of equal
    doc_id and text are masked alike.
    """
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources' words meet their targets.

    A null source is a source. Documents without words are taken by their odds, which cost their source no words; a source
    that has none takes nothing. Of rows that are equal in every column as many are taken as fit.
    """
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the sampled pieces of each document.

    A null or empty text has no pieces; a null doc_id draws like 0; rows of equal doc_id and text have equal pieces.
    """
    return pieces.encode(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("PII", personal_data),
    ("mixing sources", source_mixing),
    ("SentencePiece", sentencepiece),
]
#: Learned scores and sampled pieces have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = common.stage(stage(spark, docs, sf_dir), f"{folder}/stage{n}")
    return docs
