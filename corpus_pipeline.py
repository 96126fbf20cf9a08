"""Documents to training sequences: the stages, each a written table that the next one reads."""

from pyspark.sql import functions as F

from haulgrid.llm import entropy_secrets, grouped_packing, pairwise_quality, parity_join, raking
from haulgrid.llm.tables import write_table

#: Learned scores and sequences are not for SQL; a test compares with a brute-force version.
ORACLE_SQL = None


def quality(spark, docs, sf_dir):
    """Documents that the classifier, learned from the labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return pairwise_quality.accepted(docs, pairwise_quality.train(docs, labels))


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates."""
    return parity_join.keep_one(docs)


def secrets(spark, docs, sf_dir):
    """All documents, secrets masked; n_chars follows the text."""
    clean = entropy_secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in clean.columns else clean


def mixing(spark, docs, sf_dir):
    """A sample of documents by source, language and form."""
    return raking.sample(docs)


def packing(spark, docs, sf_dir):
    """Token pieces and their places in sequences."""
    import public_tokenizers

    return grouped_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("packing", packing),
]


def run(spark, sf_dir):
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
