"""A corpus made ready for training: five stages, each on all that the one before it kept.

The quality classifier drops documents it rejects; of near-duplicates one document stays; personal data is
redacted; sources are mixed to target weights; and what results is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratum.llm import bbit, mil, mixing, packing, pii
from stratum.llm.common import Cut

#: Five words, and a similarity of 0.8 or more.
NEAR = bbit.Params(words=5, percent=80)
#: Documents of each source by target weight; a source that isn't named shares the rest by its rows.
MIX = mixing.Params()
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention-based classifier doesn't reject; null and empty texts are judged like any other."""
    return mil.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; texts without words and null ids all stay."""
    return bbit.one_of_each(docs, NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; a null text stays null."""
    return pii.redact(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as drawn, in a global random order; a null source is one of its own."""
    return mixing.mix(docs, MIX, marks=False)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of balanced cost."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing_weights),
    ("packing", sequences),
]
#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written to the shared folder and read again, and deleted once the next
    one is there. Each stage keeps the columns of documents, whatever further ones there are; an empty table goes through
    all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Cut(spark, "pipeline") as cut:
        for _, stage in STAGES[:-1]:
            docs = cut.write(stage(spark, docs, sf_dir), "documents")
        return cut.result(STAGES[-1][1](spark, docs, sf_dir))
