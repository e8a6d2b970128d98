"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, benchmark passages are cut out,
personal data is redacted, and what is left is packed into training sequences.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. SQL can't express the stages, so tests hold them against
brute-force versions.

For every stage: an empty table stays empty; texts may be of any length and count whole; columns that the stages don't use
pass through, whatever their names; the given columns come back in their order and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, jaccard_join, packing, pii, toxicity
from weftline.llm.queries import tokenizer_path
from weftline.storage import discard, materialize


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars, where there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic. It learns from the labels of the documents given.

    Null and empty texts get the score of no words and stay; repeated rows are decided alike, each on its own, and learned
    once; a score of exactly 0.5 is toxic; without labels of both kinds, or without labels at all, every document stays;
    a null doc_id is scored like any other and never learned.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each component of 5-word Jaccard links of 0.8 or more.

    A similarity of exactly 0.8 is a link. Null and empty texts, and those without words, are linked with nothing and all
    stay; rows that repeat a doc_id are one document and stay or go together; a text of fewer than 5 words is one shingle.
    """
    return jaccard_join.keep_one(docs, 5, 80)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without spans of benchmark items; those of which no word is left go.

    A null or empty text has no words and stays as it is, since nothing is cut out of it; repeated rows are cut alike and
    all stay; overlapping occurrences are one span; null and empty items cut nothing, and without items nothing changes.
    n_chars follows the text.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _counted(decontaminate.remove_spans(docs, benchmark), docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind.

    A null text stays null and an empty one empty; repeated rows are redacted alike; where spans overlap, the one that begins
    first counts, then the kind in the contract's order. n_chars follows the text.
    """
    return _counted(pii.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and offset.

    A null or empty text is a document of the end token alone; repeated rows are packed each on its own; pieces of equal
    length are alike to the plan, and take their places in order of doc_id, piece and content; a null doc_id is kept.
    """
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmarks),
    ("pii", redact_pii),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, name)
            if before is not None:  # a stage's table goes when the next one is there
                discard(before)
            before = docs
    return docs
