"""Documents to training sequences, one stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Each stage's result is written as Parquet and read again as the next
one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import jaccard, mixing, packing, pii, toxicity
from weftline.llm.common import materialised, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to the labels, does not call toxic. Null and empty
    texts score what the bias gives; repeated rows stay or go alike; other columns pass through."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of near copies. Texts without
    words and rows with a null doc_id stay; of repeated rows one stays; other columns pass through."""
    return jaccard.one_of_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and disclosing terms generalised or removed. Null and
    empty texts, repeated rows and other columns pass through."""
    return pii.sanitised_texts(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, as whole copies and parts. Null and empty texts
    come along as often as their shard is taken whole; repeated rows count as rows of their own;
    other columns pass through."""
    return mixing.mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence of a power of two. A null or empty text is the
    end token alone; repeated rows are packed each; other columns are not read."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("pii", sanitise),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL cannot express the classifier, the masks of the method's own spans or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir. An empty table gives no rows at any stage."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
