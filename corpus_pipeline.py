"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before
kept, and returns a DataFrame that is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of documents.

Defined results. Toxicity: null and empty texts are scored like any other and
stay unless called toxic. Line dedup: null texts stay null, documents that
lose every line they have go, equal lines of rows alike don't remove each
other. Jaccard join: documents without words stay; of documents linked, and of
rows alike under one doc_id, one stays; rows without a doc_id stay. Mixing: a
document of size 0 comes as often as its certain copies; rows alike come
alike. Packing: a null text is its end id alone, every row is packed for
itself. An empty table gives empty results in every stage; extra columns pass
through all but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from terraloom.llm import linededup, mixing, nearjoin, packing, queries, toxicity
from terraloom.llm.common import spread, store, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, doesn't call toxic."""
    labels = spread(table(spark, sf_dir, "labels"), ["doc_id", "toxic"])
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.where(F.col("predicted") == 0).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier one; n_chars follows the text."""
    kept = linededup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near copies, the one with the smallest doc_id."""
    return nearjoin.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_rows(docs, odds=mixing.by_length())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: where it stands in its document and in which sequence."""
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL can't express the classifier, nor the tokenizer; tests hold every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, "stage-" + name.replace(" ", "-"))
    return docs
