"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from terraloom.llm import hilbert, linededup, matroska, mixing, nearjoin, packing, repair, template, toxicity, warc
from terraloom.llm.common import spread, table
from terraloom.llm.oracles import ORACLES
from terraloom.llm.tokens import vocabulary_path

#: Where tokenizer files lie; unset, the installed package says.
VOCABULARIES = os.environ.get("TERRALOOM_VOCABULARIES")


def vocabulary(name: str) -> str:
    return f"{VOCABULARIES}/{name}" if VOCABULARIES else vocabulary_path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    labels = spread(table(spark, sf_dir, "labels"), ["doc_id", "toxic"])
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return matroska.add_media(docs, keep_media=False).select("doc_id", "n_bytes", *[f.name for f in matroska.FIELDS])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), ["doc_id", "source", "text"])
    return mixing.mix(docs, odds=mixing.by_length(), slim=True).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return nearjoin.join(docs).select("doc_id", "n_shingles", "component_id")


def op5_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return repair.read_docs(repair.write_shards(docs, vocabulary("word_bpe_49k.json")))


def op6_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(spread(table(spark, sf_dir, "embeddings"), ["vec_id", "embedding"]))


def op7_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.main_texts(spread(table(spark, sf_dir, "pages"), ["page_id", "url", "html"]))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(spread(table(spark, sf_dir, "documents"), ["doc_id", "text"])).select("doc_id", "n_lines", "n_removed", F.concat_ws(",", "removed_lines").alias("removed_lines"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages and a replica of them with bit rot (in one page of 64, by md5 of its id, the first character is another) and lost records (one of 64)."""
    pages = spread(table(spark, sf_dir, "pages"), ["page_id", "url", "html"])
    hashed = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    rot = hashed.isin("00", "40", "80", "c0") & (F.length("html") > 0)
    replica = pages.where(~F.coalesce(hashed.isin("01", "41", "81", "c1"), F.lit(False))).withColumn("html", F.when(rot, F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))
    return warc.audit_pages(pages, replica)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_matroska": op2_matroska,
        "op3_mixing": op3_mixing,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_repair": op5_repair,
        "op6_hilbert_ann": op6_hilbert_ann,
        "op7_html_template": op7_html_template,
        "op8_line_dedup": op8_line_dedup,
        "op9_warc": op9_warc,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
