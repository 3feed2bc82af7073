"""From raw documents to piece ids: toxic texts, near copies and benchmark passages go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's rows to the shared folder
and hands them, read back, to the next one. All but the last return the columns of documents.

Null and empty texts are kept by all filters and have no pieces; a row without doc_id is kept by the join, of rows that repeat doc_id and text one is left.
Without labels no text is toxic, without benchmark none holds an item; an empty table gives an empty result. Columns of documents called
piece_ids or decoded give way to the last stage's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import common
from textloom.llm.decontaminate import without_benchmark
from textloom.llm.jaccard_join import one_of_each
from textloom.llm.sentencepiece_sa import with_pieces
from textloom.llm.toxicity import without_toxic

#: Near copies: shingles of five words, Jaccard similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the lexicon, learned from the labels among docs, says are toxic."""
    return without_toxic(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group that Jaccard links join."""
    return one_of_each(docs, WORDS, PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark passage."""
    return without_benchmark(docs, common.table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With piece_ids, and decoded: the text that they give back."""
    return with_pieces(docs, common.tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("SentencePiece encoding and decoding", pieces)]

#: A learned lexicon and piece ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_folder(spark)
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.stored(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs
