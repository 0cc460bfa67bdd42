"""Training-corpus pipeline: language filter, near-duplicate removal, repeated passages, test leaks, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.lineage import stage as written
from tickloom.llm import decontamination, language, near, substring, tokenizer
from tickloom.llm.text import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter (or text) are rejected; a document without lang gets the predicted one.

    Each row is judged by itself: repeated rows and rows without doc_id are as any. Of n-grams as common, and languages as
    near, the first in order counts.
    """
    found = language.identify(docs, language.learn_profiles(docs), keep=COLUMNS)
    kept = found.filter(F.col("lang_pred") != language.UNKNOWN)
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate class stays.

    Of rows with one doc_id and one text one stays, the first by lang, source and n_chars; rows with one doc_id and other texts are one document and stay or go
    together. Rows without doc_id or text stay.
    """
    gone = near.near_classes(docs).filter("doc_id <> class_id").select("doc_id").distinct()
    kept = docs.filter("doc_id is not null").join(gone.hint("merge"), "doc_id", "left_anti")
    # dealt by doc_id already
    once = kept.withColumn("i", F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source", "n_chars"))).filter("i = 1")
    return once.select(COLUMNS).unionByName(docs.filter("doc_id is null").select(COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that stand further up go; what is left is joined by one space. Untouched texts stay as they are.

    A null text becomes empty; rows without doc_id lose nothing; rows with one doc_id are at one place.
    """
    kept = substring.substring_dedup(docs, keep=["doc_id", "lang", "source"], whole=True).withColumnRenamed("kept", "text")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside an occurrence of a benchmark window are cut out; the rest of the document stays, as do all rows.

    A null text stays null; items without item_id or words are no items.
    """
    clean = decontamination.cut_phrases(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every text, and whether they decode to it. A null text has none and decodes to an empty one."""
    out = tokenizer.encode_decode(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Near-duplicate components, SentencePiece pieces and language profiles are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
