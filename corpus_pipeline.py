"""From raw documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a frame that is written
and read back as the next one's ``docs``.  All but the last return the columns of ``documents``.

* quality: documents that the positive-unlabelled classifier scores below 0.3 go.
* language: documents without a letter, or whose best language scores below 0.5, go.
* near_duplicates: of documents whose SimHash fingerprints link (three-word shingles, at most three bits), the one
  with the smallest doc_id stays.
* repeated_passages: bytes covered by 400-byte strings that start elsewhere too are cut out of the texts, and so are
  passages of over 50 words that stand elsewhere too, which may be shorter; characters cut in half go with them, and
  ``n_chars`` follows the text.
* packing: the pieces of all documents with their places in sequences of 1024 tokens.

Null and empty texts pass through as they are unless a filter rejects them; empty tables give empty results.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobscope.llm import language, packing, quality, simhash, suffixes
from jobscope.llm.common import col, stored, table
from jobscope.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3; a null or empty text is scored like any other, repeated rows alike."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, name="__quality")
    return scored.where(F.col("__quality") >= quality.THRESHOLD).select(*map(col, docs.columns))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a sure language; null texts and texts without a letter have none and go."""
    found = language.predict(docs, language.train(docs), name="__language", score="__certain")
    sure = (F.col("__language") != language.UNDETERMINED) & (F.col("__certain") >= language.MIN_SCORE)
    return found.where(sure).select(*map(col, docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates; rows without a doc_id stay only where no row of the group has one."""
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without repeated strings and passages; null texts stay null, and rows with one doc_id are cut each by itself."""
    found = suffixes.remove_repeats(docs, kept="text", prefix="__", passage=suffixes.PASSAGE_WORDS)
    changed = F.col("__n_removed") > 0
    new = {"text": F.when(changed, F.col("__kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("__kept").cast(kind)).otherwise(F.col("n_chars"))
    return found.select(*[new[c].alias(c) if c in new else col(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document; a null or empty text is one piece that holds the end token alone."""
    definition = Path(tokenizer_path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    return packing.pack(docs, definition)


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_duplicates", keep_one_of_each),
    ("repeated_passages", cut_repeats),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
