"""A corpus pipeline over ``documents``: language ID, near-duplicate removal, secret redaction, mixing, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and reread as the next one's docs.
All but the last return the columns of ``docs``. Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table (its result is empty) and further
columns, whatever their names; what it does with them stands with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import jaccard_join, lang_id, mixing, packing, secret_scan
from lorespark.llm.common import Scratch, mark, release

#: The least share of a text's n-grams that its language must explain.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and reads as one of the labelled languages; the rest go. Labels stay as they are.

    Null, empty and letterless texts go. The model learns from docs outside the held-out fold; where no row is labelled there is no language, so all go. Repeated rows stay or go alike.
    """
    model = lang_id.train(docs.where(~lang_id.held_out()))
    out = lang_id.predict(docs, model)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles: the smallest id.

    Rows without words (null, empty and blank texts) all stay; of rows that repeat id and text one stays; a row without an id stays only where its group has none with one.
    """
    return jaccard_join.keep_one(docs, 5, 8, 10)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark; n_chars follows the text.

    Null texts stay null (and have no n_chars), empty ones empty; every row is kept, repeated ones too.
    """
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their Poisson counts, in a global random order.

    A null source is a source of its own; null and empty texts are repeated like others; rows of equal id and text draw equal counts.
    """
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes in sequences of at most 2048 tokens.

    Null and empty texts are one token, the end mark; a long text is cut whole into pieces; repeated rows are packed one by one.
    """
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's intermediate tables are deleted once its result is written, and that result once the next one's is."""
    docs, scratch, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        start = mark()
        docs = scratch.put(name, stage(spark, docs, sf_dir))
        release(spark, start)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenisation is beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
