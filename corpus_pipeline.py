"""Cleaning of a text corpus in stages: each takes documents and, but for the last, gives documents.

Every stage works on all that its predecessor kept, and its result is written as Parquet and read again.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from floodlens.llm.near_dedup import near_duplicates
from floodlens.llm.packing import best_fit_packing
from floodlens.llm.pii import personal_data, train_tagger
from floodlens.llm.quality_rules import quality_rules
from floodlens.llm.queries import vocabulary
from floodlens.llm.suffix_dedup import suffix_dedup
from floodlens.session import cut

#: Similarity in percent at which the pipeline links texts; op5's own threshold is another one.
NEAR = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Packing and the search for equal passages have no SQL form.
ORACLE_SQL = None


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, as they are."""
    return quality_rules(docs, carry=COLUMNS[1:]).where("kept").select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; rows without an id stay.

    The ids that go are stored first: as long as they are few, Spark can send them to the texts instead of
    shuffling those.
    """
    gone = cut(near_duplicates(docs, percent=NEAR).where("NOT kept").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that smaller ones have. A character cut in two goes as a whole."""
    found = suffix_dedup(docs, carry=("lang", "source"))
    text = valid_text("kept")
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@F.pandas_udf(StringType())
def valid_text(kept: pd.Series) -> pd.Series:
    return kept.map(lambda raw: raw.decode("utf-8", "ignore"))


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    found = personal_data(docs, train_tagger(docs), masked=True, carry=("lang", "source"))
    return (found.withColumn("text", F.col("masked_text")).withColumn("n_chars", F.length("text").cast("long"))
            .select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return best_fit_packing(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", rules_stage), ("near_dedup", near_stage), ("suffix_dedup", passages_stage),
          ("personal_data", private_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
