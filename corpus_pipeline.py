"""From raw documents to a training mix: five stages, each one operator over all that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the mix: doc_id, source, size,
source_size, target and taken (words that the mix takes of a document, repeats counted).

Defined results: a null text is scored, kept and mixed as an empty one; without labels every score is 0.5 and nothing is
rejected; an empty benchmark hits nothing; no documents give no rows; other columns of documents are left out. Near-dedup
keeps one row of each repeated document (same doc_id and text) and takes rows without a doc_id for documents of their own,
told apart by their text. A document whose text is removed as a whole stays, with an empty text; a cut inside a character
takes the rest of the character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, mixing, neardup, quality, substrings
from sparkloom.llm.common import settle
from sparkloom.session import spread, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents below this quality score go.
KEEP_SCORE = 0.3


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, COLUMNS, text=True).where(F.col("score") >= KEEP_SCORE).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.kept_documents(docs, COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.dedup_substrings(docs, keep=("lang", "source", "n_chars"))
    #: a cut inside a character leaves bytes of it, which go too
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_of(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix),
]
#: Scores of a trained model decide what goes on, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
