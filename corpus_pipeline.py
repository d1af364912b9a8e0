"""From raw documents to token-id files, in five stages; each keeps the columns of documents but the last, which reports the ids.

All stages take whole tables with any further columns, whatever their names, and give an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import decontam, jaccard, mixing, tokens, toxicity
from scriptorium.llm.common import saved, scratch
from scriptorium.session import load, ship


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and blank texts are without evidence and stay; a null doc_id is judged by its text; repeated rows go or stay together.
    """
    ship(spark)
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id.

    Null and blank texts and rows without a doc_id are linked with nothing and stay; of rows that repeat a doc_id one stays.
    """
    ship(spark)
    return jaccard.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a stretch within a fifth of its words, go.

    Null and blank texts hold none and stay; rows without a doc_id and repeated rows are judged each by their text.
    """
    ship(spark)
    return decontam.drop_contaminated(docs, load(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document may come several times, at most three.

    A null source is a source, the last one. Null and blank texts have no words: they are drawn as others of their source, and a
    source without any word is not taken. Repeated rows draw alike.
    """
    ship(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids go to compressed shard files; one row for each document as it stands in them.

    Null and empty texts are the end id alone; rows without a doc_id come first; repeated rows stand side by side.
    """
    ship(spark)
    return tokens.token_ids(docs)


STAGES = [
    ("toxicity", clean),
    ("ngram_jaccard", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token_ids", encode),
]

#: Model scores, similarity components and token ids are beyond SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what passes between two of them is written to the shared folder and read again.

    What a stage leaves behind goes as its result is stored, and all but the last result goes at the end.
    """
    docs = load(spark, sf_dir, "documents")
    with scratch(spark) as kept:
        for name, stage in STAGES[:-1]:
            with scratch(spark) as passed_on:
                docs = saved(stage(spark, docs, sf_dir), f"stage-{name}", keep=passed_on)
        return saved(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}", keep=kept)
