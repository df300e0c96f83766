"""The corpus pipeline: documents in, the mixed training corpus out. Part of the text operators' package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate as suffixes
from millrace.llm import mixing, resemblances, secrets, toxicity
from millrace.llm.common import delete, table, temporary_tables, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labelled ones, calls toxic go.

    Null and empty texts have the base rate's score and stay; repeated rows fall alike; rows without a doc_id are scored like any other. Empty docs: no rows; no labels: none goes.
    """
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.nontoxic(docs, machine)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity of 0.8 or more, found by their SimHash fingerprints, that with the smallest doc_id stays.

    Null, empty and wordless texts are one group. Rows without a doc_id stay. Rows with one doc_id and different texts are different documents; rows equal in both are one.
    """
    return resemblances.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts stay; repeated rows fall alike; an empty benchmark drops none."""
    return suffixes.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts and n_chars follows; no document goes. Null texts stay null, with n_chars null; null sources and doc_ids are owners and repositories of their own."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is emitted as often as the mix takes it, which may be never. Null sources are one source; rows with one doc_id are drawn alike; a source without words is not emitted."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The first two stages are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus of sf_dir's documents: every stage of STAGES over all that the one before kept, with the columns of documents.

    Between stages the kept documents are a table in the shared folder; a stage's own tables and its input go once its output
    is written. What the last stage reads stays, as its rows are made when the result is read. Empty documents: no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary_tables(spark) as kept, temporary_tables(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
            path = kept.pop()
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
