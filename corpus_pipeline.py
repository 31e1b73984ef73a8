"""The corpus pipeline: documents in, packed bins out. Each stage can be run on its own from a Parquet table.

Stages: toxic documents go; lines that many documents share go; one document of each near-duplicate group stays; sources are
mixed to their target weights, with whole repetitions; the mix is packed into bins. All but the last return the columns of
their input, whatever these are, with n_chars set to the length of the text as it then is.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgrid.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from quantgrid.llm.common import materialize

KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def any_columns(stage):
    """The stage on columns of plain names, whatever the others are called; these come back afterwards, in their places."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = [c if c in KNOWN else f"column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*docs.columns)

    return run


REJECT = 0.3  # toxicity score from which a document goes


@any_columns
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels of the rows at hand; rows of a score of REJECT or more go. Null texts hold nothing toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_texts(docs, model, out="__score").where(F.col("__score") < REJECT).drop("__score")


@any_columns
def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in 5 documents or more stay in one of them; no document goes."""
    kept = line_dedup.dedup_lines(docs, min_chars=40, min_docs=5, names=("__lines", "__dropped")).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(docs.columns)


@any_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard 0.8 or more join, the one of the least doc_id stays."""
    return jaccard_join.keep_one(docs, jaccard_join.jaccard_join(docs, threshold=0.8))


@any_columns
def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one in which a source's target falls is taken whole."""
    names = ("__words", "__source_words", "__target_words", "__taken")
    return mixing.repeat_rows(mixing.mix_sources(docs, weights=(5, 2, 1), share=1.5, max_epochs=2, names=names), names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 words, without two equal texts and with two rests of a source at most."""
    return packing.pack_documents(docs, capacity=2048, per_source=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("jaccard_join", drop_near_duplicates),
    ("source_mix", mix_to_targets),
    ("best_fit_packing", pack),
]

#: Fitted weights and best-fit packing aren't SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
