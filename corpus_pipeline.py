"""The corpus pipeline: raw documents to a training mix.

Stages run in order, each on all that its predecessor kept, written as Parquet in between. Toxic documents
go, one document of each group of near copies stays, documents contaminated by the benchmark go,
personal data is replaced by surrogates, and what is left is mixed to target weights. All stages but the
last return the columns they were given.

Rows without an id pass the copy stage, as links are between ids; a row that repeats another one's id shares its fate. Columns
beyond those of documents pass all stages but the last, whatever their names.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm import decontaminate, jaccard_join, mixing, surrogates, toxicity
from eventlake.llm.columns import unused
from eventlake.session import discard, pinned

COPY_SHINGLE, COPY_THRESHOLD = 5, Fraction(4, 5)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the limit; the labels of the held-out fold do not teach.

    All documents stay where nothing was learned: no usable label, or labels of one class only."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    if not len(model.nodes):
        return docs
    out = unused(docs, "toxicity")
    judged = toxicity.score(docs, model, tuple(docs.columns), out=out)
    return judged.where(F.col(out) < toxicity.REJECT).drop(out)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group that links of five-word shingle sets connect, from a likeness of 0.8."""
    groups = jaccard_join.linked_components(docs, k=COPY_SHINGLE, threshold=COPY_THRESHOLD)
    return docs.join(groups.where("doc_id != component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    key = unused(docs, "row_key")
    rejected = judged.where("contaminated").select(F.col("key").alias(key)).distinct()
    keyed = docs.withColumn(key, decontaminate.row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(rejected, key, "left_anti").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data."""
    return surrogates.replace(docs, surrogates.session_key(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words of every document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_copies),
    ("benchmark decontamination", drop_contaminated),
    ("PII", replace_personal_data),
    ("mixing", mix_sources),
]

# Models, connected components and keyed surrogates are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for _, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
