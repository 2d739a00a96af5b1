"""Bounded samples of labelled texts, and scoring of whole tables by small numpy models."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm import tokens
from eventlake.llm.shipping import ship


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is in none."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def sampled(docs: DataFrame, graded: DataFrame, most: int) -> tuple[DataFrame, dict[int, float]]:
    """(text, grade) of a bounded sample of labelled rows, whole texts of any length, and the share of every grade among all labels.

    ``graded`` is (doc_id, grade). Each grade gives its first ids in the order of a hash of the id, ``most`` rows
    in all; an id that repeats in ``docs`` gives one of its texts.
    """
    usable = graded.where(F.col("grade").isNotNull() & F.col("doc_id").isNotNull()).distinct()
    totals = {row.grade: row.n for row in usable.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = [given.select("text", F.lit(0).alias("grade")).limit(0)]
    for grade in sorted(totals):
        chosen = usable.where(F.col("grade") == grade).orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(max(1, most // len(totals)))
        own = given.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # at most ``most`` ids are sent
        parts.append(own.select("text", F.lit(grade).alias("grade")))
    whole = sum(totals.values())
    return reduce(DataFrame.unionByName, parts), {grade: n / whole for grade, n in totals.items()}


def fitted(sample: DataFrame, fit: Callable[[list[str], list[int]], Any]) -> Any:
    """The model that ``fit`` makes of a bounded sample, made in one task, so that the driver holds the model alone."""
    ship(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, grades = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            grades += batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i].encode()), texts[i], grades[i]))
        model = pickle.dumps(fit([texts[i] for i in order], [grades[i] for i in order]))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    made = sample.select("text", F.col("grade").cast("int")).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else fit([], [])  # written by the task above; an empty sample may have no task


def scored(docs: DataFrame, keep: list[str], text: str, out: list[str], breaks: np.ndarray, lower: bool, score: Callable[[tokens.Piece], np.ndarray]) -> DataFrame:
    """Columns ``keep`` of every row with the numbers ``out`` that ``score`` gives for its whole text; one pass, no shuffle."""
    ship(docs.sparkSession)
    given = docs.select(*[F.col(name) for name in keep], F.col(text))  # by place: a name may come twice
    schema = docs.select(*keep, *[F.lit(0.0).alias(name) for name in out]).schema
    known = docs.sparkSession.sparkContext.broadcast(score)  # bounded by the sample the model was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_piece = known.value
        for batch in batches:
            got = [np.asarray(of_piece(piece)).reshape(len(piece.rows), len(out)) for piece in tokens.pieces(batch.column(batch.num_columns - 1), breaks, lower)]
            numbers = np.concatenate([*got, np.zeros((0, len(out)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(numbers[:, i], pa.float64()) for i in range(len(out))]], names=[*keep, *out])

    return given.mapInArrow(run, schema)
