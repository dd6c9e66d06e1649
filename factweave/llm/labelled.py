"""Learning from a bounded sample of labelled rows.

The ids of at most `bound` labelled rows and at most as many of their texts are chosen by a hash, the
same ones in each run; their features are made on the executors and only they come to the driver, which fits the model. The
weights go back with the scoring function: their size is fixed by the number of hash cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, save, slices, small_batches, tidy

BOUND = 8_000
#: Bytes of the texts handled at once.
TEXT_BYTES = 2 << 20
THRESHOLD = 0.7


def sample_labels(labels: DataFrame, label: str, learn: Column, bound: int = BOUND) -> DataFrame:
    """doc_id and label of at most bound rows that may be learnt from."""
    rows = labels.where(learn & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    return rows.orderBy(order, "doc_id").limit(bound)


def sample_features(documents: DataFrame, labels: DataFrame, make: Callable[[bytes], bytes], bound: int = BOUND) -> tuple[list[bytes], np.ndarray]:
    """The features of the sampled rows, as make packs them, and their labels: of bound distinct texts
    at most, however many documents share a labelled id."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3, 128, TEXT_BYTES):
                made = pa.array([make(t or b"") for t in batch.column(3).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), made], names=["doc_id", "label", "digest", "features"])
        tidy()

    text = F.col("text").cast("binary")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # both tables have at most bound rows, so they are safe to broadcast
    found = rows.join(F.broadcast(labels), "doc_id").select("doc_id", "label", F.xxhash64("text").alias("digest")).distinct()
    found = save(found.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id", "digest", "label").limit(bound), "sample")
    rows = rows.withColumn("digest", F.xxhash64("text")).join(F.broadcast(found), ["doc_id", "digest"])
    once = rows.groupBy("doc_id", "label", "digest").agg(F.first("text").alias("text"))
    made = once.mapInArrow(packed, "doc_id long, label int, digest long, features binary").select("label", "doc_id", "digest", "features").toArrow()
    order = pc.sort_indices(made, [(c, "ascending") for c in ("doc_id", "digest", "label")])
    out = made["features"].take(order).to_pylist(), made["label"].take(order).to_numpy().astype(np.float64)
    del made
    tidy()
    return out


def score_texts(documents: DataFrame, score: Callable[[list[bytes]], np.ndarray], held_out: Column, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 128, TEXT_BYTES):
                found = score([t or b"" for t in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["doc_id", "held_out", "score"])
        tidy()

    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    out = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def split(parts: int, held: int) -> Column:
    """Whether a row is held out."""
    return F.coalesce(id_remainder("doc_id", parts) == held, F.lit(False))


def keep_texts(documents: DataFrame, score: Callable[[list[bytes]], np.ndarray], keep: Callable[[np.ndarray], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of documents, with all their columns, whose text has a score that keep accepts."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index(text)
            for batch in slices(whole, at, 128, TEXT_BYTES):
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array(keep(score([t or b"" for t in texts]))))
        tidy()

    small_batches(documents.sparkSession)
    return documents.mapInArrow(kept, documents.schema)
