"""Quality classifier: hashed word n-gram logistic regression trained with FTRL-proximal updates.

Tokens are runs of letters, digits and non-ASCII bytes, or runs of other visible bytes, with A-Z lower-cased;
features are hashed tokens and pairs of neighbours (a pair of equal tokens is one feature of its own), each
with the share of the text's features that it makes up. Nulls and texts without tokens have no features and
get the score of the bias alone. Repeated labels of a document are one label, 1 only if all are 1; of several texts
under one labelled doc_id one is learnt from; rows without a label are scored but not learnt from; ties of the score
with the threshold are predicted 1. doc_ids of any type will do; rows without one are scored. Texts of any length are
scored whole.

Training is one task over TRAIN_ROWS texts at most, each as its distinct features and their counts: 2 ** BITS of them
at most, so at most TRAIN_ROWS * 2 ** BITS * 8 bytes, and in practice a few kilobytes a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_spans, large_strings, lower_table, mix, row_counts, runs, slices, stored, tidy

BITS = 18
#: Most labelled rows that training looks at (those with the smallest hashes of doc_id). Bounds its memory.
TRAIN_ROWS = 12_000
EPOCHS = 3
THRESHOLD = 0.3
#: Features' shares are multiplied by this, so that usual weights are near one.
SCALE = 40.0

_WORD = np.zeros(256, np.uint8)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_SIGN = np.zeros(256, np.uint8)
_SIGN[[b for b in range(33, 127) if not _WORD[b]]] = 1
_LOWER = lower_table(b"")


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a run of texts, and the bounds of each text's."""
    low = _LOWER[data]
    word, sign = runs(_WORD[data] > 0, offsets), runs(_SIGN[data] > 0, offsets)
    starts, ends = np.concatenate([word[0], sign[0]]), np.concatenate([word[1], sign[1]])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    tokens = hash_spans(low, starts, ends)
    counts = row_counts(starts, offsets)
    row = np.repeat(np.arange(counts.size), counts)
    inside = row[1:] == row[:-1]
    pairs = mix(tokens[:-1] * np.uint64(31) + tokens[1:] * np.uint64(1_000_003))
    pairs[tokens[:-1] == tokens[1:]] = 12345
    both = np.concatenate([tokens, pairs[inside]])
    of = np.concatenate([row, row[1:][inside]])
    order = np.argsort(of, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=counts.size))])
    return (both[order] >> np.uint64(64 - bits)).astype(np.int64), bounds


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.3, l2: float = 1.0) -> np.ndarray:
    """Weights (the last is the bias) from follow-the-regularised-leader updates, one text after another.

    rows: each text's distinct features and their counts.
    """
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for (cells, counts), y in zip(rows, labels):
            at = np.append(cells, size - 1)
            x = np.append(counts * (SCALE / max(int(counts.sum()), 1)), 1.0)
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def remainder(doc_id: str | F.Column, of: int) -> F.Column:
    """crc32 of the id as text, modulo of; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % of


def train(documents: DataFrame, labels: DataFrame, bits: int = BITS, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from labelled rows whose crc32(doc_id) mod 5 is not 0, rows of them at most."""
    large_strings(documents)
    key = F.col("doc_id").cast("string").alias("doc_id")
    learnt = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0)).groupBy(key).agg(F.min("quality").cast("int").alias("y"))
    chosen = stored(learnt.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "classifier-labels")  # rows of them at most, so it can be broadcast
    texts = documents.select(key, F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def hashed(batches):
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                at, bounds = features(data, offsets, bits)
                found = [np.unique(at[a:b].astype(np.int32), return_counts=True) for a, b in zip(bounds[:-1], bounds[1:])]
                cells, counts = (pa.array([x[i].astype(np.int32).tobytes() for x in found], pa.binary()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), cells, counts], names=["doc_id", "y", "cells", "counts"])

    # one text of each doc_id; the order, and so the result, is fixed
    one = texts.mapInArrow(tidy(hashed), "doc_id string, y int, cells binary, counts binary").groupBy("doc_id", "y").agg(F.min(F.struct("cells", "counts")).alias("x"))
    one = stored(one.select(F.xxhash64("doc_id", F.lit(17)).alias("place"), "doc_id", "y", "x.*", F.lit(0).alias("one")), "classifier-rows")

    def fit(table: pa.Table) -> pa.Table:
        place, ids, y = (table.column(c).to_pylist() for c in ("place", "doc_id", "y"))
        order = sorted(range(len(ids)), key=lambda i: (place[i], ids[i]))
        cells, counts = table.column("cells"), table.column("counts")
        views = [tuple(np.frombuffer(c[i].as_buffer(), np.int32) for c in (cells, counts)) for i in order]
        weights = ftrl(views, [y[i] for i in order], bits)
        return pa.table({"weights": pa.array([weights.astype("<f8").tobytes()], pa.binary())})

    found = one.groupBy("one").applyInArrow(fit, "weights binary").select("weights").first()
    return np.frombuffer(found[0], "<f8") if found else np.zeros((1 << bits) + 1)


def scored(documents: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """The documents with a last column score (with underscores ahead if that is taken) of 0 to 1: the logistic of the sparse dot product."""
    large_strings(documents)
    shared = documents.sparkSession.sparkContext.broadcast(weights)  # 2 ** bits + 1 numbers
    name = "score"
    while name in documents.columns:
        name = f"_{name}"
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        w = shared.value
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                at, bounds = features(data, offsets, bits)
                sums = np.concatenate([[0.0], np.cumsum(w[at])])
                size = np.diff(bounds)
                logit = (sums[bounds[1:]] - sums[bounds[:-1]]) * (SCALE / np.maximum(size, 1)) + w[-1]
                score = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, name])

    return documents.mapInArrow(tidy(run), schema)


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    weights = train(documents, labels)
    rows = scored(documents.select("doc_id", F.col("text").cast("string").alias("text")), weights)
    return rows.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
