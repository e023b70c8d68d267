"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, of its neighbouring pairs and of its pairs with one word
between, hashed to 2^22 coordinates. Words are runs of ASCII letters and digits (lower-cased) and
of bytes above 127. L1 leaves few weights other than zero; those alone are broadcast,
and they are at most the coordinates of the training sample.

Training takes about ``POSITIVES`` toxic and ``NEGATIVES`` other texts, and ``SAMPLE_BYTES`` bytes of each kind on average, picked by a
hash of their ids among all labelled rows with ``crc32(doc_id) mod 4 != 2`` whose text has up to ``ONE_BYTES``; the intercept is corrected to the share of
toxic rows among all of those. Scoring reads the whole text of every document and nothing else.

Defined cases: texts without words (null, empty, blank) score by the intercept alone; labels that are null
or neither 0 nor 1 are not learned from; labels of unknown documents are unused; a document with several labels
is learned with each; without any labels of both kinds every score is the logistic of 30 (only toxic labels) or of -30 (any other case), 1e-13 from 1 or 0; equal texts get equal scores; null doc_ids count as held out of learning (``held_out`` is false
for them); columns besides those named are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, give_back, mapped, mixed, steps, table, text_buffers
from .ftrl import Ftrl
from .shingles import word_hashes

BITS = 22
POSITIVES, NEGATIVES = 6_000, 12_000
EPOCHS = 8
#: Bytes of the sample of each kind, on average, and of one text in it.
SAMPLE_BYTES, ONE_BYTES = 32 << 20, 1 << 18
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

_B = np.arange(256)
#: Bytes that part words: all ASCII but letters and digits.
GAP = ~((_B >= 128) | ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122)))


def features(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of words, pairs and skip pairs of a step of rows, with repeats."""
    words, firsts = word_hashes(flat, offsets, GAP)
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    mask = np.uint64((1 << BITS) - 1)
    rows, at = [row], [words & mask]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(words) > gap:
            own = row[gap:] == row[:-gap]
            pair = mixed(words[:-gap] * np.uint64(salt) + words[gap:])
            rows.append(row[gap:][own])
            at.append(pair[own] & mask)
    return np.concatenate(rows), np.concatenate(at).astype(np.int64)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct coordinates of each text, packed."""
    for batch in batches:
        flat, offsets = text_buffers(batch["text"])
        out = []
        for i, j in steps(offsets):
            row, at = features(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            key = np.unique(row << BITS | at)
            cuts = np.searchsorted(key, np.arange(j - i + 1) << BITS)
            own = (key & ((1 << BITS) - 1)).astype(np.int32)
            out += [own[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.record_batch({"toxic": batch["toxic"].cast(pa.int32()), "x": pa.array(out, pa.binary())})


def fit(vectors: list[np.ndarray], toxic: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and weights other than zero, and the intercept for a true share of toxic rows."""
    model = Ftrl(1 << BITS, alpha=2.0, l1=6.0, l2=0.1)
    bias = Ftrl(1, alpha=0.1)
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(vectors)):
            x = vectors[i]
            w, b = model.weights(x), bias.weights()
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum() + b[0])))))
            g = p - toxic[i]
            model.step(x, w, np.full(len(x), g))
            bias.step(slice(None), b, np.array([g]))
    w = model.weights()
    at = np.flatnonzero(w)
    own = toxic.mean()
    logit = lambda p: math.log(p / (1 - p))
    return at, w[at].astype(np.float32), float(bias.weights()[0]) + logit(share) - logit(own)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and intercept from the labelled rows that are not held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select(F.col("doc_id").alias("_id"), "toxic")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        share = 1.0 if counts.get(1) else 0.0
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 30.0 if share else -30.0
    bytes_ = F.coalesce(F.octet_length("text"), F.lit(0))
    sizes = known.join(docs.select("doc_id", bytes_.alias("size")), F.col("doc_id") == F.col("_id")).filter(F.col("size") <= ONE_BYTES)
    size = {r["toxic"]: (r["n"], r["size"]) for r in sizes.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    rate = [min(most / max(n, 1), SAMPLE_BYTES / max(b, 1)) for most, (n, b) in ((NEGATIVES, size.get(0, (0, 0))), (POSITIVES, size.get(1, (0, 0))))]
    place = (F.xxhash64(F.col("_id")).cast("double") / 2.0**64) + 0.5
    picked = known.filter(place < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    # Ids of the sample, a bounded number on average, are joined; texts stay where they are read.
    rows = docs.filter(bytes_ <= ONE_BYTES).select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    sample = mapped(rows.select("toxic", "text"), _vectors, "toxic int, x binary").toArrow()
    vectors = [np.frombuffer(x.as_buffer(), np.int32) for x in sample["x"]]
    toxic = sample["toxic"].to_numpy().astype(np.float64)
    if not 0 < toxic.sum() < len(toxic):
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 30.0 if toxic.sum() else -30.0
    model = fit(vectors, toxic, counts[1] / (counts[0] + counts[1]))
    give_back()
    return model


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = model.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w
        for batch in batches:
            flat, offsets = text_buffers(batch["text"])
            logits = np.full(batch.num_rows, bias)
            for i, j in steps(offsets):
                row, x = features(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = np.flatnonzero(dense[x])
                key = np.unique(row[own] << BITS | x[own])
                logits[i:j] += np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)].astype(np.float64), minlength=j - i)
            score = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.record_batch({"doc_id": batch["doc_id"].cast(pa.int64()), "score": pa.array(score)})

    return run


def scores(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id and score, 0 to 1, of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return mapped(docs.select("doc_id", "text"), _scored(shared), "doc_id long, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = scores(docs, learn(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    held = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
