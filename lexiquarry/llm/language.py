"""Language identification by sparse multinomial logistic regression.

A text becomes its letters (lower-cased) with one space for everything between them; its features are
the character 1- to 3-grams, hashed to 2^16 coordinates, weighted by share in the text times inverse document
frequency. Document frequencies come from all documents that may be learned from.
The regression is trained by FTRL with an elastic-net penalty (l1 and l2) on a bounded sample:
about ``PER_LANGUAGE`` texts and ``SAMPLE_BYTES`` bytes of each language on average, of texts of up to ``ONE_BYTES``, picked by a hash, as a whole and as a short cut.
A temperature, fitted on a fifth of the sample that is kept aside, calibrates the probabilities.

The features of a text are linear in its n-grams, so scoring adds one row of weights for each n-gram.

Defined cases: null texts and texts without a letter are ``und`` with score 1; without any
labelled text everything is ``und``, and ``kept`` keeps what has a letter; else ``kept`` rejects what is ``und`` and texts whose language
scores under ``LEAST_SCORE``, that is where all other languages together are likelier; weights take 2^18 bytes a language; documents with a null lang or null doc_id are not learned from; null
doc_ids are not held out; equal texts get equal results; texts are read whole; columns besides those
named are not looked at (``rejected`` and ``kept`` keep them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, give_back, keeping, mapped, table, trim_driver
from .ftrl import Ftrl

BITS = 16
ORDERS = 3
PER_LANGUAGE = 1500
EPOCHS = 3
#: Bytes of a language's sample, on average, and of one text in it.
SAMPLE_BYTES, ONE_BYTES = 16 << 20, 1 << 18
#: The calibrated probability that a kept document's language has at least.
LEAST_SCORE = 0.5
SCALE = 30.0
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"

_ALPHA: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _ALPHA


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, coordinate) of every n-gram of texts, and whether each text has a letter."""
    lowered = [t.lower() for t in texts]
    size = np.array([len(t) + 1 for t in lowered], np.int64)
    c = np.frombuffer("".join(t + "\n" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    letter = _letters()[c]
    some = np.zeros(len(texts), bool)
    some[row[letter]] = True
    gap = ~letter
    # The first of a run of others stands for a space; each row ends with one, and none starts with one.
    keep = letter.copy()
    keep[1:] |= gap[1:] & (letter[:-1]) & (row[1:] == row[:-1])
    c, row = np.where(letter, c, 32)[keep].astype(np.uint64), row[keep]
    rows, at = [], []
    h = np.zeros(len(c), np.uint64)
    for k in range(ORDERS):
        if len(c) <= k:
            break
        h = h[: len(c) - k] * np.uint64(0x100000001B3) + c[k:] + np.uint64(k + 1)
        own = row[k:] == row[: len(row) - k]
        mix = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        rows.append(row[k:][own])
        at.append(mix[own].astype(np.int32))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), some
    return np.concatenate(rows), np.concatenate(at), some


def _blocks(texts: list[str], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a partition that hold each coordinate; one row a partition."""
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        texts = [t or "" for t in batch["text"].to_pylist()]
        for i, j in _blocks(texts):
            row, at, _ = grams(texts[i:j])
            cuts = np.argsort(row, kind="stable")
            ends = np.searchsorted(row[cuts], np.arange(j - i + 1))
            at = at[cuts]
            for a, b in zip(ends[:-1], ends[1:]):
                flags = np.zeros(1 << BITS, bool)
                flags[at[a:b]] = True
                df += flags
        n += len(texts)
    where = np.flatnonzero(df)
    yield pa.record_batch({"at": pa.array(np.append(where, -1), pa.int32()), "n": pa.array(np.append(df[where], n), pa.int64())})


def _vector(at: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, n = np.unique(at, return_counts=True)
    return x, (SCALE * n / len(at) * idf[x]).astype(np.float32)


def fit(texts: list[str], langs: list[str], idf: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, weights by coordinate (idf and scale included), intercepts and temperature."""
    names = sorted(set(langs))
    order = np.random.default_rng(11)
    examples, aside = [], []
    for k, (t, lang) in enumerate(zip(texts, langs)):
        size = int(order.integers(20, 160))
        start = int(order.integers(0, max(1, len(t) - size)))
        for own in (t, t[start : start + size]):
            _, at, some = grams([own])
            if some[0]:
                (aside if k % 5 == 0 else examples).append((*_vector(at, idf), names.index(lang)))
    model, bias = Ftrl((1 << BITS, len(names)), alpha=1.0, l1=0.02, l2=0.002), Ftrl(len(names), alpha=0.1)

    def logits(x, v):
        w = model.weights(x)
        return w, bias.weights(), v @ w + bias.weights()

    for _ in range(EPOCHS):
        for i in order.permutation(len(examples)):
            x, v, y = examples[i]
            w, b, s = logits(x, v)
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            model.step(x, w, v[:, None] * p)
            bias.step(slice(None), b, p)
    raw = np.array([logits(x, v)[2] for x, v, _ in aside or examples])
    y = np.array([e[2] for e in aside or examples])
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.2, 20, 60):
        s = raw / t
        s = s - s.max(1, keepdims=True)
        loss = float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())
        if loss < best:
            best, temperature = loss, float(t)
    return names, (model.weights() * idf[:, None] * SCALE).astype(np.float32), bias.weights(), temperature


def learn(docs: DataFrame) -> tuple | None:
    """The model from the documents that are not held out; None without labelled text."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), FOLDS) != HELD_OUT)).select("doc_id", "lang", "text")
    size = F.octet_length("text")
    small = size <= ONE_BYTES
    counts = known.groupBy("lang").agg(F.count(F.when(small, 1)).alias("n"), F.sum(F.when(small, size)).alias("bytes")).collect()
    if not counts:
        return None
    df = mapped(known.select("text"), _frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = df["at"].to_numpy(), df["n"].to_numpy()
    total = int(n[at == -1].sum())
    idf = np.full(1 << BITS, np.log(1 + total))
    idf[at[at >= 0]] = np.log((1 + total) / (1 + n[at >= 0])) + 0.1
    place = (F.xxhash64("doc_id").cast("double") / 2.0**64) + 0.5
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(PER_LANGUAGE / max(r["n"], 1), SAMPLE_BYTES / max(r["bytes"] or 0, 1)))])
    sample = known.filter(small & (place < F.element_at(share, F.col("lang")))).select("text", "lang").toArrow()
    if not sample.num_rows:
        return None
    trim_driver(docs.sparkSession)
    model = fit(sample["text"].to_pylist(), sample["lang"].to_pylist(), idf)
    give_back()
    return model


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, bias, temperature = model.value
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            langs: list[str] = []
            scores: list[float] = []
            for i, j in _blocks(texts):
                row, at, some = grams(texts[i:j])
                count = np.bincount(row, minlength=j - i)
                s = np.stack([np.bincount(row, weights=weights[:, k][at], minlength=j - i) for k in range(len(names))], 1)
                s = (s / np.maximum(count, 1)[:, None] + bias) / temperature
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                langs += [names[b] if ok else UNKNOWN for b, ok in zip(best, some)]
                scores += np.where(some, p[np.arange(j - i), best], 1.0).tolist()
            yield pa.record_batch([batch["kept"], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["kept", "lang_pred", "score"])

    return run


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a text has a letter."""
    for batch in batches:
        yield pa.record_batch([batch["kept"], pa.array([any(map(str.isalpha, t or "")) for t in batch["text"].to_pylist()], pa.bool_())], ["kept", "some"])


def predicted(docs: DataFrame, model: tuple | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` (none of them named lang_pred or score), lang_pred and score of every text."""
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(1.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keeping(docs, keep, {"text": F.col("text")}, _predicted(shared), "lang_pred string, score double")


def kept(docs: DataFrame) -> DataFrame:
    """The documents whose language the model tells with a score of LEAST_SCORE or more, with their own columns alone."""
    rows = docs.select(F.struct("*").alias("own"), "text")
    model = learn(docs)
    # With nothing to learn from, only texts without a letter go.
    known = keeping(rows, ["own"], {"text": F.col("text")}, _lettered, "some boolean").filter("some") if model is None else predicted(rows, model, ["own"]).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.select(*[F.col("own").getField(c).alias(c) for c in docs.columns])


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    rows = predicted(docs, learn(docs), ["doc_id"])
    held = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score")
