"""Toxicity scores by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

Features of a text are its words, word stems (the first 4, 5 and 7 bytes), word pairs and pairs
with one word between (skip-grams), hashed into 2**20 coordinates.  A feature is present
once, and has coordinates of their own for two and for three or more occurrences, so a long
text's frequent words weigh no more than a short one's.  FTRL-proximal (McMahan et al., 2013) keeps a learning rate
per coordinate, and its L1 term leaves most weights exactly zero.  The non-zero weights are
a small array (bounded by the number of coordinates) that is broadcast to the scorers.

The model is fitted on a bounded sample of labelled rows, the ``max_train`` of least hash of
doc_id: one task reads that many texts whatever the size of the corpus.  Every document is
scored in whole in one map pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

BITS = 20
MAX_TRAIN = 6000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.02
#: Coordinates in fewer sampled documents are left out of the fit.
MIN_DOCS = 5
STEMS = (4, 5, 7)
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def features(ch: tc.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of a chunk's words, stems, n-grams and skip-grams, and the document of each."""
    s, e, first = ch.words()
    w = ch.word_hashes(s, e)
    owner = np.repeat(np.arange(len(ch)), np.diff(first))
    shift = np.uint64(64 - BITS)
    parts, docs = [w >> shift], [owner]
    for n in STEMS:
        long = np.flatnonzero(e - s >= n)
        stem = ch.word_hashes(s[long], s[long] + n)
        parts.append(tc.mix64(stem + np.uint64(n)) >> shift)
        docs.append(owner[long])
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(w) > gap:
            same = owner[gap:] == owner[:-gap]
            parts.append((tc.mix64(w[:-gap] * np.uint64(salt) + w[gap:]) >> shift)[same])
            docs.append(owner[gap:][same])
    return np.concatenate(parts).astype(np.int64), np.concatenate(docs)


def level(index: np.ndarray, times: int) -> np.ndarray:
    """The coordinate of a feature that occurs so often."""
    return (tc.mix64(index.astype(np.uint64) * np.uint64(8) + np.uint64(times)) >> np.uint64(64 - BITS)).astype(np.int64)


def per_document(ch: tc.Chunk) -> Iterator[np.ndarray]:
    """The distinct coordinates of each document."""
    index, doc = features(ch)
    mask = (1 << BITS) - 1
    key, count = np.unique((doc << BITS) | index, return_counts=True)
    more = [((key[count >= k] >> BITS) << BITS) | level(key[count >= k] & mask, k) for k in (2, 3)]
    key = np.unique(np.concatenate((key, *more)))
    cut = np.searchsorted(key, np.arange(len(ch) + 1) << BITS)
    for d in range(len(ch)):
        yield key[cut[d] : cut[d + 1]] & mask


class Ftrl:
    """Per-coordinate FTRL-proximal for binary features; the bias has a coordinate of its own."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        shrink = np.where(i == 1 << BITS, 0.0, L1)
        w = -(z - np.sign(z) * shrink) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= shrink, 0.0, w)

    def learn(self, i: np.ndarray, label: int) -> None:
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def fit(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of the non-zero weights; the last coordinate is the bias."""
    rows = [x for ch in tc.chunks(texts) for x in per_document(ch)]
    often = np.bincount(np.concatenate(rows), minlength=1 << BITS) >= MIN_DOCS
    rows = [np.append(x[often[x]], 1 << BITS) for x in rows]
    model, order = Ftrl(), np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in order.permutation(len(rows)):
            model.learn(rows[k], int(labels[k]))
    everything = model.weights(np.arange((1 << BITS) + 1))
    index = np.flatnonzero(everything)
    return index, everything[index]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Fits on the at most max_train labelled rows, outside the held-out fold, of least id hash."""
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "doc_id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    # at most max_train rows; ties (a repeated doc_id) are settled by text
    chosen = texts.orderBy(order, "doc_id", "text").limit(max_train).select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        t = pa.Table.from_batches(got)
        index, value = fit(t["text"].combine_chunks(), t["toxic"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(value)], names=["i", "w"])

    got = chosen.coalesce(1).mapInArrow(run, "i bigint, w double").collect()
    return np.array([r.i for r in got], np.int64), np.array([r.w for r in got])


def _scorer(model, text_col: str):
    """scores(batch) of a broadcast model; the dense weights are made once a worker."""
    state: dict = {}

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        if "w" not in state:
            index, value = model.value
            w = np.zeros((1 << BITS) + 1)
            w[index] = value
            every = np.arange(1 << BITS)
            state["at"] = [np.arange(1 << BITS), level(every, 2), level(every, 3)]
            state["any"] = (w[state["at"][0]] != 0) | (w[state["at"][1]] != 0) | (w[state["at"][2]] != 0)
            state["w"] = w
        w, out, mask = state["w"], np.zeros(batch.num_rows), (1 << BITS) - 1
        for ch in tc.chunks(batch.column(text_col)):
            index, doc = features(ch)
            hit = np.flatnonzero(state["any"][index])
            key, count = np.unique((doc[hit] << BITS) | index[hit], return_counts=True)
            more = [((key[count >= k] >> BITS) << BITS) | state["at"][k - 1][key[count >= k] & mask] for k in (2, 3)]
            key = np.unique(np.concatenate((key, *more)))  # each coordinate once a document
            out[ch.first : ch.last] = np.bincount(key >> BITS, weights=w[key & mask], minlength=len(ch))
        return 1 / (1 + np.exp(-np.clip(out + w[1 << BITS], -35, 35)))

    return scores


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts have no features and get the score of the bias alone.  Labels that
    are null or neither 0 nor 1 are left out, of contradicting labels of one id 1 counts, and
    without any label every score is 0.5.  Repeated rows get equal scores.  Only id and text
    of documents are read; labels, lang and source are never inputs of a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, max_train))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    score = _scorer(model, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch))], names=["doc_id", "score"])

    got = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, all_docs: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """The documents scored under 0.5, all columns kept; one map pass without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(all_docs if all_docs is not None else docs, labels, text_col=text_col))
    score = _scorer(model, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch) < 0.5))

    return docs.mapInArrow(run, docs.schema)
