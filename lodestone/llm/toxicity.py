"""Operator 8: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textnp
from lodestone.llm.common import beside_text, fields_of, is_held_out, worker_batches

#: Hash buckets; the weights that reach the workers are at most so many pairs.
BITS = 20
#: The model is fitted on at most so many labelled documents (those of the smallest id hashes).
TRAIN_DOCS = 20_000
#: Chosen by ``tune_toxicity`` on labelled rows outside the held-out part alone.
ALPHA, BETA, L1, L2, EPOCHS = 3.0, 1.0, 6.0, 1.0, 3
THRESHOLD = 0.3
#: Bias of a model that has seen no document.
NOTHING = -20.0


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Document number and bucket of every unigram, bigram and skip-gram (one word between) of the texts."""
    buf, bounds = textnp.joined(texts)
    at, h = textnp.words(buf, bare=True)
    doc = np.searchsorted(bounds, at, "right") - 1
    ids, docs = [h], [doc]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        ids.append(textnp.combine(h[:-gap][same], h[gap:][same] + textnp.U(gap)))
        docs.append(doc[gap:][same])
    return np.concatenate(docs), (np.concatenate(ids) >> textnp.U(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal with L1; the last coordinate is the bias and is not regularised."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i: np.ndarray) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        l1 = np.where(i == len(self.z) - 1, 0.0, self.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, i: np.ndarray, y: float) -> float:
        """One example with the distinct active coordinates ``i``; returns its score before the step."""
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - y
        n = self.n[i]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] = n + g * g
        return p


def train(texts, labels, epochs: int = EPOCHS, **rates) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with non-zero weights and their weights; the bias stands at bucket 2^BITS."""
    size = 1 << BITS
    model, examples = Ftrl(size + 1, **rates), []
    for lo, hi in textnp.groups([len(t or b"") for t in texts], 1 << 21):
        doc, ids = features(texts[lo:hi])
        order = np.lexsort((ids, doc))
        doc, ids = doc[order], ids[order]
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1])
        doc, ids = doc[keep], ids[keep].astype(np.int32)
        cut = np.searchsorted(doc, np.arange(hi - lo + 1))
        examples += [np.append(ids[cut[j] : cut[j + 1]], size) for j in range(hi - lo)]
    for _ in range(epochs):
        for i, y in zip(examples, labels):
            model.learn(i, y)
    every = np.arange(size + 1)
    w = model.weights(every)
    found = np.flatnonzero(w)
    return found, w[found]


def score(texts: list[bytes | None], dense: np.ndarray) -> np.ndarray:
    doc, ids = features(texts)
    hit = np.flatnonzero(dense[ids])
    pairs = np.unique(doc[hit] * (1 << BITS) + ids[hit])  # presence, not counts
    logit = dense[-1] + np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], len(texts))
    return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Train on at most ``train_docs`` labelled documents outside the held-out part.

    One task sees them in the order of an id hash, so reruns agree. Where an id
    has several labels the largest counts, of several texts the last in order;
    null labels are ignored. Without labelled documents nothing is known to be
    toxic: the model is a bias that scores all texts next to 0.
    At most 2^BITS + 1 weights reach the driver.
    """
    picked = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"), 4, 2))
    picked = picked.groupBy("doc_id").agg(F.max(column).alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    picked = picked.withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # at most train_docs ids
    rows = rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("_y").alias("y"))
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select(F.col("text").cast("binary"), F.col("y").cast("double"))

    def learn(batches):
        texts, ys = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            ys += b.column(1).to_pylist()
        ids, w = train(texts, ys) if texts else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(w, pa.float64())], ["id", "w"])

    with worker_batches(docs.sparkSession):
        found = rows.mapInArrow(learn, "id long, w double").collect() or [(1 << BITS, NOTHING)]
    return np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found])


def score_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``, from the whole text alone.

    Other columns are kept, those named score or predicted are replaced. Null
    and empty texts get the score of the bias.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model[0].astype(np.int32), model[1].astype(np.float32)))
    fields = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    where = fields.index("text")
    kept = docs.select(*fields)
    schema = kept.withColumn("score", F.lit(0.0)).schema

    def run(batches):
        dense = np.zeros((1 << BITS) + 1)
        dense[sent.value[0]] = sent.value[1]
        for b in batches:
            texts = b.column(where).cast(pa.binary()).to_pylist()
            parts = [score(texts[lo:hi], dense) for lo, hi in textnp.groups([len(t or b"") for t in texts], 1 << 21)]
            yield pa.record_batch([*b.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], [*b.schema.names, "score"])

    return kept.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxic_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the model does not reject; all columns as they are."""
    scored = score_documents(beside_text(docs), fit(docs, labels)).where("predicted = 0")
    return scored.select(*fields_of(docs.columns, text=F.col("text")))


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score_documents(docs, fit(docs, labels))
    return out.select("doc_id", is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
