"""Toxicity: bags of subword embeddings, averaged, into a linear softmax.

A word's vector is the mean of the vectors of its hashed character n-grams, a
window's vector the mean over its words; a softmax over two classes reads it.
Embeddings and softmax are trained together, so a misspelling never seen lies
near the words it shares n-grams with. A text is cut into windows of a few words,
since two insults among thousands of words vanish in one average; a small
logistic reading of the window log odds (highest, mean) gives the text's score.
Both layers being linear, a trained model folds into one number per n-gram, and
scoring costs one table look-up per distinct word of a batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, give_back, gram_sums, letters_only, ngram_table, sampled, text_slices, text_source

SIZES = (3, 4, 5, 6)
#: Windows of a mini-batch.
BATCH = 256


class SubwordSoftmax:
    """The trained model.

    ``weights`` by n-gram bucket and ``bias`` give the log odds of a window of
    ``window`` words; ``reading`` turns a text's window log odds into its own.
    """

    def __init__(self, weights: np.ndarray, bias: float, window: int, reading: np.ndarray | None = None):
        self.weights, self.bias, self.window = weights, bias, window
        self.reading = reading

    def word_values(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its summand, and whether it has letters (others do not count)."""
        clean = letters_only(vocabulary)
        has = pc.binary_length(clean).to_numpy(zero_copy_only=False) > 0
        total, grams = gram_sums(clean, SIZES, self.weights[:, None])
        return np.where(has, total[:, 0] / np.maximum(grams, 1), 0), has

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Of each text: highest window log odds, mean window probability, mean log odds, log of the word count."""
        words = Words(texts)
        value, has = self.word_values(words.vocabulary)
        codes = words.codes[has[words.codes]]
        counts = words.sums(has.astype(float)).astype(np.int64)
        out = np.zeros((len(texts), 4))
        out[:, 0] = out[:, 2] = self.bias
        out[:, 1] = 1 / (1 + np.exp(-self.bias))
        full = np.flatnonzero(counts)
        if not len(full):
            return out
        edges, per_text = window_edges(counts[full], self.window)
        odds = np.add.reduceat(value[codes], edges) / np.diff([*edges, len(codes)]) + self.bias
        first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
        out[full, 0] = np.maximum.reduceat(odds, first)
        out[full, 1] = np.add.reduceat(1 / (1 + np.exp(-np.clip(odds, -30, 30))), first) / per_text
        out[full, 2] = np.add.reduceat(value[codes], np.concatenate([[0], np.cumsum(counts[full])[:-1]])) / counts[full] + self.bias
        out[full, 3] = np.log(counts[full])
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.reading is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        return 1 / (1 + np.exp(-np.clip(design(self.evidence(texts)) @ self.reading, -50, 50)))


def window_edges(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows begin if each text is cut into windows of nearly equal size, and how many each has."""
    per_text = np.maximum(1, np.round(counts / window).astype(np.int64))
    begin = np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), per_text)
    step = np.repeat(counts / per_text, per_text)
    rank = np.arange(len(begin)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    return (begin + np.floor(rank * step + 1e-9)).astype(np.int64), per_text


def design(evidence: np.ndarray) -> np.ndarray:
    top, share, mean, size = evidence.T
    return np.stack([np.ones(len(top)), np.tanh(top / 6), top / 10, np.sqrt(share), share, np.tanh(mean / 3), size / 5], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps for a logistic regression with a ridge on all but the first weight."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], labels: np.ndarray, buckets: int = 1 << 17, width: int = 4, window: int = 8, epochs: int = 2, steps: int = 1250, rate: float = 0.5, scale: float = 24.0, seed: int = 7, prior: float | None = None) -> SubwordSoftmax:
    """Joint training by mini-batch Adagrad in numpy.

    All windows of the texts are used, and carry their text's label. They are gone
    through ``epochs`` times, more often where that makes fewer than ``steps``
    mini-batches of all: few windows need as many steps as many do. Embeddings and softmax learn from half of the texts
    each time, and the reading of window log odds is fitted on the other half, so
    that it sees odds of texts that were not learnt by heart; the final embeddings
    learn from all. ``prior`` is the share of class 1 in the population: the
    reading's constant is moved where the sample's share differs.
    """
    if len(texts) == 0 or labels.min() == labels.max():
        share = prior if prior is not None else (float(labels.mean()) if len(labels) else 0.0)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return SubwordSoftmax(np.zeros(buckets), float(np.log(share / (1 - share))), window)
    half = np.arange(len(texts)) % 2
    evidence, seen = np.zeros((len(texts), 4)), []
    everything = pa.array(texts, pa.large_string())
    windows = len(window_edges(Words(everything).counts, window)[0])
    # the halves are gone through as often as the whole, so that their odds are as large
    epochs = max(epochs, math.ceil(steps * BATCH / max(windows, BATCH)))
    for k in (0, 1):
        inner = np.flatnonzero(half != k)
        if len(set(labels[inner])) < 2:
            continue
        part = _embed(everything.take(inner), labels[inner], buckets, width, window, epochs, rate, scale, seed)
        evidence[half == k] = part.evidence(everything.take(np.flatnonzero(half == k)))
        seen.append(k)
    model = _embed(everything, labels, buckets, width, window, epochs, rate, scale, seed)
    used = np.isin(half, seen) if seen else np.ones(len(texts), bool)
    if not seen:
        evidence = model.evidence(everything)
    model.reading = logistic(design(evidence[used]), labels[used].astype(float))
    if prior is not None and 0 < prior < 1:
        model.reading[0] += np.log(prior / (1 - prior)) - np.log(labels.mean() / (1 - labels.mean()))
    return model


def _embed(texts: pa.Array, labels: np.ndarray, buckets: int, width: int, window: int, epochs: int, rate: float, scale: float, seed: int) -> SubwordSoftmax:
    words = Words(texts)
    clean = letters_only(words.vocabulary)
    owner, bucket = ngram_table(clean, SIZES, buckets)
    grams = np.bincount(owner, minlength=len(clean))
    first = np.concatenate([[0], np.cumsum(grams)])
    has = pc.binary_length(clean).to_numpy(zero_copy_only=False) > 0
    counts = words.sums(has.astype(float)).astype(np.int64)
    codes, full = words.codes[has[words.codes]], np.flatnonzero(counts)
    rng = np.random.default_rng(seed)
    table = (rng.standard_normal((buckets, width)) / width).astype(np.float32) * 0.1
    head = (rng.standard_normal((width, 2)) * 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    if not len(full):
        return SubwordSoftmax(np.zeros(buckets), 0.0, window)
    edges, per_text = window_edges(counts[full], window)
    ends, target = np.array([*edges[1:], len(codes)]), np.repeat(labels[full], per_text)
    table_sq, head_sq = np.full(buckets, 1e-3, np.float32), np.full((width, 2), 1e-3, np.float32)
    bias_sq = np.full(2, 1e-3, np.float32)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(edges)), max(1, len(edges) // BATCH)):
            sizes = ends[part] - edges[part]
            code = codes[_spans(edges[part], sizes)]
            span = grams[code]
            ids = bucket[_spans(first[code], span)]
            weights = np.repeat((scale / np.repeat(sizes, sizes) / span).astype(np.float32), span)
            of = np.repeat(np.repeat(np.arange(len(part)), sizes), span)
            touched, back = np.unique(ids, return_inverse=True)
            local = table[touched]
            hidden = np.stack([np.bincount(of, local[back, k] * weights, len(part)) for k in range(width)], 1).astype(np.float32)
            logit = hidden @ head + bias
            logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), target[part]] -= 1
            p /= len(part)
            to_hidden = p @ head.T
            for value, square, grad in ((head, head_sq, hidden.T @ p), (bias, bias_sq, p.sum(0))):
                square += grad**2
                value -= rate * 0.25 * grad / np.sqrt(square)
            grad = np.stack([np.bincount(back, to_hidden[of, k] * weights, len(touched)) for k in range(width)], 1).astype(np.float32)
            table_sq[touched] += (grad**2).mean(1)
            table[touched] = local - rate * grad / np.sqrt(table_sq[touched])[:, None]
    return SubwordSoftmax((table @ (head[:, 1] - head[:, 0]) * scale).astype(np.float64), float(bias[1] - bias[0]), window)


def _spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... of each span, one after another."""
    return np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 1500, **options) -> SubwordSoftmax:
    """Train on a bounded sample of labelled rows.

    ``sample_rows`` bounds the rows of each class, which are whole texts. Rows with a
    null id, text or label teach nothing; of several labels of one id the largest
    counts, of unlike texts the smallest. The population's share of class 1 is
    counted over all labels. Without labelled texts the model knows the share alone.
    """
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = sampled(y.where("y = 1"), "id", sample_rows).unionByName(sampled(y.where("y = 0"), "id", sample_rows))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # ``picked`` has at most twice sample_rows rows
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).toPandas().sort_values("id", kind="stable")
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    texts, y = rows["text"].tolist(), rows["y"].to_numpy(np.int64)
    del rows
    model = train(texts, y, prior=prior if counts else None, **options)
    give_back()
    return model


def score(documents: DataFrame, model: SubwordSoftmax, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Columns ``keep`` (the id, if none are named), ``score`` and ``predicted``.

    ``prefix`` goes before new names, where kept columns have the same ones. One row per input row, repeated rows
    and null ids included; null and empty texts get the score of the bias alone; an empty table gives an empty one.
    No shuffle: texts are read once, in slices of bounded size.
    """
    keep = keep if keep is not None else [id_col]
    source = text_source(documents, *keep, F.col(text_col).alias("__text"))
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            value = shipped.value.scores(part.column("__text"))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [*keep, f"{prefix}score", f"{prefix}predicted"])

    schema = source.drop("__text").schema.add(f"{prefix}score", "double").add(f"{prefix}predicted", "integer")
    return source.mapInArrow(run, schema)
