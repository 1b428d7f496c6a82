"""Quality: a weak-label model over heuristic labellers, and a hashed linear scorer.

Labellers look at a text's symbols, case, repetition, tables, lines and lengths
and vote good, bad or nothing. Expectation-maximisation over the counts of vote
patterns (at most 4 ** labellers, however many texts) estimates each labeller's
accuracy, no true label being known, and so the posterior of each pattern. The
posteriors are the targets of a linear scorer over hashed features of words (the
word, its shape, its length) and of the text, which also sees what no labeller
looks at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, give_back, mix, sampled, text_slices, text_source

#: (measure, bad below, bad above, good from, good to): between them a labeller abstains.
LABELLERS = (
    ("symbols", None, 0.05, None, 0.01),
    ("capitals", None, 0.5, None, 0.1),
    ("variety", 0.3, None, 0.5, None),
    ("runs", None, 0.2, None, 0.05),
    ("bare", None, 0.2, None, 0.02),
    ("lines", None, 0.3, None, 0.1),
    ("word_length", 3.0, 9.0, 4.5, 7.0),
    ("words", 1.0, None, 50.0, None),
)
MEASURES = [x[0] for x in LABELLERS]
BUCKETS = 1 << 16
#: A labeller that cannot judge a text (too few words) neither votes nor withholds a vote.
MISSING = 2
#: A weak prior that names the classes: chances of bad, none, good votes for bad and for good texts, worth so many
#: texts of each class, whatever the number of texts. A thousand texts outweigh it.
PRIOR, PRIOR_TEXTS = np.array([[0.3, 0.2, 0.5], [0.01, 0.09, 0.9]]), 4.0


class Texts:
    """Measures and features of some texts; words are looked at once each."""

    def __init__(self, texts: pa.Array):
        self.words = words = Words(texts, lower="")
        self.strings = words.vocabulary.to_pylist()
        n = words.counts
        size = np.maximum(n, 1)
        points, of, lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.fromiter(map(len, self.strings), np.int64, len(self.strings))
        if self.strings:
            points, of = np.frombuffer("".join(self.strings).encode("utf-32-le", "surrogatepass"), np.uint32), np.repeat(np.arange(len(self.strings)), lengths)
        table, back = np.unique(points, return_inverse=True)
        kind = np.array([1 if (c := chr(p)).isupper() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?'\"-()" else 5 for p in table.tolist()], np.int64) if len(table) else np.zeros(0, np.int64)
        self.kind, self.of, self.points, self.lengths = kind[back], of, points, lengths
        per = lambda mask: np.bincount(of, mask, len(self.strings))
        upper, letters, odd = per(self.kind == 1), per(self.kind <= 2), per(self.kind == 5)
        characters = np.maximum(words.sums(lengths.astype(float)), 1)
        row = np.repeat(np.arange(len(n)), n)
        same = np.zeros(len(row), bool)
        if len(row):
            same[1:] = (words.codes[1:] == words.codes[:-1]) & (row[1:] == row[:-1])
        distinct = np.bincount(np.unique(row * max(1, len(self.strings)) + words.codes) // max(1, len(self.strings)), minlength=len(n))
        lines = np.zeros(len(n))
        for i, text in enumerate(texts.to_pylist()):
            found = [x for x in (text or "").split("\n") if x]
            lines[i] = 1 - len(set(found)) / len(found) if found else 0
        letters_of = np.maximum(words.sums(letters), 1)
        self.measures = {
            "symbols": words.sums(odd) / characters, "capitals": words.sums(upper) / letters_of, "variety": distinct / size,
            "runs": np.bincount(row, same, len(n)) / size, "bare": words.sums((letters == 0).astype(float)) / size,
            "lines": lines, "word_length": characters / size, "words": n.astype(float),
        }

    def votes(self) -> np.ndarray:
        """-1 bad, 1 good, 0 neither, MISSING where a labeller cannot judge; without words only ``words`` can."""
        out = np.zeros((len(self.words.counts), len(LABELLERS)), np.int8)
        empty = self.words.counts == 0
        for k, (name, low, high, good_from, good_to) in enumerate(LABELLERS):
            m = self.measures[name]
            bad = (m < low if low is not None else np.zeros(len(m), bool)) | (m > high if high is not None else np.zeros(len(m), bool))
            good = (m >= good_from if good_from is not None else np.ones(len(m), bool)) & (m <= good_to if good_to is not None else np.ones(len(m), bool))
            out[:, k] = np.where(bad, -1, np.where(good, 1, 0))
            if name != "words":
                out[empty, k] = MISSING
        # shares of few words say little
        few = self.words.counts < 10
        for name in ("variety", "runs", "lines", "word_length", "capitals", "bare"):
            out[few, MEASURES.index(name)] = MISSING
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, bucket, weight) of the hashed features: a text's word features weigh 1 in all, its own 1 each."""
        strings = self.strings
        row, bucket, weight = [], [], []
        n = np.maximum(self.words.counts, 1)
        of_row = np.repeat(np.arange(len(n)), self.words.counts)
        if strings:
            named = pd.util.hash_array(np.array([s.lower() for s in strings], object), categorize=False)
            # a word's shape: the kinds of its characters, repeats put together; symbols count as themselves
            shape = self.kind.astype(np.uint64) * np.uint64(131) + np.where(self.kind == 5, self.points, 0).astype(np.uint64)
            first = np.concatenate([[True], (shape[1:] != shape[:-1]) | (self.of[1:] != self.of[:-1])])
            kept, owner = shape[first], self.of[first]
            place = np.arange(len(kept)) - np.searchsorted(owner, owner)
            shaped = np.zeros(len(strings), np.uint64)
            np.add.at(shaped, owner, mix(kept + np.uint64(977) * place.astype(np.uint64)))
            for k, value in enumerate((named, shaped, np.minimum(self.lengths, 20).astype(np.uint64))):
                row.append(of_row)
                bucket.append((mix(value * np.uint64(7) + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int64)[self.words.codes])
                weight.append(1 / n[of_row])
        for k, name in enumerate(("variety", "runs", "lines", "words")):
            m = self.measures[name]
            step = np.floor(np.log2(m + 1)) if name == "words" else np.floor(m * 10)
            row.append(np.arange(len(n)))
            bucket.append((mix(step.astype(np.uint64) * np.uint64(31) + np.uint64(1000 + k)) % np.uint64(BUCKETS)).astype(np.int64))
            weight.append(np.ones(len(n)))
        return np.concatenate(row), np.concatenate(bucket), np.concatenate(weight)


class WeakLabels:
    """What EM found: the share of good texts, and each labeller's chances of a bad vote, none and a good one, for bad and for good texts."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 500):
        k = votes.shape[1]
        one_hot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)  # pattern, labeller, vote
        margin = np.where(votes == MISSING, 0, votes).sum(1)
        good = 1 / (1 + np.exp(-(margin - 2.0 * (votes == -1).sum(1))))  # a first guess: bad votes are rarer and weigh more
        self.share, self.chances = 0.5, np.full((2, k, 3), 1 / 3)
        for _ in range(rounds):
            weights = np.stack([(1 - good) * counts, good * counts])
            self.chances = np.einsum("yp,pkv->ykv", weights, one_hot) + PRIOR[:, None, :] * PRIOR_TEXTS
            self.chances /= self.chances.sum(2, keepdims=True)
            self.share = (weights[1].sum() + 1) / (counts.sum() + 2)
            before, good = good, self.posterior(votes)
            if np.abs(before - good).max(initial=0) < 1e-9:
                break

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance that each text is good, by its votes."""
        which = np.clip(votes.astype(int) + 1, 0, 2)
        log = (np.log(self.chances)[:, np.arange(votes.shape[1]), which] * (votes != MISSING)).sum(2)
        odds = log[1] - log[0] + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """How often each labeller is right when it votes."""
        weigh = np.array([1 - self.share, self.share])
        right = weigh[0] * self.chances[0, :, 0] + weigh[1] * self.chances[1, :, 2]
        cast = (weigh[:, None, None] * self.chances[:, :, [0, 2]]).sum((0, 2))
        return dict(zip(MEASURES, (right / cast).tolist()))


class QualityModel:
    def __init__(self, labels: WeakLabels, weights: np.ndarray, bias: float):
        self.labels, self.weights, self.bias = labels, weights, bias

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(posterior by votes, score of the linear scorer)."""
        seen = Texts(texts)
        row, bucket, weight = seen.features()
        odds = np.bincount(row, self.weights[bucket] * weight, len(texts)) + self.bias
        return self.labels.posterior(seen.votes()), 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train_scorer(texts: pa.Array, target: np.ndarray, epochs: int = 30, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full-batch Adagrad."""
    row, bucket, weight = Texts(texts).features()
    w, square, bias, bias_sq = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8), 0.0, 1e-8
    n = max(1, len(target))
    for _ in range(epochs * 3):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[bucket] * weight, len(target)) + bias, -30, 30)))
        grad = np.bincount(bucket, (p - target)[row] * weight, BUCKETS) / n + decay * w
        square += grad**2
        w -= rate * grad / np.sqrt(square)
        g = float((p - target).mean()) if len(target) else 0.0
        bias_sq += g * g
        bias -= rate * g / np.sqrt(bias_sq)
    return w, bias


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2500) -> QualityModel:
    """Labellers' accuracies from all texts; the scorer from a bounded sample.

    ``sample_rows`` bounds the scorer's rows, which are whole texts. Rows with a null
    id or text are not drawn; of unlike texts under one id the smallest is. An empty
    table gives a model whose scores are all one half.
    """
    source = text_source(documents, F.col(text_col).alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            votes, counts = np.unique(Texts(part.column("text")).votes(), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(list(votes.astype(np.int32)), pa.list_(pa.int32())), pa.array(counts)], ["votes", "n"])

    patterns = source.mapInArrow(vote, "votes array<int>, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").collect()  # at most 4 ** labellers rows
    votes = np.array([r["votes"] for r in patterns], np.int8).reshape(-1, len(LABELLERS))
    labels = WeakLabels(votes, np.array([r["n"] for r in patterns], float))
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    ids = sampled(rows.select("id"), "id", sample_rows)
    drawn = rows.join(F.broadcast(ids.distinct()), "id").groupBy("id").agg(F.min("text").alias("text"))
    texts = pa.array(drawn.toPandas().sort_values("id", kind="stable")["text"].tolist(), pa.large_string())
    model = QualityModel(labels, *train_scorer(texts, labels.posterior(Texts(texts).votes())))
    del texts
    give_back()
    return model


def judge(documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Columns ``keep`` (the id, if none are named), ``posterior``, ``score`` and ``good``.

    ``prefix`` goes before new names, where kept columns have the same ones. One row per input row, repeated rows
    included; null and empty texts are judged as texts without words; an empty table gives an empty one. No shuffle.
    """
    keep = keep if keep is not None else [id_col]
    source = text_source(documents, *keep, F.col(text_col).alias("__text"))
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            posterior, score = shipped.value.judge(part.column("__text"))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(posterior), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*keep, f"{prefix}posterior", f"{prefix}score", f"{prefix}good"])

    schema = source.drop("__text").schema.add(f"{prefix}posterior", "double").add(f"{prefix}score", "double").add(f"{prefix}good", "integer")
    return source.mapInArrow(run, schema)
