"""Language identification: a linear-chain conditional random field over words.

Every word of a text gets a language. A word's emission sums the weights of its
affixes (character n-grams that hold a word edge), inner n-grams and, as lexicon,
the word itself; learned transitions say how often languages change between
neighbours. Forward-backward gives each word's distribution, and the text's
language is the one with the largest expected number of words.

Emissions depend on the word type alone, so they are computed once per distinct
word of a batch. The chain is evaluated for all texts of a batch together: texts
are cut into chunks whose transfer matrices are multiplied side by side, chunk
boundaries are then joined in order, so a text of 100,000 words costs no more
steps than its number of chunks, with exact results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Words, give_back, gram_sums, key_hash, letters_only, likely, ngram_table, stored, text_slices, text_source

SIZES = (1, 2, 3, 4)
CHUNK = 64
UNKNOWN = "und"
SPANS = "spans array<struct<first: int, words: int, lang: string, score: double>>"


class WordField:
    """``weights[bucket, language]``, ``change[from, to]`` (log potentials) and the languages' names."""

    def __init__(self, languages: list[str], weights: np.ndarray, change: np.ndarray):
        self.languages, self.weights, self.change = languages, weights, change

    def emissions(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log potentials of each word, and whether it has a letter (else all zero)."""
        clean = letters_only(vocabulary)
        has = pc.binary_length(clean).to_numpy(zero_copy_only=False) > 0
        out, grams = gram_sums(clean, SIZES, self.weights)
        return np.where(has[:, None], out / np.sqrt(np.maximum(grams, 1))[:, None], 0), has

    def posteriors(self, texts: pa.Array) -> tuple[Words, np.ndarray]:
        """The texts' words, and each word's distribution over languages (all zero for words without letters)."""
        words = Words(texts)
        emission, has = self.emissions(words.vocabulary)
        p = forward_backward(emission, words.codes, words.counts, self.change)
        p[~has[words.codes]] = 0
        return words, p

    def expected(self, texts: pa.Array) -> np.ndarray:
        """Of each text, the expected number of words (those with letters) in each language."""
        words, p = self.posteriors(texts)
        total = np.concatenate([np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)])
        return total[words.starts + words.counts] - total[words.starts]

    def spans(self, texts: pa.Array) -> pa.ListArray:
        """Of each text, its stretches of words with one label: number of the first word, words, label, mean posterior."""
        if not self.languages:
            words = Words(texts)
            p = np.zeros((len(words.codes), 1))
        else:
            words, p = self.posteriors(texts)
        n, best = len(p), p.argmax(1)
        sure = p[np.arange(n), best]
        label = np.where(sure > 0, best, len(self.languages))
        fresh = np.ones(n, bool)
        fresh[1:] = label[1:] != label[:-1]
        fresh[words.starts[words.counts > 0]] = True
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, n))
        text_of = np.repeat(np.arange(len(words.counts)), words.counts)[first]
        total = np.concatenate([[0.0], np.cumsum(sure)])
        names = np.array([*self.languages, UNKNOWN], object)
        columns = [pa.array(first - words.starts[text_of], pa.int32()), pa.array(size, pa.int32()), pa.array(names[label[first]], pa.string()), pa.array((total[first + size] - total[first]) / np.maximum(size, 1), pa.float64())]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(text_of, minlength=len(words.counts)))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["first", "words", "lang", "score"]))

    def predict(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        if not self.languages or not len(texts):
            return pa.array([UNKNOWN] * len(texts)), np.zeros(len(texts))
        mass = self.expected(texts)
        total = mass.sum(1)
        best, none = mass.argmax(1), total <= 0
        score = np.clip(mass[np.arange(len(mass)), best] / np.where(none, 1, total), 0, 1)
        names = np.array([*self.languages, UNKNOWN], object)
        return pa.array(names[np.where(none, len(self.languages), best)], pa.string()), np.where(none, 0.0, score)


def forward_backward(emission: np.ndarray, codes: np.ndarray, counts: np.ndarray, change: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
    """Posterior of each word's label, texts one after another.

    ``pairs``, if given, gets the expected number of label pairs added.
    """
    n, labels = len(codes), emission.shape[1]
    if not n:
        return np.zeros((0, labels))
    potential = np.exp(emission - emission.max(1, keepdims=True))
    step = np.exp(change - change.max())
    chunks = -(-counts // CHUNK)
    order = np.argsort(-chunks, kind="stable")
    order = order[chunks[order] > 0]
    chunk_first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    total = int(chunks.sum())
    text_of = np.repeat(np.arange(len(counts)), chunks)
    rank = np.arange(total) - chunk_first[text_of]
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])[text_of] + rank * CHUNK
    size = np.minimum(CHUNK, counts[text_of] - rank * CHUNK)
    by_size = np.argsort(-size, kind="stable")
    live = [int(np.searchsorted(-size[by_size], -t)) for t in range(CHUNK)]  # chunks with more than t words
    at = begin[by_size]
    # transfer matrix of each chunk: from the state before it to its last word's
    transfer = np.broadcast_to(np.eye(labels), (total, labels, labels)).copy()
    for t in range(CHUNK):
        m = live[t]
        if not m:
            break
        part = (transfer[:m].reshape(-1, labels) @ step).reshape(m, labels, labels) * potential[codes[at[:m] + t]][:, None, :]
        transfer[:m] = part / part.max((1, 2), keepdims=True)
    by_chunk = np.empty_like(transfer)
    by_chunk[by_size] = transfer
    # join chunks: the state before each, and the weight of what follows each
    before, after = np.empty((total, labels)), np.empty((total, labels))
    state = np.ones((len(counts), labels))
    for k in range(int(chunks.max())):
        texts = order[: np.searchsorted(-chunks[order], -k)]
        before[chunk_first[texts] + k] = state[texts]
        state[texts] = _scaled(np.einsum("ni,nij->nj", state[texts], by_chunk[chunk_first[texts] + k]))
    state = np.ones((len(counts), labels))
    for k in range(int(chunks.max()) - 1, -1, -1):
        texts = order[: np.searchsorted(-chunks[order], -k)]
        after[chunk_first[texts] + k] = state[texts]
        state[texts] = _scaled(np.einsum("nij,nj->ni", by_chunk[chunk_first[texts] + k], state[texts]))
    forward, result = np.empty((n, labels)), np.empty((n, labels))
    alpha = before[by_size]
    entering = np.empty((n, labels)) if pairs is not None else None
    for t in range(CHUNK):
        m = live[t]
        if not m:
            break
        where = at[:m] + t
        if entering is not None:
            entering[where] = alpha[:m]
        alpha[:m] = forward[where] = _scaled(alpha[:m] @ step * potential[codes[where]])
    beta = after[by_size]
    for t in range(CHUNK - 1, -1, -1):
        m = live[t]
        if not m:
            continue
        where = at[:m] + t
        both = forward[where] * beta[:m]
        result[where] = both / both.sum(1, keepdims=True)
        seen = potential[codes[where]] * beta[:m]
        if pairs is not None:
            joint = entering[where][:, :, None] * step * seen[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            inner = np.ones(m, bool)
            if t == 0:
                inner = rank[by_size[:m]] > 0  # a text's first word has no neighbour before it
            pairs += joint[inner].sum(0)
        beta[:m] = _scaled(seen @ step.T)
    return result


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.max(1, keepdims=True), 1e-300)


def train(texts: list[str], languages: list[str], buckets: int = 1 << 15, rounds: int = 24, chain_rounds: int = 10, rate: float = 0.5, decay: float = 1e-6) -> WordField:
    """Fit on texts of which only the main language is known.

    First emissions alone learn the text's language for each of its words. Then,
    alternately, words of code-switched stretches are relabelled (posterior under
    the present field, with a preference for the text's own language) and the
    field follows the gradient of its conditional likelihood: observed less
    expected features, and observed less expected label pairs.
    """
    names = sorted(set(languages))
    if not names:
        return WordField([], np.zeros((buckets, 0)), np.zeros((0, 0)))
    k, y = len(names), np.searchsorted(np.array(names, object), np.array(languages, object))
    words = Words(pa.array(texts, pa.large_string()))
    clean = letters_only(words.vocabulary)
    has = pc.binary_length(clean).to_numpy(zero_copy_only=False) > 0
    owner, bucket = ngram_table(clean, SIZES, buckets)
    norm = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(clean)), 1))
    weights, square = np.zeros((buckets, k)), np.full((buckets, k), 1e-8)
    change = np.log(np.where(np.eye(k, dtype=bool), 0.95, 0.05 / max(1, k - 1)))
    change_sq = np.full((k, k), 1e-8)
    label = np.repeat(y, words.counts)
    count = np.bincount(words.codes * k + label, minlength=len(clean) * k).reshape(-1, k).astype(float)
    count[~has] = 0
    total = max(1.0, count.sum())

    def emission() -> np.ndarray:
        out = np.stack([np.bincount(owner, weights[bucket, j], len(clean)) for j in range(k)], 1)
        return np.where(has[:, None], out * norm[:, None], 0)

    def climb(observed: np.ndarray, expected: np.ndarray) -> None:
        grad = (observed - expected) * norm[:, None] / total
        for j in range(k):
            g = np.bincount(bucket, grad[owner, j], buckets) - decay * weights[:, j]
            square[:, j] += g**2
            weights[:, j] += rate * g / np.sqrt(square[:, j])

    weight = count.sum(1, keepdims=True)
    soft = lambda e: np.exp(e - e.max(1, keepdims=True)) / np.exp(e - e.max(1, keepdims=True)).sum(1, keepdims=True)
    for _ in range(rounds if k > 1 else 0):
        climb(count, soft(emission()) * weight)
    prior = np.full((k, k), np.log(0.2 / max(1, k - 1)))
    np.fill_diagonal(prior, np.log(0.8))
    known = has[words.codes]
    for turn in range(chain_rounds if k > 1 else 0):
        e = emission()
        pairs = np.zeros((k, k))
        now = forward_backward(e, words.codes, words.counts, change, pairs)
        if turn % 5 == 0:  # relabel
            wide = e[words.codes] + prior[label] * 0.5
            gold_pairs = np.zeros((k, k))
            target = forward_backward(wide, np.arange(len(words.codes)), words.counts, change, gold_pairs)
            gold = np.stack([np.bincount(words.codes, target[:, j] * known, len(clean)) for j in range(k)], 1)
        model = np.stack([np.bincount(words.codes, now[:, j] * known, len(clean)) for j in range(k)], 1)
        climb(gold, model)
        g = (gold_pairs - pairs) / total
        change_sq += g**2
        change += 0.2 * g / np.sqrt(change_sq)
    return WordField(names, weights, change)


def fit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample_rows: int = 120, sample_texts: int = 16_000, **options) -> WordField:
    """Train on a bounded sample: ``sample_rows`` whole texts of each language.

    Null texts and languages teach nothing, nor do rows without a key; of unlike texts
    under one key and language the smallest teaches. Where languages are so many that
    the sample would pass ``sample_texts`` each has fewer, one at least. Two scans,
    whatever the number of languages: one counts, one draws by a bound on the key's
    hash. An empty table gives a field without languages.
    """
    rows = documents.select(F.col(key_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = max(1, min(sample_rows, sample_texts // max(counts.count(), 1)))
    bounds = counts.select("lang", likely(F.lit(float(share)), F.col("n")).alias("bound"))
    drawn = rows.withColumn("place", key_hash("id")).join(bounds, "lang").where(F.col("place") <= F.col("bound"))
    drawn = stored(drawn.groupBy("lang", "id", "place").agg(F.min("text").alias("text")), "language-sample")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id"))
    texts = drawn.withColumn("rank", rank).where(F.col("rank") <= share).select("id", "text", "lang")
    texts = texts.toPandas().sort_values(["lang", "id"], kind="stable")
    model = train(texts["text"].tolist(), texts["lang"].tolist(), **options)
    del texts
    give_back()
    return model


def predict(documents: DataFrame, model: WordField, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Columns ``keep`` (the id, if none are named), ``lang_pred`` and ``score``.

    ``prefix`` goes before new names, where kept columns have the same ones. One row per input row, repeated rows
    and null ids included; an empty table gives an empty one; texts that are null, empty or without a letter get
    ``und`` and score 0. ``score`` is the share of the text's words expected to be
    in the predicted language. No shuffle.
    """
    keep = keep if keep is not None else [id_col]
    source = text_source(documents, *keep, F.col(text_col).alias("__text"))
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            name, value = shipped.value.predict(part.column("__text"))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], name, pa.array(value)], [*keep, f"{prefix}lang_pred", f"{prefix}score"])

    schema = source.drop("__text").schema.add(f"{prefix}lang_pred", "string").add(f"{prefix}score", "double")
    return source.mapInArrow(run, schema)


def label_words(documents: DataFrame, model: WordField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and ``spans``: the text's words in stretches of one language, in order.

    ``first`` counts words from 0, ``score`` is the mean posterior of the label.
    Words without a letter are ``und`` with score 0. One row per input row. No shuffle.
    """
    source = text_source(documents, id_col, F.col(text_col).alias("__text"))
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([part.column(0), shipped.value.spans(part.column("__text"))], [id_col, "spans"])

    schema = source.drop("__text").schema.add(StructType.fromDDL(SPANS)["spans"])
    return source.mapInArrow(run, schema)
