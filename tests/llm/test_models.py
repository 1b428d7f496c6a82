"""Toxicity, language, quality and n-gram scores."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventide.llm import entry, language, ngrams, quality, toxicity
from eventide.llm.common import Words, fold, ngram_table

FOLDER = "/root/testdata/sf0.01"


def table(spark, name, folder=FOLDER):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_words_of_sliced_arrays():
    texts = pa.array(["Zéro a", "É b  b\tc", None, "", " d "]).slice(1)
    words = Words(texts, lower="ascii")
    assert words.counts.tolist() == [4, 0, 0, 1]
    assert [words.vocabulary[int(c)].as_py() for c in words.codes] == ["É", "b", "b", "c", "d"]
    assert words.sums(np.ones(len(words.vocabulary))).tolist() == [4, 0, 0, 1]


def test_ngrams_do_not_depend_on_neighbours():
    one = ngram_table(pa.array(["stupid"]), (3, 4), 1 << 16)[1]
    owner, bucket = ngram_table(pa.array(["a", "stupid", ""]), (3, 4), 1 << 16)
    assert sorted(bucket[owner == 1].tolist()) == sorted(one.tolist())


def synthetic_toxic(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    bad = ["wretch", "vermin", "dimwit"]
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 80))
        if i % 3 == 0:
            for _ in range(max(1, len(words) // 20)):
                words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, np.array(labels)


def test_toxicity_learns_words_and_their_misspellings():
    texts, labels = synthetic_toxic(600, 1)
    model = toxicity.train(texts, labels)
    fresh, wanted = synthetic_toxic(300, 1)
    assert ((model.scores(pa.array(fresh)) >= 0.5) == (wanted == 1)).mean() > 0.95
    values, _ = model.word_values(pa.array(["vermin", "vermiin", "verrmin", "bakelu", "tosina"]))
    assert values[1:3].min() > values[3:].max()


def test_toxicity_trains_alike_and_without_labels():
    texts, labels = synthetic_toxic(90, 2)
    a, b = toxicity.train(texts, labels), toxicity.train(texts, labels)
    assert np.array_equal(a.weights, b.weights)
    assert toxicity.train([], np.zeros(0, int)).scores(pa.array(["x", None])).max() < 0.01  # nothing is known of toxic texts
    assert (toxicity.train(["a"], np.array([1])).scores(pa.array(["a"])) > 0.9).all()


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    found = entry.op1_toxicity(spark, folder).join(table(spark, "labels", folder), "doc_id").where("held_out").toPandas()
    assert auc(found.score.to_numpy(), found.toxic.to_numpy()) > 0.9
    assert found.predicted[found.toxic == 0].mean() < 0.04
    assert ((found.score >= 0.5).astype(int) == found.predicted).all()


def test_window_edges():
    edges, per_text = toxicity.window_edges(np.array([1, 20, 7]), 8)
    assert per_text.tolist() == [1, 2, 1] and edges.tolist() == [0, 1, 11, 21]


def brute_chain(emission, change):
    labels = emission.shape[1]
    start = np.ones(labels) @ np.exp(change)
    total = np.zeros(emission.shape)
    import itertools

    for path in itertools.product(range(labels), repeat=len(emission)):
        weight = start[path[0]] * math.exp(emission[0, path[0]])
        for i in range(1, len(path)):
            weight *= math.exp(change[path[i - 1], path[i]] + emission[i, path[i]])
        for i, k in enumerate(path):
            total[i, k] += weight
    return total / total.sum(1, keepdims=True)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    emission, change = rng.normal(size=(20, 3)), rng.normal(size=(3, 3))
    counts = np.array([0, 1, 7, 4])
    codes = rng.integers(0, 20, counts.sum())
    found, at = language.forward_backward(emission, codes, counts, change), 0
    for n in counts:
        if n:
            assert np.allclose(found[at : at + n], brute_chain(emission[codes[at : at + n]], change))
        at += n


def test_forward_backward_over_chunks():
    """Long texts, cut into chunks, give what one pass gives."""
    rng = np.random.default_rng(4)
    emission, change = rng.normal(size=(30, 4)), rng.normal(size=(4, 4))
    counts = np.array([200, 64, 65, 3])
    codes = rng.integers(0, 30, counts.sum())
    pairs = np.zeros((4, 4))
    found, at = language.forward_backward(emission, codes, counts, change, pairs), 0
    for n in counts:
        e, a = np.exp(emission[codes[at : at + n]]), np.exp(change)
        f, b = np.zeros((n, 4)), np.ones((n, 4))
        f[0] = np.ones(4) @ a * e[0]
        for t in range(1, n):
            f[t] = f[t - 1] @ a * e[t]
            f[t] /= f[t].sum()
        for t in range(n - 2, -1, -1):
            b[t] = a @ (e[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        p = f * b
        assert np.allclose(found[at : at + n], p / p.sum(1, keepdims=True))
        at += n
    assert math.isclose(pairs.sum(), (counts - 1).sum())


def test_language_on_held_out_rows(spark):
    found = entry.op2_language(spark, FOLDER).join(table(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_language_marks_switched_words():
    rng = random.Random(5)
    words = {"aa": ["kalo", "kiro", "kanu", "kelo"], "bb": ["strung", "brisk", "plumb", "grist"]}
    texts = [" ".join(rng.choices(words[k], k=30)) for k in ("aa", "bb") * 30]
    model = language.train(texts, ["aa", "bb"] * 30)
    mass = model.expected(pa.array(["kalo kiro kanu kelo brisk strung plumb grist grist brisk"]))
    assert np.allclose(mass[0], [4, 6], atol=0.3)
    names, score = model.predict(pa.array(["kalo kiro", "12 !", None, ""]))
    assert names.to_pylist() == ["aa", "und", "und", "und"] and score.tolist()[1:] == [0, 0, 0]
    assert np.diag(model.change).min() > model.change[0, 1]


def test_language_labels_words_of_documents(spark):
    rng = random.Random(5)
    words = {"aa": ["kalo", "kiro", "kanu", "kelo"], "bb": ["strung", "brisk", "plumb", "grist"]}
    model = language.train([" ".join(rng.choices(words[k], k=30)) for k in ("aa", "bb") * 30], ["aa", "bb"] * 30)
    rows = [(1, "kalo kiro  kanu kelo brisk strung 12 plumb grist"), (2, None), (3, "grist"), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r["doc_id"]: r["spans"] for r in language.label_words(docs, model).collect()}
    assert [(x["first"], x["words"], x["lang"]) for x in found[1]] == [(0, 4, "aa"), (4, 2, "bb"), (6, 1, "und"), (7, 2, "bb")]
    assert found[2] == found[4] == [] and [tuple(x)[:3] for x in found[3]] == [(0, 1, "bb")]
    assert all((x["score"] > 0.5) == (x["lang"] != "und") for x in found[1])
    assert [tuple(x) for x in language.label_words(docs, language.train([], [])).where("doc_id = 3").first()["spans"]] == [(0, 1, "und", 0.0)]


def test_languages_of_long_texts_and_many_languages(spark):
    rng = random.Random(6)
    letters = {"aa": "aeioktl", "bb": "sbrgmpu", "cc": "zwxyqvj"}
    text = lambda k, n: " ".join("".join(rng.choices(letters[k], k=5)) for _ in range(n))
    rows = [(n, text(k, 20), k) for n, k in enumerate(["aa", "bb"] * 20)] + [(100 + n, text("cc", 200 + n), "cc") for n in range(5)] + [(200, text("aa", 300), "aa"), (201, "", "dd"), (202, None, "ee")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert {"aa", "bb", "cc"} <= set(model.languages) and "ee" not in model.languages
    found = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, model).collect()}
    assert all(found[i] == k for i, x, k in rows if x)
    many = [(n, f"{chr(97 + n % 26) * 3}{chr(97 + n // 26) * 3} word", f"l{n}") for n in range(90)]
    assert len(language.fit(spark.createDataFrame(many, "doc_id long, text string, lang string"), rounds=1, chain_rounds=1).languages) == 90


def test_quality(spark):
    docs, labels = table(spark, "documents", "/root/testdata/sf0.1"), table(spark, "labels", "/root/testdata/sf0.1")
    model = quality.fit(docs)
    assert all(a > 0.6 for a in model.labels.accuracies().values())
    found = quality.judge(docs, model).join(labels, "doc_id").toPandas()
    assert auc(found.score.to_numpy(), found.quality.to_numpy()) > 0.95
    assert found.good[found.quality == 1].mean() > 0.99
    assert (1 - found.good[found.quality == 0]).mean() > 0.6


def synthetic_votes(n, seed, accuracy=(0.95, 0.6, 0.8, 0.85), share=0.7):
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < share
    votes = np.where((rng.random((n, len(accuracy))) < np.array(accuracy)) == truth[:, None], 1, -1).astype(np.int8)
    votes[rng.random(votes.shape) < 0.2] = quality.MISSING
    return truth, votes


def test_weak_labels_find_accuracies():
    """At production settings known accuracies are found, and the better the more data there are."""
    wanted, off = np.array([0.95, 0.6, 0.8, 0.85]), []
    for n in (2_000, 20_000, 200_000):
        each = []
        for seed in range(3):
            truth, votes = synthetic_votes(n, seed)
            patterns, counts = np.unique(votes, axis=0, return_counts=True)
            model = quality.WeakLabels(patterns, counts.astype(float))
            assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.92
            each.append(np.abs(np.array(list(model.accuracies().values())[:4]) - wanted).max())
        off.append(np.mean(each))
        assert n < 20_000 or max(each) < 0.03
    assert off[2] < off[0] and off[2] < 0.01


def test_weak_labels_equal_em_over_single_texts():
    """Patterns with counts give what plain EM gives text by text."""
    _, votes = synthetic_votes(1500, 9)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    found = quality.WeakLabels(patterns, counts.astype(float), rounds=40)
    good = []
    for v in votes.tolist():
        margin = sum(x for x in v if x != quality.MISSING)
        good.append(1 / (1 + math.exp(-(margin - 2.0 * v.count(-1)))))
    for _ in range(40):
        chances = [[[quality.PRIOR[y][k] * quality.PRIOR_TEXTS for k in range(3)] for _ in range(4)] for y in range(2)]
        for v, g in zip(votes.tolist(), good):
            for j, x in enumerate(v):
                if x != quality.MISSING:
                    chances[0][j][x + 1] += 1 - g
                    chances[1][j][x + 1] += g
        chances = [[[c / sum(row) for c in row] for row in side] for side in chances]
        share = (sum(good) + 1) / (len(good) + 2)
        good = []
        for v in votes.tolist():
            weigh = [1 - share, share]
            for j, x in enumerate(v):
                if x != quality.MISSING:
                    weigh = [weigh[y] * chances[y][j][x + 1] for y in range(2)]
            good.append(weigh[1] / sum(weigh))
    assert np.allclose(found.chances, chances) and math.isclose(found.share, share, rel_tol=1e-9)
    assert np.allclose(found.posterior(votes), good)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


class BruteKatz:
    """Katz backoff over dictionaries, with its own Good-Turing estimates."""

    def __init__(self, texts, least):
        self.order, self.least = len(least), least
        self.counts = [collections.Counter() for _ in range(self.order + 1)]
        for tokens in texts:
            self.counts[1].update((t,) for t in tokens)
            line = ["<", *tokens]
            for n in range(2, self.order + 1):
                self.counts[n].update(tuple(line[i : i + n]) for i in range(len(line) - n + 1))
        self.total, self.texts = sum(self.counts[1].values()), len(texts)
        self.d = [None, *[self.discounts(self.counts[n], least[n - 1]) for n in range(1, self.order + 1)]]
        freed = sum((1 - self.d[1][c]) * c for c in self.counts[1].values() if c <= 5)
        self.unknown = freed / self.total if freed > 0 else 1 / (self.total + 1)
        self.scale = 1 if freed > 0 else self.total / (self.total + 1)
        self.behind = collections.defaultdict(list)
        for n in range(2, self.order + 1):
            for gram, c in self.counts[n].items():
                if c >= least[n - 1]:
                    self.behind[gram[:-1]].append((gram[-1], c))
        self.known = {}

    @staticmethod
    def discounts(counts, least):
        n = collections.Counter(counts.values())
        try:
            top = 6 * n[6] / n[1]
            d = [((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) for r in range(1, 6)]
            good = all(0 < x < 1 for x in d)
        except ZeroDivisionError:
            good = False
        if not good:
            cut = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            d = [(r - cut) / r for r in range(1, 6)]
        return {r: d[r - 1] if r >= least else 0.0 for r in range(1, 6)}

    def count(self, history):
        return self.texts if history == ("<",) else self.counts[len(history)][history]

    def keep(self, n, c):
        return (self.d[n][c] if c <= 5 else 1.0) * c

    def history(self, h):
        """(factor on kept n-grams, backoff weight)"""
        if h not in self.known:
            total, n = self.count(h), len(h) + 1
            kept = sum(self.keep(n, c) for _, c in self.behind[h])
            exact = sum(c for _, c in self.behind[h] if c > 5) == total
            low = sum(self.p(h[1:], w) for w, _ in self.behind[h])
            scale, rest = (total / (total + 1), 1 / (total + 1)) if exact else (1.0, (total - kept) / total)
            self.known[h] = scale, rest / (1 - low)
            assert abs(scale * kept / total + rest - 1) < 1e-9  # so that P(. | h) sums to one if P(. | h') does
        return self.known[h]

    def p(self, h, w):
        if not h:
            c = self.counts[1][w,]
            return self.keep(1, c) / self.total * self.scale if c else self.unknown
        if not self.count(h):
            return self.p(h[1:], w)
        c, n = self.counts[len(h) + 1][(*h, w)], len(h) + 1
        scale, weight = self.history(h)
        return scale * self.keep(n, c) / self.count(h) if c >= self.least[n - 1] else weight * self.p(h[1:], w)


def brute_katz(docs, least=ngrams.LEAST):
    """(id, train, text) to (id, tokens, known, N, base, score); distributions of some histories are summed up."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    texts = [(i, train, [*WORD.findall(lower(t)), None]) for i, train, t in docs]
    model, out = BruteKatz([tokens for _, train, tokens in texts if train], least), []
    vocabulary = [w for w, in model.counts[1]]
    if vocabulary:
        for h in [(), *list(model.behind)[:: max(1, len(model.behind) // 25)]]:
            unseen = model.p(h, "a word that is not there")
            assert abs(sum(model.p(h, w) for w in vocabulary) + unseen - 1) < 1e-9
    for i, _, tokens in texts:
        line, score = ["<", *tokens], 0.0
        for at in range(1, len(line)):
            score += math.log10(model.p(tuple(line[max(0, at - model.order + 1) : at]), line[at])) if model.total else 0.0
        base = sum(math.log10((model.counts[1][w,] + 1) / (model.total + len(vocabulary) + 1)) for w in tokens)
        out.append((i, len(tokens), sum(model.counts[1][w,] > 0 for w in tokens), model.total, base, score))
    return out


def same_scores(found, wanted):
    found = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found), key=str)
    wanted = sorted(wanted, key=str)
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    assert np.allclose([r[4:] for r in found], [r[4:] for r in wanted], rtol=1e-9)


@pytest.mark.parametrize("chunk, least", [(16 << 20, (1, 1, 2)), (60_000, (1, 1, 2)), (60_000, (1, 1, 1)), (60_000, (1, 1)), (60_000, (1, 1, 2, 2))])
def test_katz_equals_brute_force(spark, monkeypatch, chunk, least):
    """Chunks and partitions change nothing, whatever the order."""
    monkeypatch.setattr(ngrams, "CHUNK_BYTES", chunk)
    docs = table(spark, "documents", "/root/testdata/sf0.001")
    rows = [(r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2, r["text"]) for r in docs.collect()]
    same_scores(ngrams.score(docs, fold("doc_id", 7) != 2, least=least).collect(), brute_katz(rows, least))


def test_katz_learns_from_documents_that_occur_twice(spark):
    """Held-out texts of which the model has a copy score far above others."""
    rng = random.Random(8)
    words = [f"w{n}" for n in range(300)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(400)]
    rows = [(n, t, 1) for n, t in enumerate(texts)] + [(1000 + n, texts[n], 1) for n in range(40)] + [(2000 + n, texts[n], 0) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train int")
    found = {r["doc_id"]: r["score"] for r in ngrams.score(docs, F.col("train") == 1).collect()}
    assert min(found[2000 + n] for n in range(40)) > max(found[2000 + n] for n in range(40, 60)) + 20


def test_katz_beats_word_frequencies(spark):
    found = entry.op9_katz(spark, FOLDER).toPandas()
    held = found[found.held_out]
    assert held.score.sum() > held.base_score.sum() and (held.score > held.base_score).mean() > 0.9


def test_katz_on_little_text(spark):
    rows = [(1, "a b a b"), (2, "A b c"), (3, None), (4, ""), (5, "unknown words only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in ((1, 1, 2), (1, 1, 1)):
        same_scores(ngrams.score(docs, F.col("doc_id") < 4, least=least).collect(), brute_katz([(i, i < 4, t) for i, t in rows], least))
    again = [(1, "x y z " * 30), (2, "x y z"), (3, "z y x")]  # histories all of whose followers are frequent
    docs = spark.createDataFrame(again, "doc_id long, text string")
    same_scores(ngrams.score(docs, F.lit(True), least=(1, 1, 1)).collect(), brute_katz([(i, True, t) for i, t in again], (1, 1, 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nobody = ngrams.score(docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in nobody)


def test_awkward_rows(spark, awkward, nothing):
    model = toxicity.fit(awkward, spark.createDataFrame([(1, 1), (9, 0), (None, 1), (2, None), (1, 0)], "doc_id long, toxic int"))
    for found, column in ((toxicity.score(awkward, model), "score"), (language.predict(awkward, language.fit(awkward)), "score"), (quality.judge(awkward, quality.fit(awkward)), "score"), (ngrams.score(awkward, F.col("doc_id") % 2 == 1), "score")):
        rows = found.collect()
        assert len(rows) == 12 and all(r[column] is not None and math.isfinite(r[column]) for r in rows)
        assert sorted((r["doc_id"] for r in rows), key=str) == sorted((r["doc_id"] for r in awkward.collect()), key=str)
    predicted = {r["doc_id"]: r["lang_pred"] for r in language.predict(awkward, language.fit(awkward)).collect()}
    assert predicted[2] == predicted[3] == predicted[4] == predicted[6] == "und"
    none = toxicity.fit(nothing, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(nothing, none).isEmpty() and toxicity.score(awkward, none).count() == 12
    assert language.predict(nothing, language.fit(nothing)).isEmpty()
    assert {r["lang_pred"] for r in language.predict(awkward, language.fit(nothing)).collect()} == {"und"}
    assert quality.judge(nothing, quality.fit(nothing)).isEmpty()
    assert ngrams.score(nothing, F.lit(True)).isEmpty()
