"""Language-model scores by a Katz backoff model.

Counts are discounted by Good-Turing estimates, and what that sets free goes to
unseen words by backoff weights that make every distribution sum to exactly one,
the class of unknown words included. With h' for a history h without its first
word:

    P(w)     = d(c(w)) c(w) / N,           the rest to an unknown word
    P(w | h) = d(c(h w)) c(h w) / c(h)     if the n-gram is kept
             = a(h) P(w | h')              otherwise
    a(h)     = (1 - sum of kept P(w | h)) / (1 - sum of P(w | h') over the same w)

evaluated for every token from its longest history down to the word. As Katz
proposes, n-grams of the highest order that occur once are not kept: they hold
most of the table and, having a history that is rare itself, next to none of its
worth. Their counts still count: what they had goes to the backoff.

Tables of counts and of backoff weights are partitioned by hash. Texts become
chunks of integer codes, once, in a table bucketed by chunk. For each order a
chunk sends every partition the n-grams it holds, distinct and sorted by hash, in
one packed row with its own counts; the partition adds all chunks up, keeps its
part of the table and answers each chunk in the order asked. One chunk of those
that hold an n-gram is named its owner and alone adds it to its history's sums,
which travel, added up within the chunk, in the same way. So nothing is sent twice
by a chunk, however frequent: no word, n-gram or history is a hot spot. An n-gram
is asked for only if both n-grams one word shorter within it are frequent enough
for it to be kept.

Words are told apart by 64 bits of hash, longer n-grams by 48.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, drop_shuffles, give_back, mix, stored, text_slices, text_source

#: Counts up to this are discounted.
K = 5
END, START = np.uint64(0x1B873593CC9E2D51), np.uint64(0xE6546B64A5A5C3D7)
CHUNK_BYTES = 14 << 20
#: n-grams of order 1, 2, ... are kept from this count on (1 or 2).
LEAST = (1, 1, 2)

CHUNK = "chunk long, ids binary, train binary, sizes binary, vocabulary binary, ranking binary, codes binary, texts long, totals array<long>"
CHUNK_SCHEMA = pa.schema([("chunk", pa.int64()), *[(c, pa.binary()) for c in ("ids", "train", "sizes", "vocabulary", "ranking", "codes")], ("texts", pa.int64()), ("totals", pa.list_(pa.int64()))])
#: kind "c": counts of n-grams of this order; "h": sums of histories of n-grams of this order.
ASK = "kind string, level int, part int, chunk long, keys binary, a binary, b binary, c binary"
ASK_SCHEMA = pa.schema([("kind", pa.string()), ("level", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), *[(c, pa.binary()) for c in ("keys", "a", "b", "c")]])
#: Answers to a chunk, and (chunk null) the partition's part of a table, with numbers to be summed.
ANSWER = "kind string, level int, part int, chunk long, x binary, y binary, sums array<long>"
ANSWER_SCHEMA = pa.schema([("kind", pa.string()), ("level", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("sums", pa.list_(pa.int64()))])
SCORES = "row long, train boolean, n_tokens long, n_known long, base_score double, score double"


def packed(values: np.ndarray, dtype: str) -> bytes:
    """Values compressed byte by byte of their width; whole numbers in the narrowest width that holds them, said by the first byte."""
    values = values.astype(dtype)
    if dtype[1] == "u" and values.size:
        values = values.astype(f"<u{_width(int(values.max()))}")
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T
    return bytes([width]) + _zip.compress(np.ascontiguousarray(planes))


def unpacked(data: bytes, dtype: str) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(_unzip.decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<{dtype[-2]}{width}").ravel().astype(dtype, copy=False)


def _width(most: int) -> int:
    return 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8


#: A context each would cost more than many of the small arrays.
_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def steps(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)), "<u8")


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, "<u8"), dtype=np.uint64)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys ascending, each key's number among them, where each distinct key comes first) of unsigned keys."""
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int32), np.zeros(0, np.int64)
    low = keys.min()
    bits = max(1, (n - 1).bit_length())
    if int(keys.max() - low).bit_length() + bits <= 64:  # key and place in one number: a plain sort
        line = ((keys - low) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
        line.sort()
        order = (line & np.uint64((1 << bits) - 1)).astype(np.int64)
        ranked = line >> np.uint64(bits)
        ranked += low
    else:
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(n, np.int32)
    number[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return ranked[fresh], number, order[fresh]


class Discounts:
    """Good-Turing discount factors of counts 1 to K from the counts of counts n[1], ..., n[K + 1].

    Counts below ``least`` are not kept: their factor is 0.
    """

    def __init__(self, n: np.ndarray, least: int = 1):
        n = np.asarray(n, float)
        self.least, self.factor = least, np.ones(K + 1)
        r = np.arange(1, K + 1)
        with np.errstate(all="ignore"):
            common = (K + 1) * n[K] / n[0]
            d = ((r + 1) * n[1:] / (r * n[:K]) - common) / (1 - common)
        if not (np.isfinite(d).all() and (d > 0).all() and (d < 1).all()):
            # counts of counts too few or too uneven for Good-Turing: absolute discounting
            cut = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 and n[1] > 0 else 0.5
            d = (r - cut) / r
        self.factor[1:] = np.where(r >= least, d, 0.0)
        self.factor[0] = 0.0

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """The discounted counts; 0 for those that are not kept."""
        return np.where(counts <= K, self.factor[np.minimum(counts, K)], 1.0) * counts

    def freed(self, n: np.ndarray) -> np.ndarray:
        """Counts set free by n[..., r - 1] items of count r, r = 1 ... K."""
        return n @ ((1 - self.factor[1:]) * np.arange(1, K + 1))


class Unigrams:
    """P(w) by count; count 0 is an unknown word."""

    def __init__(self, n: np.ndarray, total: int, distinct: int):
        self.discount, self.total, self.distinct = Discounts(n), total, distinct
        freed = float(self.discount.freed(np.asarray(n, float)[:K]))
        self.scale = 1.0 if freed > 0 else total / (total + 1)
        self.unknown = freed / total if freed > 0 else 1 / (total + 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discount(counts) / max(1, self.total) * self.scale, self.unknown)


def backoff(discount: Discounts, few: np.ndarray, many: np.ndarray, seen: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor on kept n-grams, backoff weight) of histories.

    ``few[:, r - 1]`` counts the kept words that follow r times, ``many`` sums the
    counts of those that follow more than K times, ``seen`` sums the shorter history's
    P over all kept words, ``total`` is the history's count. A history of which nothing
    is freed gives one count more to the unseen.
    """
    left = total - many - few @ np.arange(1, K + 1)  # of words that are not kept
    freed = left + discount.freed(few)
    none = freed <= 0
    scale = np.where(none, total / (total + 1), 1.0)
    rest = np.where(none, 1 / (total + 1), freed / np.maximum(total, 1))
    return scale, rest / np.maximum(1 - seen, 1e-300)


def make_chunk(texts: pa.Array, ids: pa.Array, train: np.ndarray, number: int, order: int) -> dict:
    """A chunk row: the texts' tokens as codes into a vocabulary sorted by hash; each text ends with END.

    ``train`` holds 1 for a text to learn from, and 2 more for a null id. The vocabulary
    holds END and START. ``totals``: n-grams of each order in texts to learn from.
    """
    unnamed = ids.is_null().to_numpy(zero_copy_only=False)
    ids, train = ids.fill_null(0).to_numpy(zero_copy_only=False), train.astype(bool)
    words = Words(texts, lower="ascii")
    hashes = pd.util.hash_array(np.array(words.vocabulary.to_pylist(), object), categorize=False) if len(words.vocabulary) else np.zeros(0, np.uint64)
    vocabulary, code = np.unique(np.concatenate([mix(hashes), [END, START]]), return_inverse=True)
    sizes = words.counts + 1
    codes = np.full(int(sizes.sum()), code[-2], np.int32)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(sizes) - 1] = False
    codes[inside] = code[:-2].astype(np.int32)[words.codes]
    del words, inside
    # codes are stored as ranks by frequency, which pack well
    ranking = np.argsort(-np.bincount(codes, minlength=len(vocabulary)), kind="stable").astype(np.int32)
    rank = np.empty(len(ranking), np.int32)
    rank[ranking] = np.arange(len(ranking), dtype=np.int32)
    learnt = sizes[train]
    totals = [int(learnt.sum()), *[int(np.maximum(learnt + 2 - n, 0).sum()) for n in range(2, order + 1)]]
    return {"chunk": number, "ids": packed(ids, "<i8"), "train": packed(train + 2 * unnamed, "u1"), "sizes": packed(sizes, "<u4"), "vocabulary": vocabulary.astype("<u8").tobytes(), "ranking": packed(ranking, "<u4"), "codes": packed(rank[codes], "<u4"), "texts": len(learnt), "totals": totals}


def chunked(rows: DataFrame, order: int) -> DataFrame:
    """Chunks of (row, train, text) rows; a task cuts its rows at CHUNK_BYTES of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            text = table["text"].combine_chunks()
            text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
            return pa.RecordBatch.from_pylist([make_chunk(text, table["row"].combine_chunks(), table["train"].to_numpy(zero_copy_only=False), number, order)], CHUNK_SCHEMA)

        for part in text_slices(batches):
            held.append(part)
            size += part.nbytes
            if size >= CHUNK_BYTES:
                yield made()
                held, size, number = [], 0, number + 1
                give_back()
        if held:
            yield made()

    return text_source(rows, "row", "train", "text").mapInArrow(run, CHUNK)


class Level:
    """The distinct n-grams of one order in a chunk, ascending by hash.

    ``at`` lists the places of the chunk's line (texts, a START before each) where one
    ends, ``code`` says which. ``prefix`` and ``suffix`` number the n-grams of the order
    below without the last and the first word, ``word`` the last word.
    """

    def __init__(self, hashes: np.ndarray, at: np.ndarray, code: np.ndarray, prefix=None, suffix=None, word=None):
        self.hashes, self.at, self.code, self.prefix, self.suffix, self.word = hashes, at, code, prefix, suffix, word
        #: What the tables answer: counts, which of them this chunk owns, backoff weights and factors as histories, and P.
        self.count, self.own, self.weight, self.scale, self.p = None, None, None, None, None


class Grams:
    """A chunk's line of tokens and its n-grams of all orders up to ``order``."""

    def __init__(self, row: dict, order: int):
        self.vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        codes = unpacked(row["ranking"], "<u4").astype(np.int32)[unpacked(row["codes"], "<u4")]
        self.sizes = unpacked(row["sizes"], "<u4").astype(np.int64)
        flags = unpacked(row["train"], "u1")
        self.train, self.unnamed = flags & 1, (flags & 2) > 0
        self.start = int(np.searchsorted(self.vocabulary, START))
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1  # the place of each text's START
        self.fresh = np.zeros(len(codes) + len(self.sizes), bool)
        self.fresh[self.first] = True
        line = np.full(len(self.fresh), self.start, np.int32)
        line[~self.fresh] = codes
        self.line, self.learnt = line, np.repeat(self.train, self.sizes + 1) > 0
        self.levels = [Level(self.vocabulary, np.arange(len(line)), line)]
        place, words = np.arange(len(line), dtype=np.int32), np.uint64(len(self.vocabulary))
        for _ in range(2, order + 1):
            below = self.levels[-1]
            code = np.full(len(line), -1, np.int32)
            code[below.at] = below.code
            at = place[1:][(code[:-1] >= 0) & ~self.fresh[1:]]
            key, number, one = numbered(code[at - 1].astype(np.uint64) * words + line[at].astype(np.uint64))
            prefix, word = (key // words).astype(np.int32), (key % words).astype(np.int32)
            del key
            hashes = mix(below.hashes[prefix] * np.uint64(0x9E3779B97F4A7C15) + self.vocabulary[word]) >> np.uint64(16)
            by_hash = np.argsort(hashes)
            back = np.empty(len(by_hash), np.int32)
            back[by_hash] = np.arange(len(by_hash), dtype=np.int32)
            suffix = code[at[one]]
            self.levels.append(Level(hashes[by_hash], at, back[number], prefix[by_hash], suffix[by_hash], word[by_hash]))

    def own_counts(self, n: int) -> np.ndarray:
        """How often each n-gram occurs in the chunk's texts to learn from; START is no token."""
        level = self.levels[n - 1]
        used = self.learnt[level.at] if n > 1 else self.learnt & ~self.fresh
        return np.bincount(level.code[used], minlength=len(level.hashes))


class Plan:
    """What the driver knows: orders, partitions, numbers of texts and n-grams, and the discounts found so far."""

    def __init__(self, least: tuple[int, ...], parts: int, texts: int, totals: list[int]):
        self.least, self.parts, self.texts, self.totals = least, parts, texts, totals
        self.words: Unigrams | None = None
        self.discounts: dict[int, Discounts] = {}

    def learn(self, n: int, sums: np.ndarray) -> None:
        """Take in the sums of all partitions: counts of counts 1 ... K + 1, then total and number of distinct."""
        of = sums[: K + 1].astype(float)
        if n == 1:
            self.words = Unigrams(of, int(sums[K + 1]), int(sums[K + 2]))
        else:
            if self.least[n - 1] > 1:  # n-grams seen once were not all asked for; they make up the rest
                of[0] = self.totals[n - 1] - (sums[K + 1] - sums[0])
            self.discounts[n] = Discounts(of, self.least[n - 1])

    def edges(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Where each partition of the hash range begins in sorted hashes, and the end."""
        bits = 64 if n == 1 else 48
        cuts = np.array([(k << bits) // self.parts for k in range(1, self.parts)], np.uint64)
        return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]]).astype(np.int64)


def wanted(grams: Grams, plan: Plan, n: int) -> np.ndarray:
    """Numbers of the n-grams of order n that a chunk asks for."""
    level = grams.levels[n - 1]
    if n <= 2:
        return np.arange(len(level.hashes))
    low, below = plan.least[n - 1], grams.levels[n - 2].count
    return np.flatnonzero((below[level.prefix] >= low) & (below[level.suffix] >= low))


def histories(grams: Grams, plan: Plan, n: int) -> np.ndarray:
    """Numbers of the n-grams of order n - 1 that may have a kept n-gram of order n behind them."""
    return np.flatnonzero(grams.levels[n - 2].count >= plan.least[n - 1])


def spread(kind: str, n: int, chunk: int, keys: np.ndarray, plan: Plan, level: int, columns) -> list[dict]:
    """One row for each partition that has keys; ``columns(a, b)`` packs what belongs to a stretch of them."""
    edges = plan.edges(keys, level)
    return [{"kind": kind, "level": n, "part": p, "chunk": chunk, "keys": steps(keys[a:b])} | columns(a, b) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def ask_counts(grams: Grams, chunk: int, plan: Plan, n: int) -> list[dict]:
    chosen = wanted(grams, plan, n)
    counts = grams.own_counts(n)[chosen]
    return spread("c", n, chunk, grams.levels[n - 1].hashes[chosen], plan, n, lambda a, b: {"a": packed(counts[a:b], "<u4")})


def ask_histories(grams: Grams, chunk: int, plan: Plan, n: int) -> list[dict]:
    """Ask for the histories' weights, with the sums over the n-grams that this chunk owns."""
    level, below = grams.levels[n - 1], grams.levels[n - 2]
    chosen = histories(grams, plan, n)
    mine = np.flatnonzero(level.own & (level.count >= plan.least[n - 1]))
    h, c, size = level.prefix[mine], level.count[mine], len(below.hashes)
    few = np.stack([np.bincount(h[c == r], minlength=size) for r in range(1, K + 1)])
    many = np.bincount(h[c > K], c[c > K], size).astype(np.int64)
    seen = np.bincount(h, below.p[level.suffix[mine]], size)[chosen]
    sums = np.concatenate([few, [many, below.count]])[:, chosen]
    gives = (few.sum(0) + many)[chosen] > 0

    def columns(a: int, b: int) -> dict:
        own = gives[a:b]
        return {"a": np.packbits(own).tobytes(), "b": packed(sums[:, a:b][:, own], "<u8"), "c": packed(seen[a:b][own], "<f8")}

    return spread("h", n, chunk, below.hashes[chosen], plan, n - 1, columns)


def answer_counts(rows: list[dict], plan: Plan) -> list[dict]:
    keys = [from_steps(r["keys"]) for r in rows]
    known, code, one = numbered(np.concatenate(keys))
    counts = np.bincount(code, np.concatenate([unpacked(r["a"], "<u4") for r in rows]), len(known)).astype(np.int64)
    reply = (counts * 2)[code]
    reply[one] += 1  # the first that asks owns it
    out, at = [], 0
    for r, own in zip(rows, keys):
        out.append({k: r[k] for k in ("kind", "level", "part", "chunk")} | {"x": packed(reply[at : at + len(own)], "<u8")})
        at += len(own)
    of = np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2]
    there = counts >= plan.least[rows[0]["level"] - 1]
    table = {"x": steps(known[there]), "y": packed(counts[there], "<u8"), "sums": [*of.tolist(), int(counts.sum()), int((counts > 0).sum())]}
    return [*out, {k: rows[0][k] for k in ("kind", "level", "part")} | table]


def answer_histories(rows: list[dict], plan: Plan) -> list[dict]:
    keys = [from_steps(r["keys"]) for r in rows]
    gives = [np.unpackbits(np.frombuffer(r["a"], np.uint8), count=len(k)) > 0 for r, k in zip(rows, keys)]
    known, code, _ = numbered(np.concatenate(keys))
    code_of = code[np.concatenate(gives)]
    sums = np.concatenate([unpacked(r["b"], "<u8").reshape(K + 2, -1) for r in rows], 1)
    few = np.stack([np.bincount(code_of, sums[k], len(known)) for k in range(K)], 1)
    many = np.bincount(code_of, sums[K], len(known))
    total = np.zeros(len(known))
    total[code_of] = sums[K + 1]
    seen = np.bincount(code_of, np.concatenate([unpacked(r["c"], "<f8") for r in rows]), len(known))
    n = rows[0]["level"]
    scale, weight = backoff(plan.discounts[n], few, many, seen, np.maximum(total, 1))
    there = total > 0
    weight[scale < 1] *= -1  # a sign for the factor, which the count gives
    out, at = [], 0
    for r, own in zip(rows, keys):
        part = code[at : at + len(own)]
        out.append({k: r[k] for k in ("kind", "level", "part", "chunk")} | {"x": np.packbits(there[part]).tobytes(), "y": packed(weight[part][there[part]], "<f8")})
        at += len(own)
    return [*out, {k: rows[0][k] for k in ("kind", "level", "part")} | {"x": steps(known[there]), "y": packed(weight[there], "<f8")}]


def answers(asked: DataFrame, plan: Plan) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        found = answer_counts(rows, plan) if rows[0]["kind"] == "c" else answer_histories(rows, plan)
        out = pa.Table.from_pylist(found, ANSWER_SCHEMA)
        del found, rows
        give_back()
        return out

    return asked.groupBy("kind", "level", "part").applyInArrow(run, ANSWER)


def take_answers(grams: Grams, replies: list[dict], plan: Plan, n: int, whole: bool) -> None:
    """Counts of orders up to n, and P of orders below, or of n as well if the answers are the ``whole``."""
    by = {}
    for r in replies:
        by.setdefault((r["kind"], r["level"]), {})[r["part"]] = r
    for k in range(1, n + 1):
        level = grams.levels[k - 1]
        given = by.get(("c", k), {})
        reply = np.zeros(len(level.hashes), np.int64)
        parts = [unpacked(given[p]["x"], "<u8") for p in sorted(given)]
        reply[wanted(grams, plan, k)] = np.concatenate(parts) if parts else 0
        level.count, level.own = reply >> 1, (reply & 1) > 0
        if k == 1:
            level.p = plan.words(level.count)
            level.count[grams.start] = plan.texts  # as a history
            continue
        if k == n and not whole:
            continue
        given, below = by.get(("h", k), {}), grams.levels[k - 2]
        chosen = histories(grams, plan, k)
        edges = plan.edges(below.hashes[chosen], k - 1)
        below.weight, below.scale = np.ones(len(below.hashes)), np.ones(len(below.hashes))
        for p in sorted(given):
            own = chosen[edges[p] : edges[p + 1]]
            own = own[np.unpackbits(np.frombuffer(given[p]["x"], np.uint8), count=len(own)) > 0]
            weight = unpacked(given[p]["y"], "<f8")
            below.weight[own] = np.abs(weight)
            below.scale[own] = np.where(weight < 0, below.count[own] / (below.count[own] + 1), 1.0)
        direct = plan.discounts[k](level.count) / np.maximum(below.count[level.prefix], 1) * below.scale[level.prefix]
        level.p = np.where(level.count >= plan.least[k - 1], direct, below.weight[level.prefix] * below.p[level.suffix])


def first_asks(chunks: DataFrame, plan: Plan) -> DataFrame:
    """Counts of words and pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row, 2)
                for n in (1, 2):
                    yield pa.RecordBatch.from_pylist(ask_counts(grams, row["chunk"], plan, n), ASK_SCHEMA)
                del grams
                give_back()

    return chunks.mapInArrow(run, ASK)


def next_asks(plan: Plan, n: int):
    """Sums of histories of order n, and counts of order n + 1, where there is one."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            more = n < len(plan.least)
            grams = Grams(row, n + more)
            take_answers(grams, right.to_pylist(), plan, n, False)
            out += ask_histories(grams, row["chunk"], plan, n)
            if more:
                out += ask_counts(grams, row["chunk"], plan, n + 1)
            del grams
        table = pa.Table.from_pylist(out, ASK_SCHEMA)
        del out
        give_back()
        return table

    return run


def score_chunk(plan: Plan):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():
            grams = Grams(row, len(plan.least))
            take_answers(grams, right.to_pylist(), plan, len(plan.least), True)
            value = np.zeros(len(grams.line))
            for level in grams.levels[1:]:  # the longest history of a token comes last
                value[level.at] = np.log10(level.p)[level.code]
            counts = grams.levels[0].count
            base = np.log10((counts + 1) / (plan.words.total + plan.words.distinct + 1))
            base[grams.start] = 0
            known = (counts > 0).astype(np.int64)
            known[grams.start] = 0
            sums = [np.add.reduceat(x, grams.first) for x in (known[grams.line], base[grams.line], value)]
            tables.append(pa.table([pa.array(unpacked(row["ids"], "<i8"), mask=grams.unnamed), pa.array(grams.train > 0), pa.array(grams.sizes), *map(pa.array, sums)], ["row", "train", "n_tokens", "n_known", "base_score", "score"]))
            del grams, value
        give_back()
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], ["row", "train", "n_tokens", "n_known", "base_score", "score"])
        return pa.concat_tables(tables) if tables else empty

    return run


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` as a table in the warehouse, bucketed by ``key``, dropped when the driver ends."""
    spark = df.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def _drop(spark, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended
        return


def score(documents: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", least: tuple[int, ...] = LEAST) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of each document.

    Learns from the documents for which ``train`` is true (null is not), n-grams of as
    many orders as ``least`` has numbers. Tokens are words, A-Z lower-cased, and one
    end for each text; null and empty texts have the end alone. Scores are sums of
    log10 probabilities of whole texts; base_score is that of add-one word
    frequencies. Rows that repeat an id are scored each, null ids stay null; an empty
    table gives an empty one.
    """
    order = len(least)
    if order < 2 or any(x not in (1, 2) for x in least) or list(least) != sorted(least):
        raise ValueError("n-grams of two orders at least, kept from counts of 1 or 2 that do not fall")
    rows = documents.select(F.col(id_col).cast("long").alias("row"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = bucketed(chunked(rows, order), "chunk")
    sums = chunks.agg(F.count("*"), F.sum("texts"), *[F.sum(F.get("totals", F.lit(n))) for n in range(order)]).first()
    plan = Plan(least, max(1, sums[0]), sums[1] or 0, [x or 0 for x in sums[2:]])
    asked, replies = first_asks(chunks, plan), None
    for n in range(2, order + 2):
        found = stored(answers(asked, plan), "katz")
        asked = pair = None  # no longer needed, nor are their shuffle files
        # the sums of the partitions' tables, added up before they reach the driver: a row for each order
        told = found.where("chunk is null and kind = 'c'").groupBy("level").agg(*[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(K + 3)]).collect()
        told = {r["level"]: np.array([r[f"s{k}"] for k in range(K + 3)], np.int64) for r in told}
        for k in (1, 2) if n == 2 else (n,) if n <= order else ():
            plan.learn(k, told.get(k, np.zeros(K + 3, np.int64)))
        drop_shuffles(found)
        new = found.where("chunk is not null")
        replies = new if replies is None else replies.unionByName(new)
        pair = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk"))
        if n <= order:
            asked = pair.applyInArrow(next_asks(plan, n), ASK)
    scored = pair.applyInArrow(score_chunk(plan), SCORES)
    return scored.select(F.col("row").alias(id_col), "train", "n_tokens", "n_known", F.lit(plan.words.total).cast("long").alias("train_tokens"), "base_score", "score")


__all__ = ["Discounts", "Unigrams", "backoff", "score"]
