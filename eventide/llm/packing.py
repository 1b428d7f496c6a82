"""Best-fit packing of tokenised documents by exact-complement hashing.

What fits where depends on lengths alone, and lengths are at most the capacity,
so the whole packing is planned on the histogram of lengths: a table of at most
``capacity`` rows, however many documents there are. From the longest length
down, the gap it leaves is looked up in the sums of one, two and three lengths
still available; combinations that fill the gap exactly are consumed, as often as
their availability counts allow. What has no exact complement is placed by best
fit, again all bins of a kind at once. The plan says which ranks of each length
go to which sequence, and every piece finds its place from its rank.

Ranks come from per-bucket counts: a length that very many pieces share is dealt
into buckets, so no task sorts all of it.
"""

from __future__ import annotations

import math
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, give_back, stored, text_slices, text_source

PIECE = "piece int, start long, length long, ids_crc32 long"
#: Distinct words whose ids a Python worker remembers: twice this at most.
REMEMBERED = 150_000
#: And how many it keeps between tasks.
KEPT = 150_000
#: A word of letters that stay single letters when normalised, and ASCII punctuation behind it that joins
#: none (no apostrophe). Other words are encoded whole.
PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-įıĲ-ňŊ-ſА-я]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


class WordIds:
    """The ids of words, remembered, for vocabularies in which white space ends every token.

    Words of letters alone are encoded many at a time, as one text; their last
    ids tell them apart. If those do not number the words, each is encoded alone.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        """Let go of the words that were not met lately."""
        if len(self.new) + len(self.old) > KEPT:
            self.old = {}
        if len(self.new) > KEPT:
            self.new = {}

    def find(self, words: list[str], letters: bool) -> list[bytes]:
        new, old = self.new, self.old
        fresh = []
        for w in words:
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    fresh.append(w)
        for at in range(0, len(fresh), 2048):
            self._encode(fresh[at : at + 2048], letters)
        found = [new[w] for w in words]
        if len(new) > REMEMBERED:
            self.old, self.new = new, {}
        return found

    def _encode(self, words: list[str], letters: bool) -> None:
        if letters:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                data, edges = ids.tobytes(), (ends * 4).tolist()
                self.new.update(zip(words, (data[a:b] for a, b in zip([0, *edges], edges))))
                return
        for word, got in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.new[word] = array("I", got.ids).tobytes()


_known: dict[str, WordIds] = {}


def vocabulary_ids(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, number of ids of each)."""
    if path not in _known:
        _known[path] = WordIds(path)
    known = _known[path]
    parts = pc.extract_regex(words, PLAIN)
    plain = parts.is_valid().to_numpy(zero_copy_only=False)
    core = pc.ascii_lower(parts.field("core").filter(parts.is_valid())).dictionary_encode()  # as normalising does
    tail = parts.field("tail").filter(parts.is_valid()).dictionary_encode()
    tables = [known.find(core.dictionary.to_pylist(), True), known.find(tail.dictionary.to_pylist(), False), known.find(words.filter(pa.array(~plain)).to_pylist(), False)]
    flat = np.frombuffer(b"".join(x for t in tables for x in t), "<u4")
    sizes = np.fromiter((len(x) // 4 for t in tables for x in t), np.int64, sum(map(len, tables)))
    first = np.cumsum(sizes) - sizes
    # each word is a core and a tail, or one other; its entries in the tables, -1 for none
    entry = np.full((len(words), 2), -1, np.int64)
    at = np.flatnonzero(plain)
    entry[at, 0] = core.indices.to_numpy(zero_copy_only=False)
    entry[at, 1] = len(tables[0]) + tail.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    entry[~plain, 0] = len(tables[0]) + len(tables[1]) + np.arange(len(words) - len(at))
    used = entry.ravel()
    span = np.where(used >= 0, sizes[used], 0) if len(sizes) else np.zeros(len(used), np.int64)
    begin = np.where(used >= 0, first[used], 0) if len(sizes) else span
    where = np.repeat(begin - (np.cumsum(span) - span), span) + np.arange(span.sum())
    return flat[where], span.reshape(-1, 2).sum(1)


def text_ids(path: str, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text, then ``end_id``; a null text is empty."""
    words = Words(texts, lower="")
    flat, sizes = vocabulary_ids(path, words.vocabulary)
    first = np.cumsum(sizes) - sizes
    for a, n in zip(words.starts, words.counts):
        codes = words.codes[a : a + n]
        span = sizes[codes]
        total = int(span.sum())
        ids = np.empty(total + 1, "<u4")
        ids[:total] = flat[np.repeat(first[codes] - (np.cumsum(span) - span), span) + np.arange(total)]
        ids[total] = end_id
        yield ids


def pieces(documents: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's ids in pieces of ``capacity``, the last one shorter; no shuffle.

    Columns: ``id_col``, piece (from 0), start, length, ids_crc32, and with
    ``with_ids`` the ids themselves.
    """
    source = text_source(documents, F.col(id_col), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, size=4 << 20):  # words repeat more in larger slices, and need little memory
            row, piece, start, length, digest, kept = [], [], [], [], [], []
            for i, ids in enumerate(text_ids(tokenizer, part.column("text"), end_id)):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    cut = ids[at : at + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(cut))
                    digest.append(zlib.crc32(cut.tobytes()))
                    if with_ids:
                        kept.append(cut.astype(np.int32))
            columns = [part.column(id_col).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(digest, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        if tokenizer in _known:  # a worker that waits for other tasks keeps the tokenizer, not the words
            _known[tokenizer].forget()
        give_back()

    kind = dict(source.dtypes)[id_col]
    return source.mapInArrow(run, f"`{id_col}` {kind}, {PIECE}" + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence, how many sequences) that use up the histogram."""
    left = [0] * (capacity + 1)
    for length, count in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1 and {capacity}")
        left[length] += count
    there = sum(1 << i for i, n in enumerate(left) if n)  # bit i: length i is available
    mirror = sum(1 << (capacity - i) for i, n in enumerate(left) if n)
    patterns: list[tuple[tuple[int, ...], int]] = []

    def use(lengths: tuple[int, ...]) -> None:
        nonlocal there, mirror
        times = min(left[x] // lengths.count(x) for x in lengths)
        if not times:
            return
        patterns.append((lengths, times))
        for x in lengths:
            left[x] -= times
        for x in set(lengths):
            if not left[x]:
                there &= ~(1 << x)
                mirror &= ~(1 << (capacity - x))

    def pairs(total: int, most: int) -> Iterator[tuple[int, int]]:
        """Available lengths a >= b with a + b = total and a <= most, a descending."""
        half = (total + 1) // 2
        both = there & (mirror >> (capacity - total)) & ((1 << (min(most, total - 1) + 1)) - 1)
        both >>= half
        while both:
            a = both.bit_length() - 1
            both ^= 1 << a
            yield a + half, total - a - half

    for anchor in range(capacity, 0, -1):
        gap = capacity - anchor
        if not left[anchor]:
            continue
        if gap == 0:
            use((anchor,))
            continue
        if left[gap]:
            use((anchor, gap))
        if left[anchor] and gap >= 2:
            for a, b in pairs(gap, anchor):
                use((anchor, a, b))
                if not left[anchor]:
                    break
        if left[anchor] and gap >= 3:
            for a in range(min(gap - 2, anchor), (gap + 2) // 3 - 1, -1):
                if not left[a]:
                    continue
                for b, c in pairs(gap - a, a):
                    use((anchor, a, b, c))
                    if not left[anchor] or not left[a]:
                        break
                if not left[anchor]:
                    break
    patterns += best_fit([(x, left[x]) for x in range(capacity, 0, -1) if left[x]], capacity)
    return patterns


def best_fit(counts: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over (length, count), lengths falling, equal bins kept together."""
    rooms: list[int] = []  # free space of open bins, ascending, each once
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(free: int, pattern: tuple[int, ...], times: int) -> None:
        if free not in bins:
            bins[free] = []
            rooms.insert(bisect_left(rooms, free), free)
        bins[free].append((pattern, times))

    for length, count in counts:
        while count:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if count >= each:
                    put(capacity - each * length, (length,) * each, count // each)
                if count % each:
                    put(capacity - (count % each) * length, (length,) * (count % each), 1)
                break
            free = rooms[at]
            pattern, times = bins[free].pop()
            if not bins[free]:
                del bins[free], rooms[at]
            used = min(times, count)
            put(free - length, (*pattern, length), used)
            if times > used:
                put(free, pattern, times - used)
            count -= used
    return [x for group in bins.values() for x in group]


class Places:
    """Where the piece of a given rank among those of its length goes."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        rows, taken, base = [], {}, 0
        for lengths, times in patterns:
            offset = 0
            for x in lengths:
                rank = taken.get(x, 0)
                rows.append((x, rank, base, offset))
                taken[x] = rank + times
                offset += x
            base += times
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.key, self.first, self.base, self.offset = table[:, 0] << 44 | table[:, 1], table[:, 1], table[:, 2], table[:, 3]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 44 | rank, side="right") - 1
        return self.base[at] + rank - self.first[at], self.offset[at]


def pack(cut: DataFrame, capacity: int = 4096, per_bucket: int = 250) -> DataFrame:
    """The rows of ``cut`` (a column ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Every row is placed once; sequences are gapless from 0; sequence ids count
    from 0. Repeated rows are separate pieces, numbered when ``cut`` is stored, so that
    they spread over buckets, too. Rows whose id is null are packed like others; an
    empty table packs to an empty one. A null length, or one out of range, is an error.
    """
    spark, columns = cut.sparkSession, cut.columns
    cut = stored(cut.withColumn("__number", F.monotonically_increasing_id()), "pieces")
    counted = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    places = spark.sparkContext.broadcast(Places(plan(counted, capacity)))
    share = max(per_bucket, math.isqrt(sum(counted.values())))
    dealing = spark.createDataFrame([(int(x), int(-(-n // share))) for x, n in counted.items()], "length long, __buckets int")
    rows = cut.join(F.broadcast(dealing), "length")
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__number"), "__buckets")).select(*columns, "__number", "__bucket")
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("length", "__bucket").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inner = Window.partitionBy("length", "__bucket").orderBy("__number")
    ranked = rows.withColumn("__rank", F.row_number().over(inner)).join(offsets.select("length", "__bucket", "__before"), ["length", "__bucket"])
    ranked = ranked.select(*columns, (F.col("__rank") + F.col("__before") - 1).alias("__rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sequence, offset = places.value.find(part.column("length").to_numpy(), part.column("__rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(run, ranked.drop("__rank").schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: one row per piece, with its sequence and place.

    Texts are tokenised once; the pieces' lengths and digests, not their ids, are
    stored and shuffled. A null or empty text is one piece, the end alone; a text of any
    length is cut; rows that repeat are packed each.
    """
    return pack(pieces(documents, tokenizer, capacity, end_id, id_col, text_col), capacity)
