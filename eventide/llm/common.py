"""Pieces shared by the operators: folds, word tables, shared-folder tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker takes apart at a time.
SLICE_BYTES = 2 << 20
#: Distinct words whose n-grams are made at a time.
WORDS_AT_ONCE = 8192

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_local: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def fold(column: str, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset: one below the warehouse, which a cluster shares, or on one
    machine (a local master) a temporary one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local["):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/eventide-shared"
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="eventide-shared-"))
        atexit.register(shutil.rmtree, _local[0], True)
    return f"file://{_local[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete_all)
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts lineage so that a lost executor costs one task of the reader, not the
    job that made the table.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(df: DataFrame) -> None:
    """Let Spark's cleaner remove shuffle files of queries that are over, once their results are stored.

    The cleaner goes by the driver's garbage collector, which may not run for half an
    hour, and sees what listeners have let go of: they get a moment.
    """
    gc.collect()
    time.sleep(1)
    df.sparkSession.sparkContext._jvm.System.gc()
    time.sleep(1)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _delete_all() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # the session has ended; nothing is left to ask
            return


def text_source(documents: DataFrame, *columns) -> DataFrame:
    """``documents.select(*columns)`` for a Python function over texts.

    Arrow batches go by bytes, not by 10,000 rows: 8 MB at most (or one row), where
    the session has Spark's default of 64 MB.
    """
    conf = documents.sparkSession.conf
    if conf.get(BATCH_BYTES, None) in ("67108864b", "64MB", "64m"):
        conf.set(BATCH_BYTES, "8m")
    return documents.select(*columns)


def give_back() -> None:
    """Return memory that allocators keep to the system: a worker lives on through many tasks and operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        return


def give_back_heap(spark: SparkSession) -> None:
    """Have every executor collect its garbage and return the heap it has grown but does not hold.

    A JVM keeps the largest heap that it ever needed until a full collection, beside
    the Python workers of whatever runs next. One task to a core asks for it, and again
    once buffers that the first collection has let go of are free; results do not depend on it.
    """
    cores = spark.sparkContext.defaultParallelism
    asked = spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")))
    for _ in range(2):
        asked.write.format("noop").mode("overwrite").save()


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``size`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // size
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(a, b - a)
    give_back()


class Words:
    """The white-space separated words of some texts, as codes into a dictionary.

    ``codes`` holds all words in order, ``starts``/``counts`` each text's share,
    ``vocabulary`` the distinct words.
    """

    def __init__(self, texts: pa.Array, lower: str = "utf8"):
        texts = texts.cast(pa.large_string()).fill_null("")
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy()
        words = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        row = np.repeat(np.arange(len(lists)), np.diff(offsets))
        keep = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0 if len(words) else np.zeros(0, bool)
        if not keep.all():  # the splitter leaves empty words at the ends
            words, row = words.filter(pa.array(keep)), row[keep]
        coded = words.cast(pa.large_string()).dictionary_encode()
        self.codes, self.vocabulary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        if lower:  # of distinct words only
            lowered = (pc.utf8_lower if lower == "utf8" else pc.ascii_lower)(self.vocabulary).dictionary_encode()
            self.codes = lowered.indices.to_numpy(zero_copy_only=False)[self.codes] if len(self.codes) else self.codes
            self.vocabulary = lowered.dictionary
        self.counts = np.bincount(row, minlength=len(lists)).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]) if len(lists) else np.zeros(0, np.int64)

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """For each text, the sum of its words' values (float64)."""
        total = np.concatenate([[0.0], np.cumsum(per_word[self.codes], dtype=np.float64)])
        return total[self.starts + self.counts] - total[self.starts]


def ngram_table(words: pa.Array, sizes: tuple[int, ...], buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of ``<word>``, and the whole word if asked for.

    Returns (word index, bucket) as 32-bit integers, sorted by word. Equal n-grams
    of one size have equal buckets, in every process. Words are taken some at a
    time, as the steps need far more memory than their result.
    """
    parts = [_ngrams(words.slice(at, WORDS_AT_ONCE).to_pylist(), sizes, buckets, whole) for at in range(0, len(words), WORDS_AT_ONCE)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    owners = [owner + np.int32(k * WORDS_AT_ONCE) for k, (owner, _) in enumerate(parts)]
    return np.concatenate(owners), np.concatenate([bucket for _, bucket in parts])


def gram_sums(words: pa.Array, sizes: tuple[int, ...], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the n-grams' rows of ``weights`` for each word, number of n-grams of each word)."""
    sums, counts = np.zeros((len(words), weights.shape[1])), np.zeros(len(words), np.int64)
    for at in range(0, len(words), WORDS_AT_ONCE):
        strings = words.slice(at, WORDS_AT_ONCE).to_pylist()
        owner, bucket = _ngrams(strings, sizes, len(weights), True)
        for k in range(weights.shape[1]):
            sums[at : at + len(strings), k] = np.bincount(owner, weights[bucket, k], len(strings))
        counts[at : at + len(strings)] = np.bincount(owner, minlength=len(strings))
    return sums, counts


def _ngrams(strings: list[str], sizes: tuple[int, ...], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(f"<{w}>" for w in strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings)) + 2
    owner = np.repeat(np.arange(len(strings)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # code points to the word's end
    rolled, owners, found = np.zeros(len(points), np.uint64), [], []
    for n in range(1, max(sizes) + 1):
        reach = len(points) - n + 1
        if reach <= 0:
            break
        rolled = rolled[:reach] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        if n in sizes:
            ok = left[:reach] >= n
            owners.append(owner[:reach][ok])
            found.append(mix(rolled[ok] + np.uint64(n)) % np.uint64(buckets))
    if whole:
        base = np.uint64(0x9E3779B97F4A7C15) ** (np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.uint64)
        total = np.add.reduceat(points * base, np.cumsum(lengths) - lengths)
        owners.append(np.arange(len(strings)))
        found.append(mix(total) % np.uint64(buckets))
    owner, bucket = np.concatenate(owners).astype(np.int32), np.concatenate(found).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def letters_only(words: pa.Array) -> pa.Array:
    """Each word without what is no letter."""
    return pc.replace_substring_regex(words, r"[^\p{L}]+", "")


def key_hash(key: str) -> Column:
    """What samples are ordered by: a hash of the key's text, the same on every run."""
    return F.xxhash64(F.col(key).cast("string"))


def likely(wanted: Column, total: Column) -> Column:
    """Below which hash more than ``wanted`` of ``total`` keys are all but sure to lie (6 standard deviations)."""
    share = (wanted + 6 * F.sqrt(wanted) + 20) / F.greatest(total, F.lit(1))
    return F.when(share >= 1, F.lit(2**63 - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long"))


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``key``: the same on every run.

    Rows are counted first, and a bound on the hash leaves little more than ``rows``
    of them before any row moves, however many tasks there are.
    """
    bound = df.sparkSession.range(1).select(likely(F.lit(float(rows)), F.lit(df.count())).alias("b")).first()["b"]
    return df.where(key_hash(key) <= bound).orderBy(key_hash(key), F.col(key)).limit(rows)
