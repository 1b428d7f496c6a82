"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation of a document's shingle hashes yields two signature values, its
minimum and its maximum, so half as many hash evaluations fill the bands. Two
sets of similarity s agree in a value with probability s, in a band of r values
with s^r; there are as many bands of 8 (49 for 0.85, 84 for 0.8) as make a pair at
the threshold share none with a probability below 2e-7, if their values were
independent. A permutation's minimum and maximum lean against each other in small
sets: at the threshold the probability is 4e-7 at most (unions of 7 to 20 shingles).

1. Documents with equal sets are one class, represented by the smallest id.
2. Of the representatives that share a band the smallest id is the leader. Each
   representative is confirmed against the leader with which it shares most bands;
   then against those others from which it is still apart. That is one pass over its
   set for each such leader. Most bands hold copies and end here.
3. In the bands where a member is still apart from its leader, those members are
   confirmed against each other and against the rest of the band, tile by tile: two
   blocks of bounded bytes to a task, intersection sizes of all their sets from one
   product of incidence matrices, a spanning forest of the true links leaving the
   task. Bands of the same members are looked at once. So every pair that shares a
   band is confirmed or known to be connected, and no others are compared: a chain of
   weakly alike documents costs what its bands hold, not the square of its length.
4. Components of the confirmed links, spread to the copies of step 1.

No task holds a whole band, no pairs are emitted, none is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, give_back_heap, mix, stored, text_slices, text_source
from .components import components

ROWS = 8


def bands_for(similarity: float, miss: float = 2e-7, rows: int = ROWS) -> int:
    """Bands needed so that a pair at ``similarity`` shares none with probability ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles of ``size`` words.

    A-Z are lower-cased; a text with fewer words has its whole sequence as one
    shingle; one without words, or null, has none.
    """
    words = Words(texts, lower="ascii")
    hashed = pd.util.hash_array(np.array(words.vocabulary.to_pylist(), object), categorize=False) if len(words.vocabulary) else np.zeros(0, np.uint64)
    stream, out = hashed[words.codes], []
    for a, n in zip(words.starts, words.counts):
        if n == 0:
            out.append(np.zeros(0, np.uint64))
            continue
        span = min(size, n)
        value = np.full(n - span + 1, span, np.uint64)
        for k in range(span):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + stream[a + k : a + n - span + 1 + k])
        out.append(np.unique(value))
    return out


def multipliers(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(values: np.ndarray, odd: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """The 64-bit key of each band of a set's min-max signature."""
    low, high = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(odd), np.uint64)
    for part in range(0, len(values), 256):
        x = values[None, part : part + 256] * odd[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    signature = np.stack([low, high], 1).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, k])
    return key.astype(np.int64)


def sketches(documents: DataFrame, id_col: str, text_col: str, size: int, bands: int, seed: int = 11) -> DataFrame:
    """(id, n_shingles, set_key, bands): one row per document; no shuffle.

    ``set_key`` is a 128-bit digest of the whole set; ``bands`` is null for an
    empty set.
    """
    odd = multipliers(bands * ROWS // 2, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = shingle_sets(part.column("text"), size)
            known: dict[bytes, np.ndarray] = {}
            digests, keys = [], []
            for s in sets:
                digest = int(mix(s).sum(dtype=np.uint64)).to_bytes(8, "big") + int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)).to_bytes(8, "big")
                if digest not in known:
                    known[digest] = band_keys(s, odd, bands) if len(s) else None
                digests.append(digest)
                keys.append(known[digest])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n_shingles", "set_key", "bands"])

    source = text_source(documents, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "id long, n_shingles long, set_key binary, bands array<long>")


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int, cross: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among some sets.

    A link: 100 * intersection >= percent * union. ``cross`` gives each set's
    side; if given, only pairs of different sides are looked at.
    """
    m = len(sets)
    if m < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, (values, code) = np.repeat(np.arange(m), sizes), np.unique(np.concatenate(sets), return_inverse=True)
    times = np.bincount(code, minlength=len(values))
    shared = times > 1  # the others add nothing to an intersection
    column = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], column[code[keep]]
    common = np.zeros((m, m), np.float32)  # whole numbers below 2**24: exact
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = 4096
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(code, [at, at + width])
        dense = np.zeros((m, width), np.float32)
        dense[owner[a:b], code[a:b] - at] = 1
        common += dense @ dense.T
    inter = common.astype(np.int64)
    linked = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    linked &= (sizes[:, None] > 0) & (sizes[None, :] > 0)
    if cross is not None:
        linked &= cross[:, None] != cross[None, :]
    root = list(range(m))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
            edges.append((int(ids[i]), int(ids[j])))
    return edges


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def linked_stars(stars: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between the rows (leader, piece, id, side, text) of side 1 and those of side 0 of each group."""

    def run(table: pa.Table) -> pa.Table:
        side, found = table["side"].to_numpy(), []
        heads = list(_sets(table.filter(pa.array(side == 0)), size))
        for i, s in _sets(table.filter(pa.array(side == 1)), size):
            for j, head in heads:
                if not len(s) or not len(head):
                    continue
                at = np.searchsorted(head, s)
                at[at == len(head)] = 0
                common = int((head[at] == s).sum())
                if 100 * common >= percent * (len(s) + len(head) - common):
                    found.append((j, i))
        return _edges(found)

    return stars.groupBy("leader", "piece").applyInArrow(run, "a long, b long")


def linked_tiles(tiles: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between rows (bucket, tile, id, side, text) of different sides of each tile, as spanning forests."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(_sets(table, size))
        return _edges(forest(np.array([i for i, _ in rows], np.int64), [s for _, s in rows], percent, table["side"].to_numpy()))

    return tiles.groupBy("bucket", "tile").applyInArrow(run, "a long, b long")


def _sets(table: pa.Table, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for chunk in table.combine_chunks().to_batches():
        for part in text_slices(iter([chunk])):
            yield from zip(part.column("id").to_pylist(), shingle_sets(part.column("text"), size))


def _edges(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], schema=EDGES)


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, block: int = 384, shingles: int = 1 << 18) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id, kept.

    ``component_id`` is the smallest id reachable over links (Jaccard similarity
    of the shingle sets of at least ``percent`` in a hundred); ``kept`` says that
    it is the row's own. Documents without words are linked with nothing. Rows of
    one id are one document if their texts differ; a null id is kept with a null
    component and links nothing; an empty table gives an empty one. ``block`` rows and
    ``shingles`` shingles, or one row, are the most that one side of a comparison has.
    """
    bands = bands_for(percent / 100)
    drawn = stored(sketches(documents, id_col, text_col, size, bands), "sketches")
    usable = drawn.where("id is not null and n_shingles > 0")
    classes = stored(usable.groupBy("set_key").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.max("n_shingles").alias("weight")), "classes")
    buckets = classes.select("rep", "weight", F.explode("bands").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("bucket", "leader")
    members = stored(buckets.join(leaders, "bucket").select("bucket", "rep", "weight", "leader"), "members")
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    give_back_heap(documents.sparkSession)
    pairs = stored(members.where("rep <> leader").groupBy("leader", F.col("rep").alias("id"), "weight").agg(F.count("*").alias("bands")), "pairs")
    nearest = pairs.groupBy("id").agg(F.max_by(F.struct("leader", "weight"), F.struct("bands", -F.col("leader"))).alias("p")).select("p.leader", "id", "p.weight")
    links = stored(linked_stars(with_texts(deal_stars(nearest, block, shingles), texts), size, percent), "star-links")
    give_back_heap(documents.sparkSession)
    others = still_apart(pairs, components(links)).join(nearest, ["leader", "id"], "left_anti")
    links = links.unionByName(stored(linked_stars(with_texts(deal_stars(others, block, shingles), texts), size, percent), "star-links"))
    give_back_heap(documents.sparkSession)
    tiles = deal_tiles(members, components(links), block, shingles)
    links = stored(links.unionByName(linked_tiles(with_texts(tiles, texts), size, percent)), "links")
    joined = components(links)
    reps = classes.select("set_key", "rep").join(joined.withColumnsRenamed({"node": "rep"}), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("class_id"))
    out = drawn.join(reps, "set_key", "left")
    own = F.when(F.col("id").isNull() | (F.col("n_shingles") == 0), F.col("id")).otherwise(F.coalesce("class_id", "id"))
    out = out.select("id", "n_shingles", own.alias("component_id"))
    merged = _merge_ids(out)
    return merged.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _merge_ids(rows: DataFrame) -> DataFrame:
    """Rows of one id with different texts are one document, so their classes are joined."""
    twice = rows.where("id is not null").groupBy("id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a <> b")
    pairs = rows.join(twice.select("id", "a"), "id").select("a", F.col("component_id").alias("b"))
    if pairs.isEmpty():
        return rows
    map_to = components(pairs)
    joined = rows.join(map_to.select(F.col("node").alias("component_id"), F.col("component").alias("__to")), "component_id", "left")
    return joined.select("id", "n_shingles", F.coalesce("__to", "component_id").alias("component_id"))


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows with the texts of their ids. Neither side is bounded."""
    return rows.join(texts.hint("merge"), "id")


def pieces(rows: Column, shingles: Column, block: int, most: int) -> Column:
    """In how many pieces so many rows of so many shingles are dealt: ``block`` rows and ``most`` shingles each."""
    return F.greatest(F.ceil(rows / block), F.ceil(shingles / most), F.lit(1)).cast("int")


def still_apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (leader, id, weight) that ``parts`` (node, component) does not connect."""
    one, two = (parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")) for c in ("leader", "id"))
    named = pairs.join(one, "leader", "left").join(two, "id", "left")
    return named.where(F.coalesce("leader_part", "leader") != F.coalesce("id_part", "id")).select("leader", "id", "weight")


def deal_stars(pairs: DataFrame, block: int, most: int) -> DataFrame:
    """(leader, piece, id, side) of pairs (leader, id, weight): each leader (side 0) with its ids (side 1), those of many in pieces."""
    sizes = pairs.groupBy("leader").agg(pieces(F.count("*"), F.sum("weight"), block, most).alias("pieces"))
    dealt = pairs.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("id"), "pieces").cast("int").alias("piece"), "id", F.lit(1).alias("side"))
    heads = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.col("leader").alias("id"), F.lit(0).alias("side"))
    return dealt.unionByName(heads)


def deal_tiles(members: DataFrame, parts: DataFrame, block: int, most: int) -> DataFrame:
    """(bucket, tile, id, side): the pairs of blocks in which buckets with members apart from their leader are compared.

    ``parts`` (node, component) are the components known so far.
    """
    of = parts.withColumnsRenamed({"node": "rep", "component": "part"})
    named = members.join(of, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    own = named.where("rep = leader").select("bucket", F.col("part").alias("main"))
    named = named.join(own, "bucket").withColumn("rest", (F.col("part") != F.col("main")).cast("int"))
    weigh = lambda side, what: F.sum(F.when(F.col("rest") == side, what).otherwise(0))
    key = F.xxhash64("rep")
    sizes = named.groupBy("bucket").agg(
        pieces(weigh(1, 1), weigh(1, F.col("weight")), block, most).alias("rests"), pieces(weigh(0, 1), weigh(0, F.col("weight")), block, most).alias("mains"),
        F.sum("rest").alias("apart"), F.count("*").alias("n"), F.bit_xor(key).alias("x"), F.bit_xor(F.xxhash64(key, F.lit(1))).alias("y"),
    ).where("apart > 0")
    # buckets of the same members, as far as 128 bits tell them apart, are one
    sizes = sizes.groupBy("n", "x", "y").agg(F.min_by(F.struct("bucket", "rests", "mains"), "bucket").alias("b")).select("b.*")
    named = named.join(sizes, "bucket")
    place = F.pmod(F.xxhash64("rep", F.lit(1)), F.when(F.col("rest") == 1, F.col("rests")).otherwise(F.col("mains"))).cast("int")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    tile = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    own = F.col("own")
    # blocks i <= j of those apart, and a block apart with one of the others
    of_rest = F.concat(F.transform(span("rests"), lambda j: tile(0, F.least(own, j), F.greatest(own, j))), F.transform(span("mains"), lambda j: tile(1, own, j)))
    of_main = F.transform(span("rests"), lambda i: tile(1, i, own))
    tiles = named.withColumn("own", place).select("bucket", F.col("rep").alias("id"), "rest", "own", F.explode(F.when(F.col("rest") == 1, of_rest).otherwise(of_main)).alias("tile"))
    # the sides of a tile: its blocks; within one block every row is a side of its own
    side = F.when(F.col("tile.kind") == 1, -1 - F.col("rest").cast("long")).when(F.col("tile.i") == F.col("tile.j"), F.col("id")).otherwise(-1 - own.cast("long"))
    return tiles.select("bucket", "tile", "id", side.alias("side"))
