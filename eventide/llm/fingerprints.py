"""Document fingerprints of closed syncmers, in DataFrame operations alone.

Units are words, those of more than UNIT code points cut into pieces from their
start. A k-mer is k units in a row; it is a closed syncmer if the smallest hash
among its s-mers lies at its first or last s-mer. Whether a k-mer is chosen
depends on the k-mer alone, so an edit changes the anchors that touch it and no
others. A text is taken to stand between boundary units, so that one of a single
unit has k-mers, too; a text without units has no anchors.

An anchor is one 64-bit number: the 32-bit hash of its k-mer, then the number of
its first unit (boundaries count below 0, and are moved up by K - 1). Texts are
compared by their anchors' hashes, wherever those lie, and by places: anchors in
common at the displacement that most of them have, repeats included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Code points of a unit at most, units of a k-mer and of an s-mer: of the k-mers 2 / (K - S + 1) are anchors.
UNIT, K, S = 6, 5, 2
#: What stands before and behind a text, as hashes of units.
BEFORE, BEHIND = 7_046_029_254_386_353_131, -7_046_029_254_386_353_131
LOW = 0xFFFFFFFF


def bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once: transform over one element stands for a let-expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column) -> Column:
    """The array of anchors of a text, in its order; empty for null."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{UNIT}}}"), F.lit(0))
    hashed = F.transform(units, lambda u: F.xxhash64(u))
    edge = lambda value: F.array(*[F.lit(value)] * (K - 1))

    def smers(h: Column) -> Column:
        n = F.size(h)
        out = h
        for j in range(1, S):
            out = F.zip_with(F.slice(out, 1, n - j), F.slice(h, j + 1, n - j), lambda a, b: F.xxhash64(a, b))
        return out

    window = K - S + 1
    # the k-mer's s-mers at both edges and every S-th between them name all of its units
    naming = sorted({*range(0, window - 1, S), window - 1})

    def chosen(m: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            between = F.least(*[F.get(m, i + j) for j in range(1, window - 1)])
            least = between >= F.least(x, F.get(m, i + (window - 1)))
            name = F.xxhash64(*[F.get(m, i + j) for j in naming])
            return F.when(least, name.bitwiseAND(F.lit(~LOW)).bitwiseOR(i.cast("long")))

        return F.array_compact(F.transform(m, lambda x, i: F.when(i + window <= F.size(m), at(x, i))))

    found = lambda h: bound(smers(F.concat(edge(BEFORE), h, edge(BEHIND))), chosen)
    return bound(hashed, lambda h: F.when(F.size(h) > 0, found(h)).otherwise(F.array().cast("array<long>")))


def hashes(found: Column) -> Column:
    """The distinct 32-bit hashes of anchors."""
    return F.array_distinct(F.transform(found, lambda x: F.shiftright(x, 32)))


def as_string(found: Column) -> Column:
    """Anchors as hexadecimal numbers, hash and place."""
    return F.array_join(F.transform(found, lambda x: F.lower(F.hex(x))), ".")


def likeness(a: Column, b: Column) -> Column:
    """The larger of two Jaccard similarities of arrays of anchors: of their distinct hashes, and of the anchors in place.

    Passages may have moved by the first, and may repeat by the second. Two texts
    without anchors are alike.
    """

    def jaccard(x: Column, y: Column, shared: Column) -> Column:
        return bound(shared, lambda n: F.when(F.size(x) + F.size(y) == 0, F.lit(1.0)).otherwise(n / (F.size(x) + F.size(y) - n)))

    both = F.struct(hashes(a).alias("a"), hashes(b).alias("b"))
    distinct = bound(both, lambda h: jaccard(h["a"], h["b"], F.size(F.array_intersect(h["a"], h["b"]))))
    # either is evaluated once
    return F.array_max(F.array(distinct, jaccard(a, b, aligned(a, b)["anchors"])))


def aligned(a: Column, b: Column) -> Column:
    """Positional match of two arrays of anchors: (shift, anchors).

    ``anchors`` counts the hashes that both have at places ``shift`` apart (b's less
    a's), for the shift at which most agree, the smallest of equally good ones; (0, 0)
    where nothing agrees. Of a hash that repeats, anchors that follow each other in
    the order of place meet, if they are of different texts. One sort, no pairs.
    """
    side = lambda found, k: F.transform(found, lambda x: x.bitwiseAND(F.lit(~LOW)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(LOW)), 1)).bitwiseOR(F.lit(k)))
    place = lambda x: F.shiftright(x.bitwiseAND(F.lit(LOW)), 1).cast("int")

    def shifts(line: Column) -> Column:
        def meet(x: Column, y: Column) -> Column:
            apart = place(y) - place(x)
            same = (F.shiftright(x, 32) == F.shiftright(y, 32)) & (x.bitwiseAND(F.lit(1)) != y.bitwiseAND(F.lit(1)))
            return F.when(same, F.when(x.bitwiseAND(F.lit(1)) == 0, apart).otherwise(-apart))

        return F.sort_array(F.array_compact(F.zip_with(line, F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), meet)))

    start = F.struct(*[F.lit(0).alias(c) for c in ("now", "run", "shift", "anchors")])

    def step(s: Column, x: Column) -> Column:
        run = F.when((s["run"] > 0) & (s["now"] == x), s["run"] + 1).otherwise(F.lit(1))
        better = run > s["anchors"]
        return F.struct(x.alias("now"), run.alias("run"), F.when(better, x).otherwise(s["shift"]).alias("shift"), F.greatest(run, s["anchors"]).alias("anchors"))

    line = F.sort_array(F.concat(side(a, 0), side(b, 1)))
    return F.aggregate(bound(line, shifts), start, step, lambda s: F.struct(s["shift"].alias("shift"), s["anchors"].alias("anchors")))


#: Cells at most before crowded ones are split.
CELLS = 1 << 18
#: A crowded cell is split by so many bits of the id.
SPLIT_BITS = 4


def cell(bits: int) -> Column:
    """The first number of the block of 2 ** ``bits`` whole numbers that holds column k."""
    return F.lit(-(2**63)) if bits >= 64 else F.col("k").bitwiseAND(F.lit(-(1 << bits) if bits < 63 else -(2**63)))


def in_cells(rows: DataFrame, per_cell: int) -> DataFrame:
    """``rows`` (a column k) with their cell ``c``: blocks of numbers, ever smaller ones where k is crowded.

    At most CELLS cells at first; those of more than eight times the rows that
    they would have on average, at most an eighth of them all, are split until none
    is left or one number fills it. Only k is read for this.
    """
    low, high, n = rows.agg(F.min("k"), F.max("k"), F.count("*")).first()
    if not n:
        return rows.withColumn("c", F.col("k"))
    per_cell = max(per_cell, -(-n // CELLS))
    span = (low ^ high).bit_length() if (low < 0) == (high < 0) else 64
    bits = max(0, span - max(1, n // per_cell).bit_length())
    keys, crowded = rows.select("k").withColumn("c", cell(bits)), []
    while bits > 0:
        crowd = stored(keys.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > 8 * per_cell).select("c"), "crowded")
        if crowd.isEmpty():
            break
        bits = max(0, bits - SPLIT_BITS)
        crowded.append((crowd, bits))
        keys = keys.join(F.broadcast(crowd), "c").select("k", cell(bits).alias("c"))
    rows = rows.withColumn("c", cell(max(0, span - max(1, n // per_cell).bit_length())))
    for crowd, finer in crowded:
        rows = rows.join(F.broadcast(crowd.select("c", F.lit(True).alias("split"))), "c", "left")  # at most CELLS / 8 rows
        rows = rows.withColumn("c", F.when(F.col("split"), cell(finer)).otherwise(F.col("c"))).drop("split")
    return rows


def with_next(rows: DataFrame, id_col: str, columns: list[str], order: list[str], made: dict[str, Column] | None = None, per_cell: int = 1000) -> DataFrame:
    """Each row with ``next_<column>`` of the row after it by id; after the last comes the first.

    Ids are dealt into cells, and each cell also gets a copy of the first row of the
    next one. Rows move once, to their cell; ``made`` columns are made there, and may
    be among ``columns``. Rows of one id stand in the order of ``order``; null ids come
    first. An empty table stays empty.
    """
    keyed = rows.withColumn("k", F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))))
    named = in_cells(keyed, per_cell)
    ahead = Window.partitionBy(F.lit(0)).orderBy("c")  # one row a cell, a bounded number
    whole = ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = named.groupBy("c").agg(F.min("k").alias("first"))
    # the cell before each; the first cell's row goes to the last cell
    firsts = stored(firsts.select("first", F.coalesce(F.lag("c").over(ahead), F.max("c").over(whole)).alias("to")), "cells")
    halo = named.join(F.broadcast(firsts), F.col("k") == F.col("first")).withColumn("c", F.col("to")).withColumn("copy", F.lit(1)).drop("first", "to")
    both = named.withColumn("copy", F.lit(0)).unionByName(halo).repartition("c").withColumns(made or {})
    line = Window.partitionBy("c").orderBy("copy", "k", *order)
    found = both.select("*", *[F.lead(c).over(line).alias(f"next_{c}") for c in columns])
    return found.where("copy = 0").drop("k", "c", "copy")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, anchors): the operator itself, one row per input row, no shuffle.

    Null and empty texts, and those of white space, have no anchors; equal texts have
    equal ones; an empty table gives an empty one.
    """
    return documents.select(F.col(id_col), F.col(text_col), anchors(F.col(text_col)).alias("anchors"))


def located(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, anchor), one row per anchor, its first unit's number (below 0: a boundary) and hash; no shuffle.

    Joined with itself on the anchor it tells where texts share a passage.
    """
    found = documents.select(F.col(id_col), F.explode(anchors(F.col(text_col))).alias("a"))
    return found.select(id_col, (F.col("a").bitwiseAND(F.lit(LOW)) - (K - 1)).cast("int").alias("place"), F.shiftright("a", 32).cast("int").alias("anchor"))


def edited_likeness(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, and what they are like.

    The edited form has the last quarter of the code points (rounded down)
    replaced by the first as many, or all, of the next document's. Null texts count
    as empty; rows of one id follow each other by text; an empty table gives an empty
    one. Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # each text is taken apart once, where its row has moved to
    rows = with_next(rows, "id", ["text", "a"], ["text"], {"a": anchors(F.col("text"))})
    n = F.char_length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.left(F.col("text"), n.cast("int") - cut), F.left(F.col("next_text"), cut))
    rows = rows.select("id", n.alias("n_chars"), edited.alias("edited"), "a", F.col("next_a").alias("x"))
    rows = rows.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "a", anchors(F.col("edited")).alias("e"), "x")
    return rows.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_string(F.col("a")).alias("fingerprint"), as_string(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("x")).alias("near_next"),
    )
