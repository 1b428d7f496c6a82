"""Mixing sources to target weights by Pareto order sampling.

Every source has a weight and a target of words. A target of t times the
source's words gives each document floor(t) certain copies; the rest of the
target is sampled. A document's inclusion probability p falls slowly with its
size, so that a few giants do not decide a source's share, and its rank is the
Pareto one, random odds over inclusion odds:

    q = (u / (1 - u)) / (p / (1 - p)),   u from a digest of its id

The documents of smallest q that fit the rest of the target are taken, then one
more, the document whose size comes nearest to what is still missing. u is
derived from the id, so reruns agree.

Within a source, documents are dealt into bins by q; sums per bin come first, and
only then do the rows of a bin find their place, so no task sorts a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: How fast inclusion probability falls with size: p is proportional to size ** -TILT.
TILT = 0.25
#: No document is taken more often than this.
COPIES = 3


def word_count(column: str = "text"):
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), copies: int = COPIES) -> DataFrame:
    """(source, sid, source_size, n_docs, target) of each source from (source, source_size, n_docs).

    Sources in code point order, null last, get ``weights``, repeating. Targets
    share the sum of all sizes by weight; a target stops at ``copies`` times its
    source's size, and the excess is shared by weight among the others, until none
    is above. Solved at once: sources fill up in the order of size over weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("sid", F.row_number().over(order))
    named = named.withColumn("weight", F.element_at(kinds, F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1))
    named = named.withColumn("fills_at", copies * F.col("source_size") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    upto = Window.partitionBy(F.lit(0)).orderBy("fills_at", "sid")
    # with the sources before this one full, the level per unit of weight of the others
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(copies * F.col("source_size")).over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    named = named.withColumn("level", level).withColumn("full", F.col("fills_at") <= F.col("level"))
    final = F.min(F.when(~F.col("full"), F.struct("fills_at", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), copies * F.col("source_size").cast("double")).otherwise(F.col("weight") * final)
    return named.select("source", "sid", "source_size", "n_docs", target.alias("target"))


def random_unit(column, salt: str):
    """A number in (0, 1) from the md5 digest of a value: 52 bits, the same in every engine and run."""
    text = F.concat(F.lit(salt), F.coalesce(column.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), copies: int = COPIES, tilt: float = TILT, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", salt: str = "mix-1:", per_bin: int = 500) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of each document.

    ``copies`` says how often the mix holds the document, ``taken`` is copies times
    size, at most ``copies`` times its size. Documents without words are never
    taken. Sources without words have target 0. Rows that repeat an id are separate
    documents with one u each: ties in rank are broken by size and a counter within
    the bin.
    """
    rows = stored(documents.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.sum(F.pow(F.greatest("size", F.lit(1)).cast("double"), F.lit(1 - tilt)) * (F.col("size") > 0).cast("double")).alias("tilted"))
    known = targets(sources.select("source", "source_size", "n_docs"), weights, copies).join(sources.select(F.col("source").alias("__s"), "tilted"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    known = known.withColumn("certain", F.least(F.floor(ratio + 1e-12), F.lit(copies)).cast("int"))
    known = known.withColumn("rest", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
    # p = scale * size ** -tilt has the rest as its expected words
    known = known.withColumn("scale", F.when(F.col("tilted") > 0, F.col("rest") / F.col("tilted")).otherwise(F.lit(0.0)))
    known = stored(known.withColumn("bins", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / per_bin)).cast("int")).drop("tilted"), "targets")
    joined = rows.join(known.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    u = random_unit(F.col("id"), salt)
    p = F.least(F.greatest(F.col("scale") * F.pow(F.greatest("size", F.lit(1)).cast("double"), F.lit(-tilt)), F.lit(1e-9)), F.lit(1 - 1e-9))
    joined = joined.withColumn("q", (u / (1 - u)) / (p / (1 - p)))
    # against the odds of the source's mean size q is spread like u: bins of like size
    middle = F.least(F.greatest(F.col("scale") * F.pow(F.greatest(F.col("source_size") / F.col("n_docs"), F.lit(1.0)), F.lit(-tilt)), F.lit(1e-9)), F.lit(1 - 1e-9))
    spread = F.col("q") * middle / (1 - middle)
    joined = joined.withColumn("bin", F.when(F.col("size") == 0, F.lit(-1) - F.pmod(F.xxhash64("id"), F.col("bins")).cast("int")).otherwise(F.least(F.floor(spread / (1 + spread) * F.col("bins")), F.col("bins") - 1).cast("int")))
    inner = Window.partitionBy("sid", "bin").orderBy("q", "size", "id")
    sums = joined.groupBy("sid", "bin").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("sid").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bin", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("before"))
    placed = joined.withColumn("within", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(inner))
    placed = placed.join(sums, ["sid", "bin"])
    drawn = (F.col("size") > 0) & (F.col("before") + F.col("within") <= F.col("rest"))
    placed = stored(placed.select("id", "source", "sid", "size", "source_size", "target", "certain", "rest", "bin", "nth", drawn.alias("drawn")), "ranked")
    # one closing document for each source
    missing = placed.groupBy("sid").agg((F.max("rest") - F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(F.lit(0)))).alias("gap"))
    off = F.abs(F.col("gap") - F.col("size"))
    able = placed.where(~F.col("drawn") & (F.col("size") > 0)).join(missing, "sid").where(off < F.col("gap"))
    last = able.groupBy("sid").agg(F.min(F.struct(off.alias("off"), "id", "bin", "nth")).alias("pick"))
    last = last.select("sid", "pick.bin", "pick.nth", F.lit(1).alias("closing"))
    out = placed.join(last, ["sid", "bin", "nth"], "left")
    extra = (F.col("drawn") | F.col("closing").isNotNull()).cast("int")
    count = F.when(F.col("size") > 0, F.col("certain") + extra).otherwise(F.lit(0))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", count.alias("copies"), (count * F.col("size")).alias("taken"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of the mix: every document as often as ``mix`` takes it, with its columns unchanged.

    Documents without words, which ``mix`` never takes, are left out. Ids must be
    unique for copies to be counted by row; rows that repeat an id get the largest
    count among them.
    """
    counts = mix(documents, weights, id_col=id_col, **options).where("copies > 0").groupBy(F.col(id_col).alias("__id")).agg(F.max("copies").alias("__copies"))
    rows = documents.join(counts, F.col(id_col).eqNullSafe(F.col("__id")))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*documents.columns)
