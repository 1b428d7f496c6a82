"""Closed syncmers against a plain Python version of every returned column."""

import collections
import hashlib
import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from eventide.llm import fingerprints as fp

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chain(*values):
    """Spark's xxhash64 of longs."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return signed(seed)


def brute_anchors(text):
    """[(hash, place)] of closed syncmers."""
    units = re.findall(r"[^\x20\x09-\x0D]{1,%d}" % fp.UNIT, text or "")
    if not units:
        return []
    line = [fp.BEFORE] * (fp.K - 1) + [signed(xxhash.xxh64_intdigest(u.encode(), 42)) for u in units] + [fp.BEHIND] * (fp.K - 1)
    out = []
    for i in range(len(line) - fp.K + 1):
        kmer = line[i : i + fp.K]
        smers = [chain(*kmer[j : j + fp.S]) for j in range(fp.K - fp.S + 1)]
        if min(smers) in (smers[0], smers[-1]):
            out.append(((chain(smers[0], smers[2], smers[3]) & (2**64 - 1)) >> 32, i))
    return out


def brute_aligned(a, b):
    by_hash = collections.defaultdict(list)
    for side, found in enumerate((a, b)):
        for h, place in found:
            by_hash[h].append((place, side))
    shifts = collections.Counter()
    for places in by_hash.values():
        places.sort()
        for (p, x), (q, y) in zip(places, places[1:]):
            if x != y:
                shifts[q - p if x == 0 else p - q] += 1
    return max(((n, -s) for s, n in shifts.items()), default=(0, 0))


def brute_likeness(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    in_place = brute_aligned(a, b)[0]
    if not a and not b:
        return 1.0
    return max(len(x & y) / len(x | y) if x | y else 1.0, in_place / (len(a) + len(b) - in_place))


def brute(rows):
    """rows (id, text), to the query's rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for n, (i, text) in enumerate(rows):
        own, after = text or "", rows[(n + 1) % len(rows)][1] or ""
        cut = len(own) // 4
        edited = own[: len(own) - cut] + after[:cut]
        a, e, x = brute_anchors(own), brute_anchors(edited), brute_anchors(after)
        line = lambda found: ".".join(f"{h << 32 | p:x}".upper().lower() for h, p in found)
        out.append((i, len(own), hashlib.sha256(edited.encode()).hexdigest(), line(a), line(e), brute_likeness(a, e), brute_likeness(a, x)))
    return out


def same(found, wanted):
    found = sorted((tuple(r[c] for c in COLUMNS) for r in found), key=str)
    wanted = sorted(wanted, key=str)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    for a, b in zip(found, wanted):
        assert a[5:] == pytest.approx(b[5:], abs=1e-12), a[0]


def test_every_column_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(100_000, None), (100_001, ""), (100_002, "abc"), (100_003, "abcdefgh\U0001f600\U0001f600"), (10**14, "far away from all the other ids"), (-7, " \t "), (-(2**63) + 1, "least"), (2**63 - 1, "most of all")]
    rows += [(200_000, "the same line again\n" * 50), (200_001, "one two three " * 40 + "four five six " * 3), (None, "no id"), (100_002, "abc")]
    random.Random(3).shuffle(rows)
    same(fp.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect(), brute(rows))


def words(chance, n, low, high):
    text = ""
    while len(text) < n:
        text += "".join(chance.choices("abcdefghijklmnopqrstuvwxyz", k=chance.randint(low, high))) + " "
    return text[: n - 1] + "."


def test_edited_texts_stay_alike_at_every_size(spark):
    """Three quarters stay, the rest goes or comes from another text; no size or kind of text is a switch."""
    chance = random.Random(5)
    texts = [words(chance, n, 2, 9) for n in [*range(100, 420, 5), *range(560, 840, 5), 3000]]
    texts += [words(chance, 900, low, low) + words(chance, 300, high, high) for low, high in [(10, 6), (6, 10), (12, 5), (44, 25), (25, 44), (60, 14), (14, 60)]]
    texts += ["".join(chance.choices("abcdefghij", k=900)) + words(chance, 300, 3, 7)]  # one word, then a quarter of short ones
    texts += ["".join(chance.choices("abcdefghij", k=820)) + " " + words(chance, 289, 1, 2), "a line that repeats\n" * 60 + words(chance, 300, 2, 9)]
    for gap in (["", "tail"], [words(chance, 2000, 2, 9), words(chance, 700, 2, 9)]):
        rows = [(2 * n, text) for n, text in enumerate(texts)] + [(2 * n + 1, gap[n % 2]) for n in range(len(texts))]
        found = {r["doc_id"]: r["near_edited"] for r in fp.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert min(found[2 * n] for n in range(len(texts)) if len(texts[n]) >= 250) > 0.4
        assert min(found[2 * n] for n in range(len(texts))) > 0.2


def test_anchors_depend_on_their_kmer_alone(spark):
    text = " ".join(f"w{i % 83}" for i in range(900))
    df = spark.createDataFrame([(1, text), (2, text), (3, "other " + text), (4, text + " more")], "doc_id long, text string")
    found = {r["doc_id"]: [(a >> 32, a & fp.LOW) for a in r["anchors"]] for r in fp.fingerprints(df).collect()}
    assert found[1] == found[2]
    inner = [x for x in found[1] if fp.K <= x[1] < 890]
    assert set(inner) <= set(found[4]) and {(h, p + 1) for h, p in inner} <= set(found[3])


def test_main_path_is_native_and_takes_texts_apart_once(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    plan = fp.edited_likeness(df)._jdf.queryExecution()
    assert not re.search("Python|Pandas|Arrow", plan.executedPlan().toString())
    assert plan.optimizedPlan().toString().count("regexp_extract_all") == 2  # the text and its edited form


def test_places_of_shared_passages(spark):
    passage, front = " ".join(f"w{i}" for i in range(300)), " ".join(f"x{i}" for i in range(57))
    df = spark.createDataFrame([(1, passage), (2, f"{front} {passage}"), (5, None)], "doc_id long, text string")
    rows = fp.located(df).collect()
    assert all(len([r for r in rows if r["doc_id"] == f["doc_id"]]) == len(f["anchors"]) for f in fp.fingerprints(df).collect())
    own = {i: {r["anchor"]: r["place"] for r in rows if r["doc_id"] == i} for i in (1, 2)}
    assert {own[2][x] - own[1][x] for x in own[1] if x in own[2]} == {57} and len(own[1].keys() & own[2].keys()) > 100
    a, b = (fp.anchors(F.lit(t)) for t in (passage, f"{front} {passage}"))
    for x, y, shift in ((a, b, 57), (b, a, -57)):
        found = spark.range(1).select(fp.aligned(x, y).alias("m")).first()["m"]
        assert found["shift"] == shift and found["anchors"] > 100
    assert tuple(spark.range(1).select(fp.aligned(a, fp.anchors(F.lit(front))).alias("m")).first()["m"]) == (0, 0)


def test_density_of_anchors(spark):
    text = " ".join(f"w{i}" for i in range(20_000))
    found = fp.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["anchors"]
    assert abs(len(found) / 20_000 - 2 / 4) < 0.015  # two edges of the four s-mers of two units in five


def test_next_rows_of_crowded_and_sparse_ids(spark):
    ids = [*range(3000), *(10**15 + i * 10**10 for i in range(500)), -5, 2**63 - 1, *range(2**40, 2**40 + 700)]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r["next_text"] for r in fp.with_next(df, "doc_id", ["text"], ["text"], per_cell=10).collect()}
    cells = {r["c"]: r["count"] for r in fp.in_cells(df.withColumn("k", F.col("doc_id")), 10).groupBy("c").count().collect()}
    assert max(cells.values()) <= 80
    ids.sort()
    assert found == {a: str(b) for a, b in zip(ids, [*ids[1:], ids[0]])}
