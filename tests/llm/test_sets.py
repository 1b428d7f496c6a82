"""Near-duplicates, packing, mixing, archives, neighbours, fingerprints."""

import collections
import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from eventide.llm import components, entry, fingerprints, minhash, mixing, neighbours, packing, warc

SMALL, FOLDER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(3, 9), (9, 4), (7, 8), (5, 5)], []])
def test_components(spark, edges):
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(df).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert found == roots(nodes, edges)


def brute_duplicates(rows, size, percent):
    """rows (id, text); ids unique."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    sets = {}
    for i, text in rows:
        words = WORD.findall(lower(text))
        sets[i] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    inverted = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    shared = collections.Counter((a, b) for ids in inverted.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    edges = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    return {i: (len(sets[i]), c) for i, c in roots(sets, edges).items()}


def check_duplicates(spark, rows, size=3, percent=85, **options):
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size, percent=percent, **options).collect()
    wanted = brute_duplicates(rows, size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found) and len(found) == len(rows)


def varied(n, edits, seed, length=60):
    """Copies of one text with up to ``edits`` words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(length)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"n{rng.randrange(10**9)}"
        rows.append((i * 3 + 1, " ".join(words)))
    return rows


def test_duplicates_of_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check_duplicates(spark, rows)
    check_duplicates(spark, rows, 5, 80)


@pytest.mark.parametrize("edits", [1, 3, 6])
def test_groups_larger_than_a_block(spark, edits):
    """Tight groups, loose ones and ones in between, far larger than a block."""
    check_duplicates(spark, varied(160, edits, edits) + [(10_000 + i, t) for i, t in varied(30, 2, 99)], block=16)


@pytest.mark.parametrize("percent", [60, 80])
def test_loose_chains(spark, percent):
    """Each text shares most of itself with the next one only; bands hold neighbours, linked or not."""
    words = [f"w{i}" for i in range(700)]
    chain = [(n * 2 + 1, " ".join(words[n * 6 : n * 6 + 60])) for n in range(30)]
    check_duplicates(spark, chain, 3, percent, block=8, shingles=4000)


def test_chains_of_weakly_alike_documents_stay_linear(spark):
    """5,000 documents, each much like its neighbours but linked with none: compared rows grow with the chain."""
    words = [f"w{i}" for i in range(100_000)]
    compared = []
    for n in (1250, 5000):
        rows = [(k, " ".join(words[k * 14 : k * 14 + 64])) for k in range(n)]  # neighbours have similarity 0.63
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        sketches = minhash.sketches(docs, "doc_id", "text", 3, minhash.bands_for(0.85))
        buckets = sketches.select(F.col("id").alias("rep"), F.col("n_shingles").alias("weight"), F.explode("bands").alias("bucket"))
        leaders = buckets.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("bucket", "leader")
        members = buckets.join(leaders, "bucket").select("bucket", "rep", "weight", "leader").persist()
        none = spark.createDataFrame([], "node long, component long")
        pairs = members.where("rep <> leader").select("leader", F.col("rep").alias("id"), "weight").distinct()
        compared.append(minhash.deal_stars(pairs, 384, 1 << 18).count() + minhash.deal_tiles(members, none, 384, 1 << 18).count())
        members.unpersist()
    assert compared[0] > 500 and compared[1] < 5 * compared[0]


def test_ties_at_the_threshold(spark):
    # 20 shingles against 17 of them: 17 / 20 is exactly 85 in a hundred; 33 of 39 is a little less
    one = " ".join(f"a{i}" for i in range(22))
    two = " ".join(f"a{i}" for i in range(19))
    check_duplicates(spark, [(1, one), (2, two), (3, "x y"), (4, "X Y"), (5, ""), (6, None), (7, "z")])


def test_bands():
    assert (1 - 0.85**minhash.ROWS) ** minhash.bands_for(0.85) < 2e-7
    values = np.unique(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64))
    odd = minhash.multipliers(200, 11)
    keys = minhash.band_keys(values, odd, 50)
    assert np.array_equal(keys, minhash.band_keys(values, odd, 50)) and len(keys) == 50
    near = np.sort(np.concatenate([values[:490], values[490:] + np.uint64(1)]))
    assert (minhash.band_keys(near, odd, 50) == keys).sum() > 20


def test_min_max_values_estimate_similarity():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = np.unique(values[:700]), np.unique(values[200:])
    odd = minhash.multipliers(2000, 3)
    agree = (minhash.band_keys(a, odd, 4000, 1) == minhash.band_keys(b, odd, 4000, 1)).mean()
    assert abs(agree - 500 / 900) < 0.03


def test_tokens_are_the_tokenizers():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(7)
    alphabet = [*"éÀßſĲŉıя̈aBtT1².s'’ \x1c\x85İẞ<|>-_", "<|endoftext|>", "'re", "'LL", "\t", "\n", "word", "Word."]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(3000)] + ["", None, "It's 12.5 o'clock, isn't it?"]
    found = list(packing.text_ids(VOCABULARY, pa.array(texts), 1))
    for text, ids in zip(texts, found):
        assert ids.tolist() == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], text


def check_packing(rows, capacity):
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = entry.op3_packing(spark, FOLDER).collect()
    total = sum(r["length"] for r in rows)
    assert check_packing(rows, 4096) <= -(-total // 4096) * 1.01 + 1
    tokenizer = Tokenizer.from_file(VOCABULARY)
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        wanted = [(k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted((x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in by_doc[r["doc_id"]]) == wanted


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_up_what_there_is(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 50, 400])
    histogram = {x: rng.randint(1, 40) for x in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
    used = collections.Counter()
    patterns = packing.plan(histogram, capacity)
    for lengths, times in patterns:
        assert sum(lengths) <= capacity
        for x in lengths:
            used[x] += times
    assert used == histogram
    bins = sum(t for _, t in patterns)
    plain = sum(t for _, t in packing.best_fit(sorted(histogram.items(), reverse=True), capacity))
    assert bins <= plain * 1.1 + 2


def test_exact_complements_come_first():
    assert packing.plan({7: 2, 3: 2}, 10) == [((7, 3), 2)]
    assert sorted(packing.plan({6: 1, 3: 1, 1: 1}, 10)) == [((6, 3, 1), 1)]
    assert packing.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == [((4, 3, 2, 1), 1)]
    assert packing.plan({5: 4}, 10) == [((5, 5), 2)]
    assert packing.plan({}, 10) == []
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_one_length_in_many_buckets(spark):
    cut = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 7).otherwise(3).cast("long").alias("length"))
    rows = packing.pack(cut, capacity=10, per_bucket=50).collect()
    assert len(rows) == 5000 and check_packing(rows, 10) == 1667 + (3333 - 1667 + 2) // 3


def test_mixing_matches_sql(spark):
    assert oracle.assert_same(entry.op8_mixing(spark, FOLDER), oracle.connect(FOLDER), entry.ORACLE_SQL["op8_mixing"]) == 1000


def test_targets(spark):
    def of(sizes, weights=(1, 2, 3)):
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes], "source string, source_size long, n_docs long")
        return {r["source"]: r["target"] for r in mixing.targets(df, weights).collect()}

    assert of([("a", 60), ("b", 60), ("c", 60)]) == {"a": 30, "b": 60, "c": 90}
    assert of([("a", 10), ("b", 10), ("c", 580)]) == {"a": 30, "b": 30, "c": 540}
    assert of([(None, 60), ("b", 60), ("B", 60)]) == {"B": 30, "b": 60, None: 90}
    assert of([("a", 0), ("b", 0)]) == {"a": 0, "b": 0}
    assert of([]) == {}


def test_mixing_again_and_bounds(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    one, two = (mixing.mix(d).orderBy("doc_id").collect() for d in (docs, docs.repartition(7)))
    assert one == two and all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in one)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in one)


def test_pareto_order_prefers_likely_documents(spark):
    """Over many salts, shares of inclusion follow the inclusion probabilities."""
    docs = spark.createDataFrame([(i, "w " * (1 if i < 200 else 81), "b") for i in range(400)] + [(1000 + i, "w " * 500, "a") for i in range(33)], "doc_id long, text string, source string")
    rows = [r for k in range(3) for r in mixing.mix(docs, weights=(3, 1), salt=f"s{k}:").where("source = 'b'").collect()]
    short = np.mean([r["copies"] > 0 for r in rows if r["size"] == 1])
    tall = np.mean([r["copies"] > 0 for r in rows if r["size"] == 81])
    assert short > tall > 0 and 1.8 < short / tall < 4.5  # 81 ** 0.25 = 3 for small shares


@pytest.mark.parametrize("name", ["op6_warc", "op7_neighbours"])
def test_queries_match_sql(spark, name):
    assert oracle.assert_same(entry.QUERIES[name](spark, FOLDER), oracle.connect(FOLDER), entry.ORACLE_SQL[name]) > 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 200 + "</p>"
    tricky = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nContent-Length: 5\r\n" * 5
    rows = [(9, "http://a/1", big, "x"), (4, "http://a/2\r\nEvil: yes", big, "x"), (7, None, big, "x"), (7, None, big, "x"), (1, "", tricky, "x"), (2, "u", None, None), (3, "u", "", "x"), (5, "u", "short", "x"), (6, "u", "short", "x"), (None, "u", big, "x"), (8, "u", "x" * 300_000, "x")]
    path = str(tmp_path / "archive")
    found = [tuple(r) for r in warc.round_trip(pages(spark, rows), path=path).collect()]
    wanted = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        first = min(p for p, _, h, _ in rows if p is not None and (h or "") == (html or ""))
        again = len(data) >= 100 and (page is None or first < page)
        wanted.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(found, key=str) == sorted(wanted, key=str)
    whole = warc.assemble(warc.read(spark, path)).collect()
    payloads = {r["page_id"]: bytes(r["response"]["payload"]).decode() for r in whole if r["response"]["type"] == "response"}
    assert payloads[1] == tricky and payloads[4] == big and payloads[2] == ""
    assert all(r["request"]["uri"] == r["metadata"]["uri"] == r["response"]["uri"] for r in whole)
    assert not any("Evil" in name for r in whole for name in r.asDict())


def test_archives_of_other_writers(spark, tmp_path):
    """Any payload, a gzip member a record or a file, no gzip; many files to a task."""
    bodies = [b"", b"\r\n", b"\r\n\r\n", b"a\r\n\r\n\r\nb\r\n", b"\xff\xfe\r\n\r", b"\r\n\r\nWARC/1.1\r\n", b"x" * 3_000_000, b"\r\n\r\n" * 5000, b"\n\n", b"\r"]

    def record(name, body):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: {name}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    files = {kind: [record(f"{kind}{i}", body) for i, body in enumerate(bodies)] for kind in "abc"}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, files["a"])))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(files["b"])))
    (tmp_path / "c.warc").write_bytes(b"".join(files["c"]))
    found = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r["record_id"], bytes(r["payload"])) for r in found) == sorted((f"{kind}{i}", body) for kind in "abc" for i, body in enumerate(bodies))
    # what is missing at the end of a file is not taken from the next one
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(files["b"])[:-9]))
    with pytest.raises(Exception, match="cut short"):
        warc.read(spark, str(tmp_path)).collect()


def test_records_are_joined_by_concurrent_to(spark):
    rows = [("r1", "response", None), ("q1", "request", "r1"), ("m1", "metadata", "r1"), ("r2", "response", None), ("q9", "request", "gone")]
    df = spark.createDataFrame([(i, t, c, None, "u", "d", "x", 1, 1, None, None) for i, t, c in rows], warc.RECORD)
    found = {r["capture_id"]: r for r in warc.assemble(df).collect()}
    assert set(found) == {"r1", "r2"} and found["r1"]["request"]["record_id"] == "q1" and found["r2"]["metadata"] is None


def test_broken_archives_are_refused():
    whole = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse(warc.opened(whole * 2))] == [b"abc", b"abc"]
    for bad in (b"HTTP/1.1 200 OK\r\n\r\n", whole[:-6]):
        with pytest.raises(ValueError):
            list(warc.parse(warc.opened(bad)))


def brute_nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in good:
        if i % 20 == 0:
            scored = sorted(((-float(neighbours.inner(q[None], v[None])[0]), j) for j, v in good if j != i and len(v) == len(q)))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 1e-300, 1e30])
def test_neighbours_equal_brute_force(spark, spread):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) * spread).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(60)]  # equal vectors: ties
    rows += [(2000, None), (2020, [0.0] * 6), (2040, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (2060, [float("nan")] * 6), (2080, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], "vec_id long, embedding array<double>, score int, rank double")
    found = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20, query_block=7, candidate_block=50).collect()
    assert sorted(tuple(r) for r in found) == brute_nearest(rows, 20)


@pytest.mark.parametrize("copies", [2, 25])
def test_repeated_rows_count_once(spark, copies):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # equal vectors of other ids
    repeated = rows * 2 if copies == 2 else rows + [(i, v) for i, v in rows if i % 7 == 1] * copies
    df = spark.createDataFrame(repeated, "vec_id long, embedding array<double>")
    for blocks in ({}, {"query_block": 3, "candidate_block": 40}):
        found = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20, **blocks).collect()
        assert sorted(tuple(r) for r in found) == brute_nearest(rows, 20)


def test_few_neighbours(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 4.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).isEmpty()


def test_awkward_rows(spark, awkward, nothing):
    rows = minhash.near_duplicates(awkward, size=3, percent=85).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[9]["component_id"] == 1 and not by_id[9]["kept"]
    assert by_id[2]["n_shingles"] == by_id[3]["n_shingles"] == by_id[4]["n_shingles"] == 0 and by_id[3]["kept"]
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    two = spark.createDataFrame([(1, "a b c d"), (1, "e f g h"), (2, "e f g h"), (3, "a b c d")], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(two, size=3, percent=85).collect()} == {1}
    packed = packing.pack_documents(awkward, VOCABULARY).collect()
    assert None in {r["doc_id"] for r in packed} and len({r["doc_id"] for r in packed}) == 11 and check_packing(packed, 4096) > 10
    mixed = mixing.mix(awkward).collect()
    assert len(mixed) == 12 and all(r["taken"] == 0 for r in mixed if r["doc_id"] in (2, 3, 4))
    printed = fingerprints.edited_likeness(awkward).collect()
    assert None in {r["doc_id"] for r in printed} and len(printed) == 12 and all(0 <= r["near_edited"] <= 1 for r in printed)
    assert len({r["fingerprint"] for r in printed if r["doc_id"] in (1, 9)}) == 1
    for empty in (minhash.near_duplicates(nothing), packing.pack_documents(nothing, VOCABULARY), mixing.mix(nothing), fingerprints.edited_likeness(nothing), mixing.mixed(nothing), warc.round_trip(pages(spark, []))):
        assert empty.isEmpty()
