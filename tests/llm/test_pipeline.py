"""Each stage on its own input, and the run as a whole."""

import collections

import corpus_pipeline as pipeline
import pytest
from test_sets import brute_duplicates, check_packing

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and output of every stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return dict(zip((n for n, _ in pipeline.STAGES), out))


def test_columns(stages):
    names = list(stages)
    for name in names[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_filters_keep_clean_documents(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = stages["toxicity"]
    gone = {r["doc_id"] for r in before.select("doc_id").collect()} - {r["doc_id"] for r in after.select("doc_id").collect()}
    toxic = {i for i, y in labels.items() if y == 1}
    assert len(gone & toxic) > 0.7 * len(toxic)
    clean = {i for i, y in labels.items() if y == 0}
    assert len(gone & clean) < 0.03 * len(clean)
    before, after = stages["language"]
    assert after.count() >= 0.97 * before.count()


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    wanted = brute_duplicates([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    kept = [r["doc_id"] for r in after.collect()]
    assert sorted(kept) == sorted(i for i, (_, c) in wanted.items() if i == c)


def test_mix_and_packing(stages):
    before, after = stages["mixing"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    copies = collections.Counter()
    for r in after.collect():
        assert texts[r["doc_id"]] == r["text"]
        copies[r["doc_id"]] += 1
    assert max(copies.values()) <= 3
    total = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(total(after.collect()) - total(before.collect())) < 0.02 * total(before.collect())
    packed = stages["packing"][1].collect()
    count = check_packing(packed, pipeline.CAPACITY)
    assert count <= -(-sum(r["length"] for r in packed) // pipeline.CAPACITY) * 1.02 + 1
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies


def test_run(spark, stages):
    found = pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, found.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, stages["packing"][1].select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_unlike_texts_of_one_id_stay(spark):
    one, two, three = (" ".join(f"{k}{n}" for n in range(30)) for k in "abc")
    rows = [(1, one), (1, two), (1, two), (2, two), (3, three), (3, one), (4, three), (5, three + " more")]
    found = pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    texts = sorted(r["text"] for r in found)
    assert texts in ([one, two, three], [one, two, three + " more"])
    assert all((r["doc_id"], r["text"]) in rows for r in found)


def test_awkward_rows(spark, awkward, nothing, tmp_path):
    spark.createDataFrame([(1, 1, 0), (9, 1, 0), (5, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).isEmpty(), name
        found = stage(spark, awkward, str(tmp_path))
        assert found.count() > 0, name
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in found.collect()]
            assert sorted(x for x in ids if x) == [1, 2, 3, 4, 5, 6, 7, 8, 10] and ids.count(None) == 1


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_do_not_keep_the_heap_of_those_before(spark, nothing, tmp_path, name, stage):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    memory, gateway = spark._jvm.java.lang.Runtime.getRuntime(), spark.sparkContext._gateway
    held = [spark._jvm.java.nio.ByteBuffer.allocate(64 << 20) for _ in range(32)]
    grown = memory.totalMemory()
    for buffer in held:
        gateway.detach(buffer)
    assert stage(spark, nothing, str(tmp_path)).isEmpty()
    assert memory.totalMemory() < grown / 2
