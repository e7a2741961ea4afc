"""The versioned store and the vector index against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwell.operators import cells, retrieval, store, versions

SF = "/root/testdata/sf0.001"
BOOSTS = {"title": 2.0, "content": 1.0}


def texts(spark, rows):
    return spark.createDataFrame(rows, "id long, title string, content string")


def scores(df):
    return [(str(r.id), round(r.score, 9)) for r in df.collect()]


def test_uploads_write_their_own_rows(spark):
    path = store.new_store(spark)
    store.index_texts(texts(spark, [(1, "a", "apple pie"), (2, None, "apple tart"), (3, "x", None)]), path)
    first = versions.current(spark, path)
    store.index_texts(texts(spark, [(2, None, "pear"), (4, "t", "apple apple")]), path)
    second = versions.current(spark, path)
    assert [s["name"] for s in second.segments[:1]] == [s["name"] for s in first.segments]
    own = spark.read.parquet(f"{path}/segments/{second.segments[1]['name']}/docs")
    assert {r.id for r in own.collect()} == {"2", "4"}
    now = texts(spark, [(1, "a", "apple pie"), (2, None, "pear"), (3, "x", None), (4, "t", "apple apple")])
    for query in ("apple", "pear", "tart", "a x pie"):
        plain = [(i, s) for i, s in scores(retrieval.bm25(now, query, BOOSTS, None, 0.0))]
        assert sorted(scores(store.search_texts(spark, path, query, BOOSTS, None, 0.0))) == sorted(plain)
        # a reader of the old version sees the old texts
    assert [i for i, _ in scores(store.searched(spark, path, "tart", BOOSTS, 5, 0.0, version=first).hits)] == ["2"]
    store.merge(spark, path)
    assert len(versions.current(spark, path).segments) == 1 and store.info(spark, path).first().documents == 4
    assert sorted(scores(store.search_texts(spark, path, "apple", BOOSTS, None, 0.0))) == sorted(scores(retrieval.bm25(now, "apple", BOOSTS, None, 0.0)))
    assert versions.vacuum(spark, path) == 2 and store.info(spark, path).first().documents == 4


def test_failed_writer_is_not_seen(spark, monkeypatch):
    path = store.new_store(spark)
    store.index_texts(texts(spark, [(1, "a", "apple")]), path)
    before = versions.current(spark, path)
    with monkeypatch.context() as m:
        m.setattr(store.versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            store.index_texts(texts(spark, [(1, "a", "pear")]), path)
    assert versions.current(spark, path) == before
    assert [i for i, _ in scores(store.search_texts(spark, path, "apple", BOOSTS, 5, 0.0))] == ["1"] and store.search_texts(spark, path, "pear", BOOSTS, 5, 0.0).isEmpty()
    # a version that was cut off doesn't count, and one that another writer made is a conflict
    files, at = versions._files(spark, f"{path}/versions/{before.number + 1:012d}.json")
    out = files.create(at, False)
    out.write(bytearray(b'{"number": 2, "segm'))
    out.close()
    assert versions.current(spark, path) == before
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, before, [])


def test_batches_count_once(spark):
    path = store.new_store(spark)
    docs = texts(spark, [(1, "a", "apple"), (2, "b", "pear")])
    for _ in range(2):
        store.index_texts(docs, path, batch="7")
        outcome = store.upsert_points(docs, path, lambda c: F.when(c == "apple", F.array(F.lit(1.0))), 1, batch="7")
        assert sorted((r.id, r.ok) for r in outcome.collect()) == [("1", True), ("2", False)]
    assert len(versions.current(spark, path).segments) == 2
    assert [(r.id, r.reason) for r in store.failures(spark, path).collect()] == [("2", "no vector")]
    store.merge(spark, path)
    store.index_texts(docs, path, batch="7")
    assert len(versions.current(spark, path).segments) == 1 and store.info(spark, path).first()[:2] == (1, 2)


def test_pruned_search_equals_the_full_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"))
    path = store.new_store(spark)
    store.index_texts(docs.filter("id % 2 = 0"), path)
    store.index_texts(docs.filter("id % 3 = 0"), path)
    store.index_texts(docs.filter("id % 2 = 1"), path)
    read = 0
    for query, k in (("licensed under the Apache License", 3), ("the", 5), ("copyright", 10), ("nothing of this kind zzz", 4), ("http www", 400)):
        plain = retrieval.bm25(docs, query, BOOSTS, k, 0.0)
        found = store.searched(spark, path, query, BOOSTS, k, 0.0)
        got, want = scores(found.hits), scores(plain)
        assert [s for _, s in got] == [s for _, s in want] and len(got) == len(want)
        assert found.blocks_read <= found.blocks
        read += found.blocks_read < found.blocks
    assert store.searched(spark, path, "the", BOOSTS, None, 0.0).blocks > 1


def test_blocks_out_of_reach_are_not_read(spark):
    """A few short texts that say a word often, among many long ones that say it once."""
    long = spark.range(2000).select("id", F.lit("t").alias("title"), F.concat_ws(" ", F.lit("apple"), F.array_repeat(F.lit("word"), 200)).alias("content"))
    short = spark.range(2000, 2010).select("id", F.lit("t").alias("title"), F.lit("apple apple apple").alias("content"))
    path = store.new_store(spark)
    store.index_texts(long.unionByName(short), path)
    found = store.searched(spark, path, "apple", BOOSTS, 5, 0.0)
    assert {int(r.id) for r in found.hits.collect()} <= set(range(2000, 2010)) and found.blocks_read == 1 and found.blocks == 16


def test_cells(spark):
    draw = np.random.default_rng(3)
    centre = draw.normal(size=(12, 16))
    rows = [(i, (centre[i % 12] + 0.3 * draw.normal(size=16)).tolist(), "x") for i in range(1500)] + [(2000, None, "x"), (2001, [0.0] * 16, "x"), (2002, [1.0, 2.0], "x"), (7, rows0 := [1.0] * 16, "x"), (7, rows0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell_name string")
    index = cells.build(df, cells=24)
    assert index.vectors.count() == 1502 and index.vectors.columns == [*df.columns, "cell"]
    hit = pruned = 0
    for q in [*draw.normal(size=(4, 16)), *(centre[:6] + 0.2 * draw.normal(size=(6, 16)))]:
        want = [(r.vec_id, r.score) for r in retrieval.vector_topk(df, q.tolist(), 10).collect()]
        found = cells.nearest(index, q.tolist(), 10)
        assert [(r.vec_id, r.score) for r in found.hits.collect()] == want
        pruned += found.cells_read < found.cells
        some = cells.nearest(index, q.tolist(), 10, probes=6)
        hit += len({r.vec_id for r in some.hits.collect()} & {i for i, _ in want})
    assert hit >= 90 and pruned >= 4  # recall at 10 of a quarter of the cells, exact searches that left some out
    assert cells.nearest(index, [1.0], 3).hits.isEmpty() and cells.nearest(cells.build(df.limit(0)), [1.0] * 16, 3).hits.isEmpty()
    assert len(cells.nearest(index, rows0, 2, threshold=0.99).hits.collect()) == 2
