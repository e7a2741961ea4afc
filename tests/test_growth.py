"""Queries against their SQL on odd rows, and what they hold and move as their tables grow."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomwell.functions import batches, dom
from loomwell.operators import chunks, html, retrieval, store, versions
from loomwell.plans.catalogue import ORACLE_SQL, QUERIES
from loomwell.sources import snapshots
from tests.harness import same

SF = "/root/testdata/sf0.001"


def test_html_parts_decodes_what_its_sql_does(spark, tmp_path):
    titles = ["a &quot;b", "the&&& end&amp", "x &lt;y&gt; &amp;lt; &copy; &#65;"]
    page = lambda t: f'<html lang="en"><title>{t}</title><script>1 &amp;& 2</script><body><nav><ul><li><a href="/x">one</a></ul></nav><article><h1>{t}</h1><p>p {t}</p></article></body></html>'
    rows = spark.createDataFrame([(i, "http://h/p", page(t)) for i, t in enumerate(titles)], "page_id long, url string, html string")
    rows.write.parquet(f"{tmp_path}/pages.parquet")
    same(QUERIES["html_parts"](spark, str(tmp_path)), ORACLE_SQL["html_parts"], str(tmp_path))
    assert [r.title for r in html.structured(rows).orderBy("page_id").collect()] == ['a "b', "the&&& end&", "x <y> &lt; © A"]
    assert dom.tree("<script>1 &amp;& 2</script>", references=False).first("script").children == ["1 &amp;& 2"]


ODD = [None, "", " ", "\n", "\n\n\n", "a", "x" * 10, "# a", "a\n## b\n\nc", "a\n\n\n b \n", "a\n\u3000\n\xa0\n\t\nb\r\n\r\n", "\x0b", "\xa0abcdefgh\x1f", "| x |\n|---|\n| 1 |", "| x |\n|---|", ":a\n::b\n:", "-", "\\# a\n\n", "abcdefghi\n", "a. b\n\n" * 500, "é\u2028\x00\n\u200b\nb"]


def odd_documents(spark, path) -> str:
    """``documents`` of texts that are null, empty, blank or look like markup, and of odd languages and sources."""
    rows = [(i, x, "en", "src1") for i, x in enumerate(ODD, 1)] + [(100 + i, "a", x, "s") for i, x in enumerate([None, "", " e\n\nn+%41 ", "é"])] + [(200 + i, "a", "de", x) for i, x in enumerate([None, "", " s\n\n# t ", "| x |\n|---|"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_typed_blocks_takes_any_text_as_its_sql_does(spark, tmp_path):
    d = odd_documents(spark, tmp_path)
    spark.createDataFrame([(None, "a", "en", "s")], "doc_id long, text string, lang string, source string").write.mode("append").parquet(f"{d}/documents.parquet")
    same(QUERIES["typed_blocks"](spark, d), ORACLE_SQL["typed_blocks"], d)


def test_vector_store_takes_any_text_as_its_sql_does(spark, tmp_path):
    d = odd_documents(spark, tmp_path)
    for name in ("vector_store_outcome", "store_counts"):
        same(QUERIES[name](spark, d), ORACLE_SQL[name], d)


def test_python_helpers_hold_a_part_of_a_batch(spark):
    texts = pa.array(["x" * 400_000, None, "y" * 3_000_000, *["z" * 1000] * 5000])
    cut = list(batches.parts(texts))
    assert pa.chunked_array(cut).to_pylist() == texts.to_pylist() and all(len(p) == 1 or p.nbytes <= batches.MOST for p in cut) and len(cut) > 5
    sizes = batches.text_udf(lambda t: len(t), "int", pa.int32())
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("word. "), F.col("id").cast("int"))).alias("text"))
    assert [r.n for r in docs.orderBy("doc_id").select(sizes("text").alias("n")).collect()] == [6 * i if i % 7 else None for i in range(3000)]
    got = chunks.chunk_documents(docs, target=200, cap=800).groupBy("doc_id").agg(F.count("chunk").alias("n"), F.max("total_chunks").alias("t"))
    assert {r.doc_id: r.n for r in got.collect() if r.n == r.t} == {i: len(chunks.chunked("word. " * i, 200, 800)) for i in range(1, 3000) if i % 7}
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.concat(F.lit("<h1>t</h1><p>"), "text").alias("html"))
    assert {r.page_id: len(r.text) for r in html.structured(pages).filter("page_id % 500 = 1").select("page_id", "text").collect()} == {i: 1 + 6 * i if i % 7 else 0 for i in range(1, 3000, 500)}


def test_an_upload_moves_its_documents_once(spark):
    """Postings are made where a block's documents are: what is shuffled is the documents' terms, not each posting."""
    path = store.new_store(spark)
    docs = spark.range(400).select(F.col("id"), F.lit(None).cast("string").alias("title"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(500))) for i in range(60)]).alias("content"))
    store.index_texts(docs.unionByName(docs.filter("id % 50 = 0")), path)
    version = versions.current(spark, path)
    blocks = store._table(spark, path, version, "blocks", store.BLOCK)
    assert blocks.selectExpr("sum(size(ids))").first()[0] == store.documents(spark, path).selectExpr("sum(size(terms))").first()[0] > 20_000
    assert blocks.filter("size(ids) <> size(tfs) or array_max(tfs) <> max_tf or array_min(dls) <> min_dl or size(ids) > 128").isEmpty()
    assert "Generate" not in blocks._jdf.queryExecution().toString() and store.documents(spark, path)._jdf.queryExecution().toString().count("Join") == 0
    found = {(r.id, round(r.score, 9)) for r in store.search_texts(spark, path, "w7 w8", {"title": 2.0, "content": 1.0}, None, 0.0).collect()}
    assert found == {(str(r.id), round(r.score, 9)) for r in retrieval.bm25(docs, "w7 w8", {"title": 2.0, "content": 1.0}, None, 0.0).collect()}


def test_no_text_of_a_snapshot_goes_through_the_sums(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(snapshots, "_run_sum", lambda rows, *names, plain=snapshots._run_sum: (seen.append([k for _, k in rows.dtypes]), plain(rows, *names))[1])
    (tmp_path / "s.json").write_text('[{"docId": "1}", "text": "a \\" ] b"}, {"docId": "2", "text": "{"}]')
    items = snapshots.array_items(spark, str(tmp_path / "s.json"))
    assert [r.text for r in snapshots.read_snapshot(spark, "", items=items).orderBy("ord").collect()] == ['a " ] b', "{"]
    assert [r.docId for r in snapshots.read_upload(spark, "x.json", items).orderBy("ord").collect()] == ["1}", "2"]
    assert len(seen) == 3 and all(kinds.count("string") == 1 for kinds in seen)  # the file's name alone
