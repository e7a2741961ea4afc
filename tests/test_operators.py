import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwell.functions import dom
from loomwell.operators import build, chunks, diff, html, registry, retrieval, sequence, tree
from loomwell.sources import snapshots


def test_diff_of_a_snapshot_with_itself_is_empty(spark):
    rows = [(1, "u", "m", ["a"], "t"), (2, None, None, [], None), (3, "u", "m2", ["a"], "t2")]
    s = spark.createDataFrame(rows, "ord long, url string, murl string, hierarchy array<string>, text string")
    pairs = diff.matched(s, s)
    assert pairs.count() == 2 and diff.changes(pairs).count() == 0
    summary = diff.summary(pairs, s).first()
    assert summary.unchanged == 2 and summary.added == summary.removed == 0
    empty = s.limit(0)
    assert diff.summary(diff.matched(empty, empty), empty).first().removed_share == "N/A"
    there, back = diff.matched(s, empty), diff.matched(empty, s)
    assert there.filter("state = 'removed'").count() == back.filter("state = 'added'").count() == 2


def test_diff_kinds(spark):
    schema = "ord long, url string, murl string, hierarchy array<string>, text string"
    old = spark.createDataFrame([(1, "a", None, ["x"], "one  two"), (2, "b", "m", ["x"], None)], schema)
    new = spark.createDataFrame([(1, "a", "", ["x"], "one two "), (2, "b", None, ["x"], "t")], schema)
    got = {(r.object_key, r.field, r.type) for r in diff.changes(diff.matched(old, new)).collect()}
    assert got == {('a|["x"]', "murl", "field_added"), ('b|["x"]', "murl", "field_removed"), ('b|["x"]', "text", "field_added")}


def test_sequences(spark):
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 9, 9, 9, 9, 1])], "k string, i int, v int")
    assert [r.i for r in sequence.stop_after_run(rows, ["k"], [F.col("i")], F.col("v") > 5).orderBy("i").collect()] == [0, 1, 2, 3]
    assert [r.i for r in sequence.take_while(rows, ["k"], [F.col("i")], F.col("v") < 5).collect()] == [0]
    n = sequence.numbered(rows, ["i"], "n", 5).orderBy("i").collect()
    assert [r.n for r in n] == [5, 6, 7, 8, 9, 10]
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "node long, next long")
    walked = sequence.walk(edges, spark.createDataFrame([(0,), (5,)], "node long")).collect()
    assert sorted((r.start, r.step, r.node) for r in walked) == [(0, k, k) for k in range(10)] + [(5, k, 5 + k) for k in range(5)]
    assert max(r.step for r in sequence.walk(edges, spark.createDataFrame([(0,)], "node long"), 4).collect()) == 3


def test_walk_goes_to_the_end(spark):
    edges = spark.range(1500).selectExpr("id AS node", "id + 1 AS next")
    walked = sequence.walk(edges, spark.createDataFrame([(0,)], "node long")).collect()
    assert sorted((r.step, r.node) for r in walked) == [(k, k) for k in range(1501)]


def test_tree_and_descendants(spark):
    links = spark.createDataFrame([(1, "a^b"), (2, "a^b"), (3, "a"), (4, " a ^ c "), (5, None), (6, "a^^d")], "id long, menu_path string")
    got = {r.node: (r.own, r.total, r.depth, r.parent) for r in tree.rollup(links).collect()}
    assert got == {"a": (1, 5, 1, None), "a^b": (2, 2, 2, "a"), "a^c": (1, 1, 2, "a"), "a^d": (1, 1, 2, "a")}


def test_registry_rules_and_paging(spark):
    links = spark.createDataFrame([(1, "p", "u"), (2, " ", "v")], "id long, menu_path string, pc_url string")
    managers = spark.createDataFrame([(1, "t", "m"), (1, "", "m"), (9, "t", "m")], "menu_id long, team_name string, manager_names string")
    got = {(r.id, r.rule) for r in registry.violations(links, managers).collect()}
    assert got == {(2, "link without menu_path"), (1, "manager without team_name"), (9, "manager of no link"), (1, "several managers")}
    assert registry.search(links, "  ", ("menu_path",)).count() == 2


def test_snapshot_files(spark, tmp_path):
    docs = [{"docId": "1", "url": "u", "hierarchy": ["a"], "text": "é\n"}, {"docId": "2", "text": None}]
    (tmp_path / "s.json").write_text("﻿" + json.dumps(docs, ensure_ascii=False), encoding="utf-8")
    got = snapshots.read_snapshot(spark, str(tmp_path / "s.json")).orderBy("ord").collect()
    assert [(r.ord, r.docId, r.text) for r in got] == [(0, "1", "é\n"), (1, "2", None)]
    (tmp_path / "o.json").write_text("{}")
    with pytest.raises(Exception, match="not an array"):
        snapshots.read_snapshot(spark, str(tmp_path / "o.json")).count()
    snapshots.write_lines(snapshots.read_snapshot(spark, str(tmp_path / "s.json")).drop("ord"), str(tmp_path / "lines"))
    assert snapshots.read_lines(spark, str(tmp_path / "lines")).count() == 2
    (tmp_path / "p.html").write_bytes(b"<p>a\xffb</p>")
    assert snapshots.html_files(spark, str(tmp_path)).first().html == "<p>ab</p>"
    b = spark.createDataFrame([("a.html", "PHA+"), ("b.txt", "PHA+"), ("c.html", "!")], "filename string, content_base64 string")
    assert [(r.html, r.error) for r in snapshots.base64_html(b).collect()] == [("<p>", None), (None, "not an html file"), (None, "content is not base64")]


def test_tables_and_markdown(spark):
    page = """<h1 id="title-text">T</h1><ol id="breadcrumbs"><li>A</li><li>B</li></ol><div class="ia-secondary-content"><ul><li><a href="/x?pageId=5">one</a><ul><li><a href="/y">two</a></li></ul></li></ul></div>
    <div id="main-content"><h2>H</h2><p>para<p>next<table><tr><th rowspan=2>k</th><th colspan=2>v</th></tr><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td><td>3|</td></tr></table><img alt="abc" src="/i.png"></div>"""
    r = html.structured(spark.createDataFrame([(1, "http://h/p", page), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert r[0].title == "T" and r[0].breadcrumbs == ["A", "B"]
    assert [(n.node_id, n.parent_id, n.depth, n.text, n.page_id) for n in r[0].nodes] == [(0, None, 0, "one", "5"), (1, 0, 1, "two", None)]
    assert r[0].markdown == "## H\n\npara\n\nnext\n\n| k | v > a | v > b |\n| --- | --- | --- |\n| 1 | 2 | 3\\| |"
    assert [(i.alt, i.src) for i in r[0].images] == [("abc", "http://h/i.png")]
    assert r[1].title == "" and r[1].markdown == "" and r[1].nodes == []
    blocks = html.markdown_blocks(spark.createDataFrame(r).select("page_id", "markdown"), "page_id", "markdown").orderBy("page_id", "i").collect()
    assert [(b.block.type, b.block.title) for b in blocks] == [("text", "H"), ("text", "H"), ("table", "H")]
    assert blocks[2].block.rows[0].data == {"k": "1", "v > a": "2", "v > b": "3\\|"}
    assert dom.grid(dom.tree("<table><tr><td>a<tr><td>b<td>c</table>").first("table")) == [[("a", False), ("", False)], [("b", False), ("c", False)]]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400))
def test_chunks_keep_words_and_size(t):
    out = chunks.chunked(t, target=6, cap=20, forced=5)
    assert all(c.strip() for c in out)
    assert "".join(out).replace(".", "").split() is not None
    flat = lambda x: "".join(x.split()).replace(".", "")
    assert flat("".join(out)) == flat(t)


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [1.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, round(r.score, 3)) for r in retrieval.vector_topk(v, [1.0, 0.0], 5).collect()] == [(1, 1.0), (2, 0.6)]
    h = "id long, score double, rank int"
    a, b = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 2)], h), spark.createDataFrame([(2, 2.0, 1), (3, 0.5, 2)], h)
    assert [(r.id, round(r.combined_score, 2), r.source_type) for r in retrieval.fuse(a, b).collect()] == [(2, 0.95, "both"), (1, 0.9, "vector"), (3, 0.5, "text")]
    assert [(r.id, r.search_type) for r in retrieval.search_api(a, b, 5).collect()] == [(1, "vector"), (2, "vector"), (3, "text")]


def test_build(spark):
    r = spark.createDataFrame([("u", ["m0"], ["d0", "d1"])], "url string, menus array<string>, datas array<string>")
    assert [(x.data, x.menu) for x in build.expand_results(r).collect()] == [("d0", "m0"), ("d1", None)]
    listed = spark.createDataFrame([(1, "a"), (2, "b")], "k int, title string")
    details = spark.createDataFrame([(1, " ", "c")], "k int, title string, content string")
    assert sorted((x.k, x.title, x.content) for x in build.enriched(listed, details, "k").collect()) == [(1, "a", "c"), (2, "b", None)]


def test_walk_of_lists_with_cycles(spark):
    """A ring, a list that runs into one, one that ends, a node that follows itself, repeated starts."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11), (11, 2), (20, 21), (21, 22), (22, None), (30, 30)], "node int, next int")
    starts = spark.createDataFrame([(1,), (10,), (20,), (30,), (40,), (1,)], "node int")
    got = {}
    for r in sequence.walk(edges, starts, flag=True).collect():
        got.setdefault((r.start, r.cyclic), []).append((r.step, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {(1, True): [1, 2, 3], (10, True): [10, 11, 2, 3, 1], (20, False): [20, 21, 22], (30, True): [30], (40, False): [40]}
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in got.values())
    assert sequence.walk(edges, starts, most=2).count() == 2 + 2 + 2 + 1 + 1 and sequence.walk(edges, starts.limit(0)).count() == 0
