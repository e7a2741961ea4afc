"""All registered queries of the library and their DuckDB SQL.

A query has the name that its SQL has, if SQL can express it. Those over texts, URLs
and dates and those of sites and stores are in modules of their own.
"""

from __future__ import annotations

__all__ = ["ORACLE_SQL", "QUERIES"]

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.functions import dates, text, urls
from loomwell.operators import build, chunks, diff, html, queue, registry, retrieval, sequence, tree
from loomwell.plans import tables as t
from loomwell.plans.registered import ORACLE_SQL, QUERIES, query
from loomwell.plans.tables import LINKS, MANAGERS, MENU_PAGES, PROGRESS, QUEUE, SNAPSHOTS, table
from loomwell.streaming import progress as p

# Snapshot comparison


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return diff.matched(t.old_snapshot(spark, d), t.new_snapshot(spark, d))


@query(f"""WITH {SNAPSHOTS}, n AS (SELECT object_key, count(*) AS n FROM changes GROUP BY 1),
c AS (SELECT count(*) FILTER (state <> 'added') AS old_total, count(*) FILTER (state <> 'removed') AS new_total, count(*) FILTER (state = 'removed') AS removed, count(*) FILTER (state = 'added') AS added,
  count(*) FILTER (n IS NOT NULL) AS modified, count(*) FILTER (state = 'common' AND n IS NULL) AS unchanged, CAST(coalesce(sum(n), 0) AS BIGINT) AS field_changes FROM pairs LEFT JOIN n USING (object_key)),
k AS (SELECT count(*) AS keyword_pages FROM new_snap WHERE contains(lower(coalesce(text, '')), 'javascript'))
SELECT *, CASE WHEN old_total > 0 THEN printf('%.1f%%', round(100.0 * removed / old_total, 1)) ELSE 'N/A' END AS removed_share, CASE WHEN old_total > 0 THEN printf('%.1f%%', round(100.0 * added / old_total, 1)) ELSE 'N/A' END AS added_share,
  CASE WHEN old_total > 0 THEN printf('%.1f%%', round(100.0 * modified / old_total, 1)) ELSE 'N/A' END AS modified_share, CASE WHEN old_total > 0 THEN printf('%.1f%%', round(100.0 * unchanged / old_total, 1)) ELSE 'N/A' END AS unchanged_share,
  CASE WHEN new_total > 0 THEN printf('%.1f%%', round(100.0 * keyword_pages / new_total, 1)) ELSE 'N/A' END AS keyword_pages_share FROM c, k""")
def snapshot_diff_summary(spark, d):
    return diff.summarised(t.old_snapshot(spark, d), t.new_snapshot(spark, d))


@query(f"WITH {SNAPSHOTS} SELECT object_key, field, type, md5(old_value) AS old_md5, md5(new_value) AS new_md5 FROM changes")
def snapshot_diff_changes(spark, d):
    return diff.changes(_pairs(spark, d)).select("object_key", "field", "type", F.md5("old_value").alias("old_md5"), F.md5("new_value").alias("new_md5"))


@query(f"WITH {SNAPSHOTS} SELECT object_key, state FROM pairs WHERE state <> 'common'")
def snapshot_added_removed(spark, d):
    return _pairs(spark, d).filter("state <> 'common'").select("object_key", "state")


@query(f"WITH {SNAPSHOTS} SELECT url, ord FROM new_snap WHERE contains(lower(coalesce(text, '')), 'javascript')")
def snapshot_keyword_pages(spark, d):
    return diff.keyword_pages(t.new_snapshot(spark, d)).select("url", "ord")


@query(f"""WITH {SNAPSHOTS}, {LINKS}, {MANAGERS}, r AS (SELECT url, murl, hierarchy FROM old_snap UNION ALL SELECT url, murl, hierarchy FROM new_snap),
one AS (SELECT pc_url AS url, min(id) AS menu_id FROM links GROUP BY 1)
SELECT url, array_to_string(hierarchy, ' > ') AS path, menu_id, team_name, manager_names FROM r JOIN one USING (url) JOIN managers USING (menu_id) WHERE coalesce(murl, '') = ''""")
def missing_mobile_owner(spark, d):
    return diff.missing_mobile(t.old_snapshot(spark, d), t.new_snapshot(spark, d), t.links(spark, d), t.managers(spark, d))


# Registry

_SEARCH = "(menu_path ILIKE '%fr^src_1%' OR pc_url ILIKE '%fr^src_1%' OR mobile_url ILIKE '%fr^src_1%' OR created_by ILIKE '%fr^src_1%' OR created_by ILIKE '%src1%')"


def _found(spark, d):
    return t.links(spark, d).filter(registry.contains_term(registry.SEARCHED, "fr^src_1") | registry.contains_term(("created_by",), "SRC1"))


@query(f"WITH {LINKS} SELECT id, menu_path, created_at, updated_at FROM links WHERE {_SEARCH} ORDER BY created_at DESC NULLS FIRST, updated_at DESC NULLS LAST, id LIMIT 20 OFFSET 20")
def registry_search_page(spark, d):
    return registry.page(_found(spark, d), registry.newest_first(), 20, 20).select("id", "menu_path", "created_at", "updated_at")


@query(f"WITH {LINKS} SELECT count(*) AS total, 2 AS page, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM links WHERE {_SEARCH}")
def registry_search_total(spark, d):
    return _found(spark, d).agg(*registry.page_facts(F.count(F.lit(1)), 20, 20))


@query(f"WITH {LINKS}, {MANAGERS} SELECT id, menu_path FROM links ANTI JOIN managers ON id = menu_id")
def registry_unassigned(spark, d):
    return registry.unassigned(t.links(spark, d), t.managers(spark, d)).select("id", "menu_path")


@query(f"WITH {LINKS}, {MANAGERS} SELECT menu_id, menu_path, team_name, manager_names FROM managers JOIN links ON id = menu_id WHERE team_name ILIKE '%TEAM 1%' OR menu_path ILIKE '%TEAM 1%'")
def registry_managers(spark, d):
    both = registry.assigned(t.links(spark, d), t.managers(spark, d)).select("menu_id", "menu_path", "team_name", "manager_names")
    return registry.search(both, "TEAM 1", ("team_name", "menu_path"))


@query(f"WITH {LINKS}, {MANAGERS} SELECT id, menu_path, team_name, manager_names FROM links LEFT JOIN managers ON id = menu_id")
def registry_with_managers(spark, d):
    return registry.with_managers(t.links(spark, d), t.managers(spark, d)).select("id", "menu_path", "manager.team_name", "manager.manager_names")


@query(f"WITH {LINKS}, {MANAGERS} SELECT menu_id AS id, 'manager of no link' AS rule FROM managers ANTI JOIN (SELECT id FROM links WHERE menu_path <> 'en^src0') l ON id = menu_id")
def registry_violations(spark, d):
    return registry.violations(t.links(spark, d).filter("menu_path <> 'en^src0'"), t.managers(spark, d))


@query(f"WITH {LINKS}, {MANAGERS}, gone AS (SELECT id FROM links WHERE created_by = 'src5') SELECT 'link' AS kind, id FROM links ANTI JOIN gone USING (id) UNION ALL SELECT 'manager', menu_id FROM managers ANTI JOIN gone ON id = menu_id")
def registry_delete(spark, d):
    links = t.links(spark, d)
    kept, left = registry.delete_links(links, t.managers(spark, d), links.filter("created_by = 'src5'").select("id"))
    return kept.select(F.lit("link").alias("kind"), "id").union(left.select(F.lit("manager"), "menu_id"))


@query(f"WITH {LINKS} SELECT id, menu_path, CASE WHEN created_by = 'src2' THEN 'm/new' ELSE mobile_url END AS mobile_url FROM links")
def registry_update(spark, d):
    links = t.links(spark, d)
    return registry.update_links(links, links.filter("created_by = 'src2'").select("id", F.lit("m/new").alias("mobile_url"))).select("id", "menu_path", "mobile_url")


@query(f"""WITH {LINKS}, i AS (SELECT doc_id AS ord, CASE WHEN lang = 'es' THEN 'es^new' ELSE lang || '^' || source END AS menu_path, CASE WHEN lang = 'es' THEN 'new/' || (doc_id // 3) ELSE 'doc/' || doc_id END AS pc_url FROM documents),
k AS (SELECT menu_path, pc_url, min(ord) AS ord, 'mm/' || max(ord) AS mobile_url FROM i GROUP BY 1, 2), m AS (SELECT max(CAST(replace(document_id, 'doc_', '') AS BIGINT)) AS m FROM links),
f AS (SELECT k.*, l.document_id FROM k LEFT JOIN links l USING (menu_path, pc_url))
SELECT menu_path, pc_url, mobile_url, coalesce(document_id, 'doc_' || (m + row_number() OVER (PARTITION BY document_id IS NULL ORDER BY ord))) AS document_id, CASE WHEN document_id IS NULL THEN 'insert' ELSE 'update' END AS action FROM f, m""")
def menu_upsert_plan(spark, d):
    incoming = table(spark, d, "documents").selectExpr(
        "doc_id AS ord", "CASE WHEN lang = 'es' THEN 'es^new' ELSE concat(lang, '^', source) END AS menu_path", "CASE WHEN lang = 'es' THEN concat('new/', doc_id div 3) ELSE concat('doc/', doc_id) END AS pc_url", "concat('mm/', doc_id) AS mobile_url"
    )
    return registry.upsert(t.links(spark, d), incoming, "doc_").select("menu_path", "pc_url", "mobile_url", "document_id", "action")


@query(f"""WITH {LINKS}, u AS (SELECT DISTINCT unnest(list_transform(regexp_extract_all('see http://a.b/' || source || ', https://c.d/' || doc_id || '. and http://a.b/' || source || ');', 'https?://[^\\s,;]+'), lambda x: regexp_replace(x, '[.,;)\\]}}]+$', ''))) AS url FROM documents)
SELECT url, id, menu_path FROM u LEFT JOIN (SELECT 'https://c.d/' || replace(pc_url, 'doc/', '') AS url, max(id) AS id, arg_max(menu_path, id) AS menu_path FROM links GROUP BY 1) USING (url)""")
def url_menu_lookup(spark, d):
    said = F.concat(F.lit("see http://a.b/"), "source", F.lit(", https://c.d/"), "doc_id", F.lit(". and http://a.b/"), "source", F.lit(");"))
    found = table(spark, d, "documents").select(F.explode(urls.urls_in_text(said)).alias("url")).distinct()
    links = t.links(spark, d).withColumn("pc_url", F.concat(F.lit("https://c.d/"), F.replace("pc_url", F.lit("doc/"), F.lit(""))))
    return registry.url_lookup(found, links)


# Queue


@query(f"WITH {QUEUE} SELECT id, priority, last_status FROM queue WHERE is_active AND (last_status <> 'success' OR last_status IS NULL) ORDER BY priority DESC, id")
def queue_active(spark, d):
    return queue.active_urls(t.queue(spark, d)).select("id", "priority", "last_status")


@query(f"""WITH {QUEUE} SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (last_status = 'success') AS success, count(*) FILTER (last_status = 'failed') AS failed,
count(*) FILTER (is_active) - count(*) FILTER (last_status = 'success') - count(*) FILTER (last_status = 'failed') AS pending, count(*) FILTER (is_active AND (last_status <> 'success' OR last_status IS NULL)) AS pending_active FROM queue""")
def queue_stats(spark, d):
    return queue.stats(t.queue(spark, d))


@query(f"""WITH {QUEUE} SELECT id, CASE WHEN priority = 1 THEN 'success' ELSE last_status END AS last_status, CASE WHEN priority = 1 AND is_active THEN 'new_list' ELSE handler_name END AS handler_name,
CASE WHEN coalesce(CASE WHEN priority = 1 AND is_active THEN 'new_list' ELSE handler_name END, '') = '' THEN 300 WHEN regexp_matches(CASE WHEN priority = 1 AND is_active THEN 'new_list' ELSE handler_name END, 'notice|event|faq|list|webzine') THEN NULL ELSE 180 END AS timeout FROM queue""")
def queue_status_update(spark, d):
    q = t.queue(spark, d)
    results = q.filter("priority = 1").select("id", F.lit("success").alias("status"), F.lit(None).cast("string").alias("error"), F.lit("2024-02-01").cast("timestamp").alias("at"), F.when(F.col("is_active"), "new_list").alias("handler_name"))
    return queue.update_status(q, results).select("id", "last_status", "handler_name", queue.timeout_seconds(F.col("handler_name")).alias("timeout"))


@query(f"""WITH {QUEUE} SELECT priority, count(*) FILTER (last_status = 'success') AS success, count(*) FILTER (last_status = 'failed') AS failed, count(*) AS total FROM queue GROUP BY priority""")
def crawl_summary(spark, d):
    return queue.crawl_summary(t.queue(spark, d).withColumnRenamed("last_status", "status"), "priority")


# Trees


@query(f"""WITH {MENU_PAGES}, c AS (SELECT node, count(*) AS total, count(*) FILTER (leaf = node) AS own FROM nodes GROUP BY 1)
SELECT node, CASE WHEN contains(node, '^') THEN regexp_replace(node, '\\^[^^]*$', '') END AS parent, CAST(len(string_split(node, '^')) AS INTEGER) AS depth, own, total FROM c""")
def menu_tree_rollup(spark, d):
    return tree.rollup(t.menu_pages(spark, d))


@query(f"WITH {MENU_PAGES} SELECT DISTINCT node, id FROM nodes WHERE len(string_split(node, '^')) = 2")
def menu_tree_descendants(spark, d):
    pages = t.menu_pages(spark, d)
    return tree.descendants(pages, tree.rollup(pages).filter("depth = 2"))


# Retrieval


def _query_vector(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


_QV = "q AS (SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v FROM embeddings)"
_VECTOR = f"{_QV}, vec AS (SELECT vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), v) AS score FROM embeddings, q WHERE embedding IS NOT NULL AND len(embedding) = len(v) ORDER BY score DESC, id LIMIT 30)"


@query(f"WITH {_VECTOR} SELECT id AS vec_id, round(score, 6) AS score FROM vec WHERE score >= 0.1")
def vector_topk(spark, d):
    return retrieval.vector_topk(table(spark, d, "embeddings"), _query_vector(spark, d), 30, 0.1).select("vec_id", F.round("score", 6).alias("score"))


BM25_QUERY = "licensed under the Apache License"
_BM25 = """toks AS (SELECT doc_id AS id, f, boost, list_filter(string_split_regex(lower(x), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM (SELECT doc_id, 'title' AS f, 2.0 AS boost, string_split(coalesce(text, ''), chr(10))[1] AS x FROM documents UNION ALL SELECT doc_id, 'content', 1.0, coalesce(text, '') FROM documents)),
terms AS (SELECT unnest(['apache', 'license', 'licensed', 'the', 'under']) AS term),
tf AS (SELECT id, f, boost, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM toks, terms),
facts AS (SELECT f, term, count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY 1, 2),
bm AS (SELECT id, sum(CASE WHEN tf > 0 THEN boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END) AS score FROM tf JOIN facts USING (f, term) GROUP BY 1),
txt AS (SELECT id, score FROM bm WHERE score >= 0.1 ORDER BY score DESC, id LIMIT 30)"""


def _text_hits(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("content"))
    return retrieval.bm25(docs, BM25_QUERY, {"title": 2.0, "content": 1.0}, 30)


@query(f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM txt")
def bm25_topk(spark, d):
    return _text_hits(spark, d).select("id", F.round("score", 6).alias("score"))


def _both_hits(spark, d):
    vector = retrieval.vector_topk(table(spark, d, "embeddings"), _query_vector(spark, d), 30).withColumnRenamed("vec_id", "id")
    return retrieval.ranked(vector), retrieval.ranked(_text_hits(spark, d))


@query(f"""WITH {_VECTOR}, {_BM25} SELECT coalesce(v.id, x.id) AS id, round(CASE WHEN x.id IS NULL THEN v.score WHEN v.id IS NULL THEN x.score ELSE 0.7 * v.score + 0.3 * x.score END, 6) AS combined_score,
CASE WHEN x.id IS NULL THEN 'vector' WHEN v.id IS NULL THEN 'text' ELSE 'both' END AS source_type FROM vec v FULL JOIN txt x ON v.id = x.id""")
def hybrid_fuse(spark, d):
    return retrieval.fuse(*_both_hits(spark, d)).select("id", F.round("combined_score", 6).alias("combined_score"), "source_type")


@query(f"""WITH {_VECTOR}, {_BM25}, a AS (SELECT id, greatest(0, least(1, score / max(score) OVER ())) AS s, 'vector' AS search_type, 0 AS late, row_number() OVER (ORDER BY score DESC, id) AS r FROM vec
UNION ALL SELECT id, greatest(0, least(1, score / max(score) OVER ())), 'text', 1, row_number() OVER (ORDER BY score DESC, id) FROM txt),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY late, r) AS f FROM a) SELECT id, round(s, 6) AS similarity_score, search_type FROM o WHERE f = 1 ORDER BY s DESC, late, r LIMIT 20""")
def hybrid_search_api(spark, d):
    return retrieval.search_api(*_both_hits(spark, d), 20).select("id", F.round("similarity_score", 6).alias("similarity_score"), "search_type")


@query(f"""WITH {_BM25}, h AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS place FROM txt), j AS (SELECT h.id, place, string_split(text, chr(10))[1] AS title, text FROM h JOIN documents ON doc_id = id),
c AS (SELECT id, CASE WHEN contains(title, 'e') THEN 0 ELSE 1 END AS first, place, len(list_filter(string_split_regex('Title: ' || title || chr(10) || 'Content: ' || text, '\\s+'), lambda w: w <> '')) AS n_words FROM j ORDER BY first, place LIMIT 20),
u AS (SELECT id, row_number() OVER (ORDER BY first, place) AS position, n_words, sum(n_words) OVER (ORDER BY first, place) AS used_words FROM c)
SELECT id, position, n_words, CAST(used_words AS BIGINT) AS used_words FROM u WHERE used_words * 1.3 <= 2000""")
def rag_context(spark, d):
    hits = retrieval.ranked(_text_hits(spark, d)).withColumnRenamed("rank", "place")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("content"))
    return retrieval.context(docs.join(hits.select("id", "place"), "id"), "e", 10, 2000.0)


_INTENTS = "[" + ", ".join("CASE WHEN regexp_matches(lower(x), '" + "|".join(w) + f"') THEN '{k}' END" for k, w in text.INTENT_WORDS.items()) + "]"


@query(f"SELECT doc_id, array_to_string(list_filter({_INTENTS}, lambda i: i IS NOT NULL), ',') AS intents FROM (SELECT doc_id, text AS x FROM documents)")
def intent_keyword(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.keyword_intents(F.col("text")), ",").alias("intents"))


@query("""WITH u AS (SELECT user_id, list(event_type ORDER BY n DESC, event_type) AS a FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1), w AS (SELECT user_id, list(event_type ORDER BY event_type DESC) AS b FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value > 100) GROUP BY 1),
x AS (SELECT user_id, a[1:2] AS a, coalesce(b[1:2], []) AS b FROM u LEFT JOIN w USING (user_id)), y AS (SELECT *, list_filter(a, lambda i: list_contains(b, i)) AS c FROM x)
SELECT user_id, array_to_string(list_concat(c, (list_filter(a, lambda i: NOT list_contains(c, i)))[1:2], (list_filter(b, lambda i: NOT list_contains(c, i)))[1:1])[1:3], ',') AS intents FROM y""")
def intent_hybrid(spark, d):
    events = table(spark, d, "events")
    a = events.groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "event_type"))).alias("a"))
    b = events.filter("value > 100").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type"), asc=False).alias("b"))
    both = a.join(b, "user_id", "left").select("user_id", F.slice("a.event_type", 1, 2).alias("a"), F.coalesce(F.slice("b", 1, 2), F.array().cast("array<string>")).alias("b"))
    return both.select("user_id", F.array_join(text.combined_intents(F.col("a"), F.col("b")), ",").alias("intents"))


@query("SELECT event_type AS tool, count(*) AS calls, CAST(sum(count(*)) OVER () AS BIGINT) AS total, count(*) = max(count(*)) OVER () AS most_used FROM events GROUP BY 1")
def tool_usage(spark, d):
    calls = table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("calls"))
    facts = calls.agg(F.sum("calls").alias("total"), F.max("calls").alias("most"))
    return calls.crossJoin(facts).select("tool", "calls", "total", (F.col("calls") == F.col("most")).alias("most_used"))


@query("""WITH m AS (SELECT * FROM (VALUES ('user', 'en'), ('user', 'fr'), ('assistant', 'de'), ('system', 'es')) v(intent, tool)), a AS (SELECT DISTINCT lang AS tool FROM documents WHERE lang <> 'es')
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list(tool))), ',') AS tools FROM conversations JOIN m ON role = intent JOIN a USING (tool) GROUP BY 1, 2""")
def tool_filter(spark, d):
    tools = spark.createDataFrame([("user", "en"), ("user", "fr"), ("assistant", "de"), ("system", "es")], "role string, tool string")
    available = table(spark, d, "documents").filter("lang <> 'es'").select(F.col("lang").alias("tool")).distinct()
    fitting = tools.join(available, "tool", "left_semi")
    return table(spark, d, "conversations").join(fitting, "role").groupBy("conv_id", "turn").agg(F.array_join(F.sort_array(F.collect_set("tool")), ",").alias("tools"))


# Ordered rows


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_wins(spark, d):
    return sequence.first_wins(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id")])


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark, d):
    return sequence.last_wins(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id")])


@query("WITH e AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN user_id END AS k FROM events) SELECT event_id, k FROM e WHERE k IS NULL OR event_id IN (SELECT min(event_id) FROM e WHERE k IS NOT NULL GROUP BY k)")
def null_key_dedupe(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("user_id")).alias("k"))
    return sequence.first_wins_if_keyed(rows, "k", [F.col("event_id")])


@query("WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS page FROM events) SELECT e.* FROM e JOIN (SELECT user_id, event_type, min(page) AS page FROM e GROUP BY 1, 2) USING (user_id, event_type, page)")
def page_scoped_dedupe(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("page"))
    return sequence.first_page_wins(rows, ["user_id", "event_type"], "page").select("event_id", "user_id", "event_type", "page")


@query("SELECT conv_id, turn FROM (SELECT *, max(CASE WHEN length(text) < 700 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS ended FROM conversations) WHERE ended = 0")
def take_while_cutoff(spark, d):
    return sequence.take_while(table(spark, d, "conversations"), ["conv_id"], [F.col("turn")], F.length("text") < 700).select("conv_id", "turn")


@query("""WITH e AS (SELECT user_id, event_id, CAST(value > 100 AS INTEGER) AS bad FROM events), i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM e),
r AS (SELECT *, CAST(sum(bad) OVER (PARTITION BY user_id, island ORDER BY event_id) >= 3 AS INTEGER) AS hit FROM i),
b AS (SELECT *, coalesce(max(hit) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r) SELECT user_id, event_id FROM b WHERE before = 0""")
def consecutive_error_stop(spark, d):
    return sequence.stop_after_run(table(spark, d, "events"), ["user_id"], [F.col("event_id")], F.col("value") > 100).select("user_id", "event_id")


@query("SELECT conv_id, turn, role, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS is_break FROM conversations")
def control_break(spark, d):
    return sequence.control_break(table(spark, d, "conversations"), ["conv_id"], [F.col("turn")], "role").select("conv_id", "turn", "role", "is_break")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations")
def carried_forward(spark, d):
    return sequence.carried_forward(table(spark, d, "conversations"), ["conv_id"], [F.col("turn")], F.when(F.col("role") == "user", F.col("turn")), "asked").select("conv_id", "turn", "asked")


@query("""WITH RECURSIVE e AS (SELECT event_id AS node, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events), s AS (SELECT min(event_id) AS node FROM events GROUP BY user_id),
w(start, step, node) AS (SELECT node, 0, node FROM s UNION ALL SELECT start, step + 1, next FROM w JOIN e USING (node) WHERE next IS NOT NULL AND step + 1 < 1000) SELECT start, step, node FROM w""")
def linked_list_walk(spark, d):
    from pyspark.sql import Window

    events = table(spark, d, "events")
    edges = events.select(F.col("event_id").alias("node"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("next"))
    return sequence.walk(edges, events.groupBy("user_id").agg(F.min("event_id").alias("node")))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) + 99 AS n FROM events")
def sequential_ids(spark, d):
    return sequence.numbered(table(spark, d, "events").select("event_id"), ["event_id"], "n", 100)


# Scalar functions


_SITE = "CASE WHEN source = 'src1' THEN 'https://event.kt.com/html/event/ongoing_event_view.html?page=1&pcEvtNo=' || doc_id WHEN source = 'src2' THEN 'https://shop.kt.com/mobile/products.do?category=' || doc_id WHEN source = 'src3' THEN 'https://product.kt.com/wDic/productDetail.do?ItemCode=' || doc_id WHEN source = 'src4' THEN 'https://inside.kt.com/html/notice/notice_list.html' WHEN source = 'src5' THEN 'https://m.kt.com/x' ELSE 'http://other.org/' || doc_id END"


@query(f"""SELECT doc_id, CASE WHEN contains(u, 'event.kt.com') THEN replace(u, 'https://event.kt.com', 'https://m.kt.com') WHEN contains(u, 'shop.kt.com') THEN replace(u, 'https://shop.kt.com', 'https://m.shop.kt.com') WHEN contains(u, 'product.kt.com') THEN replace(replace(u, 'https://product.kt.com', 'https://m.product.kt.com'), '/wDic/', '/mDic/')
WHEN contains(u, 'kt.com') AND NOT contains(u, '://m.') THEN regexp_replace(u, '^https://([^.]+)\\.kt\\.com', 'https://m.\\1.kt.com') ELSE u END AS mobile,
CASE WHEN contains(u, 'pcEvtNo=') THEN replace(regexp_replace(u, 'pcEvtNo=\\d+', 'mblevtno=' || (doc_id + 1)), 'https://event.kt.com', 'https://m.kt.com') ELSE u END AS event_mobile FROM (SELECT doc_id, {_SITE} AS u FROM documents)""")
def url_to_mobile(spark, d):
    u = F.expr(_SITE)
    return table(spark, d, "documents").select("doc_id", urls.to_mobile(u).alias("mobile"), urls.to_event_mobile(u).alias("event_mobile"))


_ROUTES = " ".join("WHEN regexp_matches(u, '^(?:" + pattern + f")') THEN '{name}'" for name, pattern in urls.ROUTES)


@query(f"SELECT doc_id, CASE {_ROUTES} END AS handler FROM (SELECT doc_id, {_SITE} AS u FROM documents)")
def url_route(spark, d):
    return table(spark, d, "documents").select("doc_id", urls.route(F.expr(_SITE)).alias("handler"))


@query("SELECT o_orderkey, CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 3 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS day FROM orders")
def date_normalise(spark, d):
    form = F.expr("CASE cast(substr(o_orderpriority, 1, 1) AS int) WHEN 1 THEN date_format(o_orderdate, 'yyyy.M.d') WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 3 THEN date_format(o_orderdate, 'yyyy/M/d') ELSE 'none' END")
    return table(spark, d, "orders").select("o_orderkey", dates.hyphen_date(form).alias("day"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, CASE WHEN o_orderstatus = 'F' THEN '9999-99-99' ELSE strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') END AS b FROM orders""")
def period_split(spark, d):
    said = F.expr("concat(date_format(o_orderdate, 'yyyy.M.d'), CASE WHEN o_orderstatus = 'F' THEN '' ELSE concat(' ~ ', date_format(o_orderdate + INTERVAL 3 DAYS, 'yyyy/MM/dd')) END)")
    a, b = dates.period(said)
    return table(spark, d, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-') || strftime(o_orderdate + INTERVAL 3 DAY, '%m-%d') AS b FROM orders""")
def range_inherit_year(spark, d):
    said = F.expr("concat('기간: ', date_format(o_orderdate, 'yyyy'), '년 ', date_format(o_orderdate, 'M'), '월 ', date_format(o_orderdate, 'd'), '일 ~ ', date_format(o_orderdate + INTERVAL 3 DAYS, 'M'), '월 ', date_format(o_orderdate + INTERVAL 3 DAYS, 'd'), '일')")
    a, b = dates.date_range(said)
    return table(spark, d, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))


@query("SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS form, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def text_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.comparable(F.col("text"))).alias("form"), text.preview(F.col("text")).alias("preview"))


@query("""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\\\]+', '', 'g'), '<[^>]+>', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '(?m) +$', '', 'g'), '(?m)^\\s*-\\s*', '- ', 'g'), chr(10) || ' ')) AS cleaned,
CASE WHEN coalesce(text, '') = '' THEN 'info' WHEN source = 'src9' THEN 'notice' ELSE 'info' END AS kind FROM documents""")
def info_clean(spark, d):
    path = F.when(F.col("source") == "src9", "홈^공지사항").otherwise("홈")
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean_info(F.col("text"))).alias("cleaned"), text.content_type(path, F.col("text")).alias("kind"))


@query("SELECT avg(length(text)) AS average, max(length(text)) AS longest, min(length(text)) AS shortest, count(*) AS documents FROM documents")
def doc_size_stats(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").agg(F.avg(n).alias("average"), F.max(n).alias("longest"), F.min(n).alias("shortest"), F.count(F.lit(1)).alias("documents"))


# Pages


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS n_anchors, CAST(len(regexp_extract_all(html, '<h1>')) AS INTEGER) AS n_headings FROM pages")
def html_counts(spark, d):
    s = html.structured(table(spark, d, "pages"), least_text=0)
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<a href=")).alias("n_anchors"))
    return pages.join(s.select("page_id", F.size("headings").alias("n_headings")), "page_id").select("page_id", "lang", "n_anchors", "n_headings")


@query()
def html_structure(spark, d):
    return html.structured(table(spark, d, "pages")).drop("clean_html")


@query()
def markdown_typed_blocks(spark, d):
    s = html.structured(table(spark, d, "pages"))
    return html.markdown_blocks(s, "page_id", "markdown").select("page_id", "i", "block.type", "block.title", "block.data")


@query()
def page_documents(spark, d):
    s = html.structured(table(spark, d, "pages"))
    menu = t.menu_pages(spark, d).select(F.col("id").alias("page_id"), "menu_path")
    return build.documents(s.join(menu, "page_id").select("url", "menu_path", "meta_title", F.col("title").alias("page_title"), "markdown"))


@query()
def chunk_documents(spark, d):
    return chunks.chunk_documents(table(spark, d, "documents"), target=200, cap=800)


# Progress


@query(f"""WITH {PROGRESS}, ends AS (SELECT task_id, min(ord) FILTER (type IN ('final', 'complete', 'error')) AS e FROM progress GROUP BY 1), live AS (SELECT p.* FROM progress p JOIN ends USING (task_id) WHERE e IS NULL OR ord <= e),
m AS (SELECT *, CASE type WHEN 'progress' THEN coalesce(nullif(message, ''), '진행 중: ' || current || '/' || total) WHEN 'connected' THEN '연결됨' WHEN 'error' THEN '오류: ' || coalesce(message, '') WHEN 'complete' THEN coalesce(nullif(message, ''), '완료') WHEN 'status' THEN nullif(message, '') END AS msg,
CASE WHEN type = 'progress' THEN CASE WHEN total > 0 THEN CAST(floor(current * 100.0 / total + 0.5) AS BIGINT) ELSE 0 END END AS pct, type IN ('progress', 'final', 'complete') AS counted FROM live),
g AS (SELECT task_id, arg_max(type, ord) AS last_type, arg_max(pct, ord) FILTER (pct IS NOT NULL) AS p, arg_max(success, ord) FILTER (counted AND success IS NOT NULL) AS success, arg_max(failed, ord) FILTER (counted AND failed IS NOT NULL) AS failed,
arg_max(url, ord) FILTER (type = 'progress' AND url <> '') AS url, arg_max(msg, ord) FILTER (msg IS NOT NULL) AS message, count(*) AS n_events FROM m GROUP BY 1)
SELECT task_id, CASE last_type WHEN 'complete' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, CASE WHEN last_type = 'complete' THEN 100 ELSE coalesce(p, 0) END AS progress, coalesce(success, 0) AS success, coalesce(failed, 0) AS failed, url, message, n_events FROM g""")
def progress_reduce(spark, d):
    return p.reduce_batch(t.progress(spark, d))


@query(f"WITH {PROGRESS} SELECT task_id, ord, current FROM progress WHERE type = 'progress' AND (current % 10 = 0 OR current = total)")
def progress_throttle(spark, d):
    return p.throttled(t.progress(spark, d)).select("task_id", "ord", "current")


@query("SELECT CAST(user_id AS VARCHAR) AS task_id, min(event_id) AS completed_at FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def task_history(spark, d):
    return p.task_history(table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("completed_at")))


@query("SELECT conv_id AS call_id, arg_min(role, turn) AS name, string_agg(text, '' ORDER BY turn) AS arguments FROM conversations GROUP BY 1")
def tool_call_assembly(spark, d):
    return p.assembled(table(spark, d, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("ord"), F.col("role").alias("name"), F.col("text").alias("delta")))


@query("SELECT conv_id, array_to_string(list('Q: ' || text ORDER BY turn), chr(10)) AS document, count(*) AS questions FROM conversations WHERE role = 'user' GROUP BY 1")
def faq_document(spark, d):
    q = table(spark, d, "conversations").filter("role = 'user'")
    parts = F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("Q: "), F.col("text")).alias("q"))))
    return q.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["q"]), "\n").alias("document"), F.count(F.lit(1)).alias("questions"))


@query("SELECT conv_id AS call_id, arg_min(role, turn) AS name, string_agg(text, '' ORDER BY turn) AS arguments FROM conversations GROUP BY 1")
def tool_call_assembly_whole(spark, d):
    return p.assembled(table(spark, d, "conversations").select(F.col("conv_id").alias("call_id"), F.col("turn").alias("ord"), F.col("role").alias("name"), F.col("text").alias("delta")))


@query("SELECT conv_id, array_to_string(list('Q: ' || text ORDER BY turn), chr(10)) AS document, count(*) AS questions FROM conversations WHERE role = 'user' GROUP BY 1")
def faq_document_whole(spark, d):
    q = table(spark, d, "conversations").filter("role = 'user'")
    parts = F.sort_array(F.collect_list(F.struct("turn", F.concat(F.lit("Q: "), F.col("text")).alias("q"))))
    return q.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["q"]), "\n").alias("document"), F.count(F.lit(1)).alias("questions"))


# Those of the other modules register themselves
from loomwell.plans import catalogue_sites, catalogue_texts  # noqa: E402, F401
