"""Snapshot comparison: what was added, removed and changed between two snapshots.

Defined cases: a null or missing url or hierarchy is empty; a null field differs from an
empty one; of rows that repeat a key the one with the largest ``ord`` counts; empty
snapshots have no keys, and shares of nothing are N/A; whole texts are compared; columns
other than those named are never looked at.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwell.functions.batches import row_udf
from loomwell.functions.text import canonical_json, comparable
from loomwell.operators.sequence import last_wins

FIELDS = ("text", "murl")


NO_PATH = "(경로 없음)"


def object_key(url: Column, hierarchy: Column) -> Column:
    """url|hierarchy, the hierarchy's items as JSON strings or null: no two lists give one key.

    A missing url and a null one are both empty, and so is an empty hierarchy.
    """
    quoted = F.transform(hierarchy, lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1))
    path = F.when(F.size(F.coalesce(hierarchy, F.array().cast("array<string>"))) > 0, F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))).otherwise("")
    return F.concat(F.coalesce(url, F.lit("")), F.lit("|"), path)


def json_object_key(url: Column, hierarchy: Column) -> Column:
    """url|hierarchy for a hierarchy that is JSON text: a list, an object (its keys sorted) or a scalar."""
    t = F.trim(F.coalesce(hierarchy, F.lit("")))
    nested = t.rlike(r"^[\[{]")
    path = F.when(t.isin("", "[]", "{}", "null"), "").when(nested, F.to_json(F.try_parse_json(F.when(nested, t)))).otherwise(t)
    return F.concat(F.coalesce(url, F.lit("")), F.lit("|"), F.coalesce(path, t))


def hierarchy_display(hierarchy: Column) -> Column:
    return F.when(F.size(F.coalesce(hierarchy, F.array().cast("array<string>"))) > 0, F.array_join(hierarchy, " > ")).otherwise(NO_PATH)


def hierarchy_items(hierarchy: Column) -> Column:
    """The path of a hierarchy that is JSON text: a list's items, an object's depth1, depth2, ... until one is absent, or the scalar alone."""
    t = F.trim(F.coalesce(hierarchy, F.lit("")))
    named = F.from_json(F.when(t.startswith("{"), t), "map<string,string>")
    levels = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.try_element_at(named, F.concat(F.lit("depth"), i.cast("string"))))
    gap = F.coalesce(F.array_position(F.transform(levels, F.isnull), True), F.lit(0))
    until = F.slice(levels, F.lit(1), F.when(gap > 0, gap - 1).otherwise(9).cast("int"))
    listed = F.from_json(F.when(t.startswith("["), t), "array<string>")
    return F.when(t.startswith("{"), until).when(t.startswith("["), listed).when(t.isin("", "null"), F.array().cast("array<string>")).otherwise(F.array(t))


def hierarchy_values(hierarchy: Column) -> Column:
    """The path by the report's other rule: an object's values by sorted key without empty ones, joined by ' > '."""
    t = F.trim(F.coalesce(hierarchy, F.lit("")))
    pairs = F.array_sort(F.map_entries(F.from_json(F.when(t.startswith("{"), t), "map<string,string>")))
    values = F.filter(F.transform(pairs, lambda e: e["value"]), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.array_join(F.when(t.startswith("{"), values).otherwise(hierarchy_items(hierarchy)), " > ")


def _key(df: DataFrame) -> Column:
    of = object_key if isinstance(df.schema["hierarchy"].dataType, T.ArrayType) else json_object_key
    return of(F.col("url"), F.col("hierarchy"))


def matched(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Full outer join of two snapshots (ord, url, hierarchy, fields) by key; of repeated keys the last row counts."""

    def side(df: DataFrame, name: str) -> DataFrame:
        keyed = df.select(_key(df).alias("object_key"), "ord", *fields)
        one = last_wins(keyed, ["object_key"], [F.col("ord")])
        return one.select("object_key", F.lit(True).alias(f"in_{name}"), *[F.col(f).alias(f"{name}_{f}") for f in fields])

    both = side(old, "old").join(side(new, "new"), "object_key", "full_outer")
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed")
    return both.withColumn("state", state.otherwise("common"))


def changes(pairs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(object_key, field, type, old_value, new_value) for each field that differs in both snapshots."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old_value"), F.col(f"new_{f}").alias("new_value")) for f in fields]))
    rows = pairs.filter("state = 'common'").select("object_key", cells.alias("c")).select("object_key", "c.*")
    # equal texts need no normalising
    rows = rows.filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    rows = rows.filter(~comparable(F.col("old_value")).eqNullSafe(comparable(F.col("new_value"))))
    kind = F.when(F.col("old_value").isNull(), "field_added").when(F.col("new_value").isNull(), "field_removed").otherwise("field_modified")
    return rows.withColumn("type", kind)


def summary(pairs: DataFrame, new: DataFrame, keyword: str = "javascript", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row of counts and shares. Shares are of the old total, of the new one for pages with the keyword; N/A for none."""
    modified = changes(pairs, fields).groupBy("object_key").agg(F.count(F.lit(1)).alias("n"))
    n = lambda c: F.count_if(c)
    counts = pairs.select("object_key", "state").join(modified, "object_key", "left").agg(
        n(F.col("state") != "added").alias("old_total"), n(F.col("state") != "removed").alias("new_total"),
        n(F.col("state") == "removed").alias("removed"), n(F.col("state") == "added").alias("added"), n(F.col("n").isNotNull()).alias("modified"),
        n((F.col("state") == "common") & F.col("n").isNull()).alias("unchanged"), F.coalesce(F.sum("n"), F.lit(0)).alias("field_changes"),
    )
    pages = keyword_pages(new, keyword).agg(F.count(F.lit(1)).alias("keyword_pages"))
    return _shares(counts.crossJoin(pages))  # one row each


def _shares(counts: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.format_string("%.1f%%", F.round(100.0 * F.col(a) / F.col(b), 1))).otherwise("N/A").alias(f"{a}_share")
    return counts.select("*", share("removed", "old_total"), share("added", "old_total"), share("modified", "old_total"), share("unchanged", "old_total"), share("keyword_pages", "new_total"))


def summarised(old: DataFrame, new: DataFrame, keyword: str = "javascript", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The summary of two snapshots in one pass over each: digests of the compared forms go through the join, no texts."""

    def side(df: DataFrame, name: str) -> DataFrame:
        digests = F.struct(*[F.md5(comparable(F.col(f))).alias(f) for f in fields])
        hit = _has(keyword) if name == "new" else F.lit(False)
        keyed = df.select(_key(df).alias("object_key"), "ord", digests.alias("d"), hit.alias("hit"))
        return keyed.groupBy("object_key").agg(F.max_by("d", "ord").alias(name), F.count_if("hit").alias(f"{name}_hits"))

    both = side(old, "old").join(side(new, "new"), "object_key", "full_outer")
    changed = sum((F.when(F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), 0).otherwise(1) for f in fields), F.lit(0))
    gone, came = F.col("new").isNull(), F.col("old").isNull()
    n = F.when(gone | came, 0).otherwise(changed)
    return _shares(
        both.select(gone.alias("gone"), came.alias("came"), n.alias("n"), "new_hits").agg(
            F.count_if(~F.col("came")).alias("old_total"), F.count_if(~F.col("gone")).alias("new_total"), F.count_if("gone").alias("removed"), F.count_if("came").alias("added"),
            F.count_if(F.col("n") > 0).alias("modified"), F.count_if(~F.col("gone") & ~F.col("came") & (F.col("n") == 0)).alias("unchanged"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("field_changes"), F.coalesce(F.sum("new_hits"), F.lit(0)).cast("long").alias("keyword_pages"),
        )
    )


# The report's lines.
REPORT_TITLE = "JSON 파일 비교 요약 리포트 (URL 기반 객체 비교)"
REPORT_NOTES = ("참고: URL + hierarchy를 고유 식별자로 사용하여 객체 단위로 비교했습니다.", "비교 대상: murl, title, text, metadata (단, metadata.changes 필드는 제외)", "자세한 변경사항은 CSV 파일을 확인하세요.")


def summary_report(summary: DataFrame, at: str, old_name: str, new_name: str) -> DataFrame:
    """The summary's one row as the lines of a text report, numbers with thousands separators."""
    n = lambda c: F.format_number(c if isinstance(c, Column) else F.col(c), 0)
    changed = F.col("removed") + F.col("added") + F.col("modified")
    rule, thin = F.lit("=" * 80), F.lit("-" * 40)
    lines = [
        rule, F.lit(REPORT_TITLE), rule, F.lit(f"생성 시간: {at}"), F.lit(f"이전 파일: {old_name}"), F.lit(f"현재 파일: {new_name}"), F.lit(""),
        F.lit("변경사항 요약"), thin, F.concat(F.lit("이전 파일 총 객체 수: "), n("old_total")), F.concat(F.lit("현재 파일 총 객체 수: "), n("new_total")),
        F.concat(F.lit("전체 변경 객체 수: "), n(changed)), F.concat(F.lit("변경되지 않은 객체: "), n("unchanged")), F.lit(""), F.lit("변경 유형별 통계:"),
        F.concat(F.lit("  • 삭제된 객체: "), n("removed")), F.concat(F.lit("  • 추가된 객체: "), n("added")), F.concat(F.lit("  • 수정된 객체: "), n("modified")), F.lit(""),
        F.lit("JavaScript 검출 통계:"), F.concat(F.lit("  • JavaScript 문구 검출 페이지: "), n("keyword_pages")), F.lit(""),
        F.when(changed == 0, F.lit("두 파일이 완전히 동일합니다!")), rule, *map(F.lit, REPORT_NOTES), rule,
    ]
    return summary.select(F.array_join(F.array(*lines), "\n").alias("report"))


# The keys of a page's metadata that are compared, and those whose lists are compared item by item.
METADATA_KEYS, LIST_KEYS = ("페이지 내용",), ("images", "internal_urls", "urls")
METADATA_CHANGE = "field string, type string, old_value string, new_value string, old_size int, new_size int"


def _metadata_changes(old: str | None, new: str | None, keys: tuple[str, ...] | None) -> list[dict]:
    """Changes between two metadata objects; values are JSON texts."""
    try:
        a, b = json.loads(old or "null"), json.loads(new or "null")
    except ValueError:
        return []
    if not isinstance(a, dict) or not isinstance(b, dict):
        return []
    out: list[dict] = []
    text = lambda x: None if x is None else json.dumps(x, ensure_ascii=False, sort_keys=True)
    change = lambda field, kind, x=None, y=None, n=None, m=None: out.append({"field": f"metadata.{field}", "type": kind, "old_value": text(x), "new_value": text(y), "old_size": n, "new_size": m})
    for k in sorted((set(a) | set(b)) - {"changes"}):
        x, y = a.get(k), b.get(k)
        if keys is not None and k not in keys or canonical_json(x) == canonical_json(y):
            continue
        if x is None or y is None:
            change(k, "metadata_subfield_added" if x is None else "metadata_subfield_removed", x, y)
        elif k in LIST_KEYS and isinstance(x, list) and isinstance(y, list):
            if len(x) != len(y):
                change(k, "array_size_changed", n=len(x), m=len(y))
            for i, (p, q) in enumerate(zip(x, y, strict=False)):
                if canonical_json(p) != canonical_json(q):
                    change(f"{k}[{i}]", "array_item_modified", p, q)
        else:
            change(k, "metadata_subfield_modified", x, y)
    return out


def metadata_changes(pairs: DataFrame, keys: tuple[str, ...] | None = METADATA_KEYS, old: str = "old_metadata", new: str = "new_metadata") -> DataFrame:
    """(object_key and the columns of METADATA_CHANGE) for each difference of two JSON objects; ``keys`` None: all but ``changes``.

    Equal texts are left out before any is parsed; text that isn't a JSON object has no differences.
    """

    names = [c.split() for c in METADATA_CHANGE.split(", ")]
    kind = pa.list_(pa.struct([(n, pa.string() if t == "string" else pa.int32()) for n, t in names]))

    found = row_udf(lambda x, y: _metadata_changes(x, y, keys), "array<struct<" + ",".join(f"{n}:{t}" for n, t in names) + ">>", kind)

    differing = pairs.filter(~F.col(old).eqNullSafe(F.col(new)))
    return differing.select("object_key", F.inline(found(F.col(old), F.col(new))))


def metadata_keys(old: Column, new: Column) -> Column:
    """All keys of two JSON objects but ``changes``, sorted."""
    none = F.array().cast("array<string>")
    keys = F.array_union(F.coalesce(F.json_object_keys(old), none), F.coalesce(F.json_object_keys(new), none))
    return F.array_sort(F.array_remove(keys, "changes"))


def without_changes(metadata: Column) -> Column:
    """A metadata map without its ``changes`` key."""
    return F.map_filter(metadata, lambda k, _: k != "changes")


def _has(keyword: str) -> Column:
    return F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(keyword.lower()))


def keyword_pages(snapshot: DataFrame, keyword: str = "javascript") -> DataFrame:
    return snapshot.filter(_has(keyword))


def missing_mobile(old: DataFrame, new: DataFrame, links: DataFrame, managers: DataFrame) -> DataFrame:
    """Rows of either snapshot without a mobile URL whose link has a manager; of links with one URL the smallest id."""
    rows = old.select("url", "murl", "hierarchy").unionByName(new.select("url", "murl", "hierarchy")).filter(F.coalesce("murl", F.lit("")) == "")
    one = links.groupBy(F.col("pc_url").alias("url")).agg(F.min("id").alias("menu_id"))
    return rows.join(one, "url").join(managers, "menu_id").select("url", hierarchy_display(F.col("hierarchy")).alias("path"), "menu_id", "team_name", "manager_names")
