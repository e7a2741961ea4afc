"""HTML and Markdown structuring: one helper call a page in Arrow batches, results as nested columns.

Defined cases: a null or empty page has empty texts and lists; unclosed tags are read as
far as they go, to any depth; a malformed link stays as it stands; repeated pages give equal
rows; an empty table gives an empty result; columns other than key, url and html are dropped.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwell.functions import dom
from loomwell.functions.batches import parts, text_udf
from loomwell.functions.urls import joined

# Where a page's main content is looked for, in order, and what is removed from it.
MAIN = ("#main-content", ".wiki-content", "main", "body")
REMOVED = (
    "header", "footer", "nav", "aside", "sidebar", ".header", ".footer", ".nav", ".aside", ".sidebar", ".navigation", ".menu",
    "div.aui-page-header-actions", "div.page-actions", "div.aui-toolbar2", "div.comment-container", "div.like-button-container",
    "div.page-labels", "div.comment-actions", "span.st-table-filter", "svg", "div.confluence-information-macro", "div.aui-message",
    "div.page-metadata-modification-info", ".aui-page-header-actions", ".like-button-container", ".page-labels",
    "div#page-metadata-banner", "ul.banner", "script", "style", "div.ad",
)

# What is taken out of scraped pages before they become Markdown: frames of the site, sharing and
# banners, hidden elements and layers, scripts.
EXCLUDED = (
    "#cfmClHeader", "#cfmClFooter", "#cfmClSkip",
    ".header", ".footer", ".header-area", ".footer-area",
    ".nav", ".navigation", ".sidebar", ".advertisement",
    ".banner", ".popup", ".modal", ".overlay", ".sns-share", ".sns-list",
    ".sns.twitter", ".sns.facebook", ".sns.kakao", ".sns.youtube",
    ".swiper-controls-wrapper", ".opage-hashtag-arrow", ".swiper-button-next", ".swiper-button-prev",
    ".icon.kakao", ".icon.facebook", ".icon.twitter", ".icon.youtube",
    ".btn-twitter", ".btn-facebook", ".btn-kakao", ".btn-youtube",
    ".location", ".sns-area", ".opener", "a[onclick*='KT_trackClicks']",
    ".find-center",
    ".N-compare-suggest-list", ".top-three-box",
    "#kt_mb", ".kt_mb", ".sticky", ".quickMenu", "#kt-head", ".kt-head",
    ".bnr_info", ".share_wrap", "#popupVideo", "#popupVideoNo", "#popupShortsNo", "#popupDownload", "#popupConsulting",
    "[style*='display:none']", ".invisible", ".layerPop", "script", "style", "noscript",
)

PAGE = "title string, meta_title string, breadcrumbs array<string>, headings array<struct<level:int,text:string>>, links array<struct<text:string,href:string>>, images array<struct<alt:string,src:string>>, text string, markdown string, clean_html string, nodes array<struct<node_id:int,parent_id:int,depth:int,text:string,href:string,page_id:string>>"
_texts = lambda *names: pa.list_(pa.struct([(n, pa.string()) for n in names]))
_NODE = pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("text", pa.string()), ("href", pa.string()), ("page_id", pa.string())])
#: The same in Arrow.
_PAGE = {
    "title": pa.string(), "meta_title": pa.string(), "breadcrumbs": pa.list_(pa.string()), "headings": pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())])),
    "links": _texts("text", "href"), "images": _texts("alt", "src"), "text": pa.string(), "markdown": pa.string(), "clean_html": pa.string(), "nodes": pa.list_(_NODE),
}


def _squeezed(t: str) -> str:
    return " ".join(t.split())


def _page(html: str | None, url: str | None, least_alt: int, least_text: int, references: bool = True) -> dict:
    root = dom.tree(html, references)
    heading, titles = root.first("h1#title-text"), root.all("title")
    title = _squeezed(heading.text()) if heading else _squeezed(titles[0].text()) if titles else ""
    meta = {n.attrs.get("property") or n.attrs.get("name"): n.attrs.get("content", "") for n in root.all("meta")}
    crumbs = root.first("ol#breadcrumbs")
    # all texts are taken by level, not in document order
    headings = [{"level": k, "text": _squeezed(n.text())} for k in range(1, 7) for n in root.all(f"h{k}")]
    base = url or ""
    links, seen = [], set()
    for n in root.all("a"):
        text, href = _squeezed(n.text()), joined(base, n.attrs.get("href", ""))
        if len(text) >= least_text and n.attrs.get("href", "").startswith(("http", "/")) and href.startswith("http") and href not in seen:
            seen.add(href)
            links.append({"text": text, "href": href})
    images = [{"alt": n.attrs.get("alt", "").strip(), "src": joined(base, n.attrs.get("src", ""))} for n in root.outside("header", "footer") if n.tag == "img" and len(n.attrs.get("alt", "").strip()) >= least_alt]
    nodes: list[dict] = []
    listed = root.first("div.ia-secondary-content") or root.first("nav")
    if listed:
        for li, above, a in _items(listed):
            href = a.attrs.get("href", "") if a else ""
            found = re.search(r"[?&]pageId=(\d+)", href)
            nodes.append({"node_id": len(nodes), "parent_id": above, "depth": nodes[above]["depth"] + 1 if above is not None else 0, "text": _squeezed(a.text() if a else li.text()), "href": href, "page_id": found[1] if found else None})
    main = next((m for s in MAIN if (m := root.first(s))), root)
    main.drop(*REMOVED)
    body = dom.markdown(main)
    text = _squeezed(main.text())
    parts = [f"<h1>{heading.inner_html()}</h1>" if heading else "", f"<nav aria-label='이동 경로'>{crumbs.inner_html()}</nav>" if crumbs else "", main.inner_html().strip()]
    clean = "\n".join(x for x in parts if x) if text else ""
    return {
        "title": title, "meta_title": meta.get("og:title") or meta.get("title") or (_squeezed(titles[0].text()) if titles else ""),
        "breadcrumbs": [_squeezed(n.text()) for n in crumbs.all("li")] if crumbs else [], "headings": headings, "links": links, "images": images, "text": text, "markdown": body, "clean_html": clean, "nodes": nodes,
    }


def _items(listed: dom.Node) -> list[tuple[dom.Node, int | None, dom.Node | None]]:
    """Each list item in document order, the number of the item that it is in, and its link: the first one right
    below it, else the first one that is in no other item. One walk."""
    out: list[list] = []
    todo: list[tuple[dom.Node, int | None]] = [(c, None) for c in reversed(listed.children) if isinstance(c, dom.Node)]
    while todo:
        n, item = todo.pop()
        if n.tag == "a" and item is not None and (out[item][2] is None or (out[item][2].parent is not out[item][0] and n.parent is out[item][0])):
            out[item][2] = n
        if n.tag == "li":
            out.append([n, item, None])
            item = len(out) - 1
        todo.extend((c, item) for c in reversed(n.children) if isinstance(c, dom.Node))
    return [tuple(x) for x in out]


def structured(pages: DataFrame, key: str = "page_id", least_alt: int = 3, least_text: int = 2, references: bool = True) -> DataFrame:
    """key, url and the columns of PAGE for each page (key, url, html). Without ``references`` character references stay, for a caller that decodes its own."""

    def work(batches):
        for b in batches:
            for p in parts(b):
                found = [_page(h, u, least_alt, least_text, references) for h, u in zip(p["html"].to_pylist(), p["url"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([p["key"], p["url"], *[pa.array([x[n] for x in found], t) for n, t in _PAGE.items()]], ["key", "url", *_PAGE])

    rows = pages.select(F.col(key).alias("key"), "url", "html")
    return rows.mapInArrow(work, f"key {rows.schema['key'].dataType.simpleString()}, url string, {PAGE}").withColumnRenamed("key", key)


def cleaned(pages: DataFrame, key: str = "page_id", selectors: tuple[str, ...] = EXCLUDED, include: str | None = None, references: bool = True) -> DataFrame:
    """key, html, markdown, text of each page without the elements of ``selectors``; ``include`` alone where the page has it.

    Null and empty pages give empty texts; a page's malformed markup is read as far as it goes.
    Without ``references`` character references stay as they stand.
    """

    def one(html: str | None) -> tuple[str, str, str]:
        root = dom.tree(html, references)
        only = root.first(include) if include else None
        if only:
            root = dom.Node("", {}, None)
            root.children = [only]
        root.drop(*selectors)
        return root.inner_html(), dom.markdown(root), _squeezed(root.text())

    def work(batches):
        for b in batches:
            for p in parts(b):
                found = [one(h) for h in p["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([p["key"], *[pa.array([x[i] for x in found], pa.string()) for i in range(3)]], ["key", "html", "markdown", "text"])

    rows = pages.select(F.col(key).alias("key"), "html")
    return rows.mapInArrow(work, f"key {rows.schema['key'].dataType.simpleString()}, html string, markdown string, text string").withColumnRenamed("key", key)


def joined_markdown(pages: DataFrame, order: str, markdown: str = "markdown", batch: str | None = None) -> DataFrame:
    """One text for each batch of uploaded files: their Markdown in file order, a blank line between. A batch is an upload, so a few files."""
    keys = [batch] if batch else []
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(markdown, F.lit("")).alias("m"))))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["m"]), "\n\n").alias("markdown"), F.count(F.lit(1)).alias("files"))


def table_widths(html: Column) -> Column:
    """The columns of each table's widest row."""
    return F.transform(table_grids(html), lambda t: F.coalesce(F.array_max(F.transform(t, F.size)), F.lit(0)))


def table_grids(html: Column) -> Column:
    """Each table's rows of cell texts, spans filled in."""

    grids = lambda h: [[[t for t, _ in row] for row in dom.grid(t)] for t in dom.tree(h).all("table")]
    return text_udf(grids, "array<array<array<string>>>", pa.list_(pa.list_(pa.list_(pa.string()))))(F.coalesce(html, F.lit("")))


BLOCKS = "array<struct<id:int,type:string,title:string,data:string,headers:array<string>,rows:array<struct<row_id:int,data:map<string,string>>>>>"
_ROW = pa.struct([("row_id", pa.int32()), ("data", pa.map_(pa.string(), pa.string()))])
_BLOCKS = pa.list_(pa.struct([("id", pa.int32()), ("type", pa.string()), ("title", pa.string()), ("data", pa.string()), ("headers", pa.list_(pa.string())), ("rows", pa.list_(_ROW))]))


def _blocks(markdown: str | None) -> list[dict]:
    """Typed blocks of a Markdown text: texts and tables under the last heading."""
    out: list[dict] = []
    title, run = "", []

    def close() -> None:
        lines = [x for x in run if x.strip()]
        run.clear()
        if not lines:
            return
        if len(lines) >= 2 and lines[0].lstrip().startswith("|") and re.fullmatch(r"\s*\|?(\s*:?-{3,}:?\s*\|?)+\s*", lines[1]):
            cut = lambda x: [c.strip() for c in re.split(r"(?<!\\)\|", x.strip().strip("|"))]
            headers = [h or f"컬럼{i + 1}" for i, h in enumerate(cut(lines[0]))]
            rows = []
            for i, x in enumerate(lines[2:]):
                cells = cut(x)
                rows.append({"row_id": i + 1, "data": list(dict(zip(headers, cells + [""] * (len(headers) - len(cells)), strict=False)).items())})
            out.append({"id": len(out) + 1, "type": "table", "title": title, "data": None, "headers": headers, "rows": rows})
        else:
            out.append({"id": len(out) + 1, "type": "text", "title": title, "data": "\n".join(lines), "headers": None, "rows": None})

    for line in (markdown or "").split("\n"):
        m = re.match(r"(#{1,6})\s+(.*)", line)
        if m:
            close()
            title = m[2].strip()
        elif line.strip():
            run.append(line)
        else:
            close()
    close()
    return out


def _plain_block(text: str | None) -> list[dict]:
    return [{"id": 1, "type": "text", "title": "", "data": text.strip(), "headers": None, "rows": None}] if text and text.strip() else []


def markdown_blocks(df: DataFrame, key: str, markdown: str, fallback: str | None = None) -> DataFrame:
    """key, i and the typed block for each block of a Markdown column; where it has none, the ``fallback`` column's text as one block."""

    def work(batches):
        for b in batches:
            for p in parts(b):
                found = [_blocks(x) or _plain_block(y) for x, y in zip(p["markdown"].to_pylist(), p["fallback"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([p["key"], pa.array(found, _BLOCKS)], ["key", "blocks"])

    rows = df.select(F.col(key).alias("key"), F.col(markdown).alias("markdown"), (F.col(fallback) if fallback else F.lit(None).cast("string")).alias("fallback"))
    out = rows.mapInArrow(work, f"key {rows.schema['key'].dataType.simpleString()}, blocks {BLOCKS}")
    return out.select(F.col("key").alias(key), F.posexplode("blocks").alias("i", "block"))


def title_resolved(menu_path: Column, meta_title: Column, page_title: Column, default: str = "제목 없음") -> Column:
    """The menu's last segment, else the page's meta title, else its title, else the default."""
    from loomwell.operators.tree import last_segment

    filled = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(filled(last_segment(menu_path)), filled(meta_title), filled(page_title), F.lit(default))
