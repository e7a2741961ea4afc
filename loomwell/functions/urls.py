"""URL functions as column expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwell.functions.batches import row_udf

# Mobile hosts by rule, in order: a URL that contains the first has the second replaced by the third.
MOBILE_RULES = [("event.kt.com", "https://event.kt.com", "https://m.kt.com"), ("shop.kt.com", "https://shop.kt.com", "https://m.shop.kt.com"), ("product.kt.com", "https://product.kt.com", "https://m.product.kt.com")]
MOBILE_ANY = r"^https://([^.]+)\.kt\.com([^\n]*)"
SHOP = ("https://shop.kt.com", "https://m.shop.kt.com:444/m")
BLOG = ("https://gigagenie.kt.com/blog/", "https://gigagenie.kt.com/m/blog/")
ROAMING = ("globalroaming.kt.com", "m.globalroaming.kt.com", "/news/view.asp")

# The numbers of the accessory lists.
ACCESSORY_NUMBERS = ["042901", "042902", "042903", "043002", "043004", "043005", "043006", "043007", "043101", "043102", "043103", "043104", "043105", "043401", "043402", "043501", "043502", "043503", "043504"]

# Page handlers in the order of their patterns.
ROUTES = [
    ("membership_partners", r"https?://membership\.kt\.com/discount/partner/PartnerList\.do"),
    ("membership_faq", r"https?://membership\.kt\.com/guide/faq/FAQList\.do"),
    ("show_notices", r"https?://kt\.interpark\.com/Partner/KT/Event/NoticeList\.asp.*"),
    ("roaming_notices", r"https?://globalroaming\.kt\.com/news/list\.asp(?:\?.*)?$"),
    ("notices", r"https?://inside\.kt\.com/html/notice/notice_list\.html"),
    ("assistant_detail", r"https?://gigagenie\.kt\.com/whyGenieServiceDetail\.do\?serviceCate=.*"),
    ("assistant_faq", r"https?://gigagenie\.kt\.com/whyGenieFaq\.do.*"),
    ("assistant_news", r"https?://gigagenie\.kt\.com/whyGenieNews\.do"),
    ("shop_popups", r"https?://shop\.kt\.com/direct/directEsim\.do"),
    ("shop_popups", r"https?://shop\.kt\.com/direct/directUsim\.do"),
    ("shop_popups", r"https?://shop\.kt\.com/direct/quickUsim\.do"),
    ("shop_popups", r"https?://shop\.kt\.com/unify/mobile\.do\?.*category=changePhone"),
    ("shop_popups", r"https?://shop\.kt\.com/direct/directPhoneOrder\.do"),
    ("shop_popups", r"https?://shop\.kt\.com/direct/directAddUsim\.do"),
    ("shop_popups", r"https?://shop\.kt\.com/direct/directDual\.do"),
    ("shop_popups", r"https?://shop\.kt\.com/unify/mobile\.do\?.*category=usim"),
    ("shop_popups", r"https?://shop\.kt\.com/direct/directSmart\.do"),
    ("shop_popups", r"https?://shop\.kt\.com/direct/directEsimMove\.do"),
    ("shop_products", r"https?://shop\.kt\.com/mobile/products\.do\?category=.*"),
    *[("accessories", rf"https?://shop\.kt\.com/display/olhsStore\.do\?dispNo=STOR{n}") for n in ACCESSORY_NUMBERS],
    ("trade_in", r"https?://shop\.kt\.com/goodbye/phoneView\.do.*"),
    ("store_plans", r"https?://shop\.kt\.com/display/olhsStore\.do\?dispNo=STOR05&subDispNo=STOR0501.*"),
    ("store_plans", r"https?://shop\.kt\.com/display/olhsStore\.do\?dispNo=STOR05&subDispNo=STOR0503.*"),
    ("network_notices", r"https?://inside\.kt\.com/html/notice/net_notice_list\.html"),
    ("safety_notices", r"https?://inside\.kt\.com/html/safety/notice_list\.html"),
    ("events", r"https?://event\.kt\.com/html/event/ongoing_event_list\.html"),
    ("event_detail", r"https?://event\.kt\.com/html/event/ongoing_event_view\.html\?.*pcEvtNo=\d+"),
    ("tv_channels", r"https?://tv\.kt\.com/tv/channel/pChInfo\.asp.*"),
    ("webzine", r"https?://shop\.kt\.com/unify/webzineList\.do.*"),
    ("movie_faq", r"https?://membership\.kt\.com/culture/movie/CustomerCenterInfo\.do"),
    ("support_faq", r"https?://ermsweb\.kt\.com/pc/faq/faqList\.do"),
    ("product_detail", r"https?://product\.kt\.com/wDic/(soho/)?productDetail\.do\?ItemCode=.*"),
    ("product_list", r"https?://product\.kt\.com/wDic/.*index\.do\?CateCode=\d+"),
    ("winners", r"https?://shop\.kt\.com/display/olhsStore\.do\?dispNo=STOR05&subDispNo=STOR0506.*"),
]


def _http_only(url: Column, value: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")).startswith("http"), value).otherwise("")


def to_mobile(url: Column) -> Column:
    """A desktop URL's mobile form by the first rule that fits; others stay."""
    out = F.when(F.coalesce(url, F.lit("")) == "", F.lit(""))
    for holds, old, new in MOBILE_RULES:
        changed = F.replace(url, F.lit(old), F.lit(new))
        if holds == "product.kt.com":
            changed = F.replace(changed, F.lit("/wDic/"), F.lit("/mDic/"))
        out = out.when(F.contains(url, F.lit(holds)), changed)
    general = ~F.contains(url, F.lit("://m.")) & url.rlike(MOBILE_ANY)
    return out.when(general, F.concat(F.lit("https://m."), F.regexp_extract(url, MOBILE_ANY, 1), F.lit(".kt.com"), F.regexp_extract(url, MOBILE_ANY, 2))).otherwise(url)


def to_shop_mobile(url: Column) -> Column:
    return _http_only(url, F.replace(url, F.lit(SHOP[0]), F.lit(SHOP[1])))


def to_blog_mobile(url: Column) -> Column:
    return _http_only(url, F.replace(url, F.lit(BLOG[0]), F.lit(BLOG[1])))


def to_roaming_mobile(url: Column) -> Column:
    """On the view page the query keeps ``idx`` alone."""
    host = F.regexp_replace(url, rf"^(https?://[^/?#]*?){ROAMING[0].replace('.', '[.]')}", f"$1{ROAMING[1]}")
    base = F.regexp_extract(host, r"^(https?://[^/?#]*)", 1)
    idx = F.coalesce(F.nullif(F.regexp_extract(url, r"[?&]idx=([^&#]*)", 1), F.lit("")), F.lit(""))
    view = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1).startswith(ROAMING[2])
    return _http_only(url, F.when(view, F.concat(base, F.lit(ROAMING[2] + "?idx="), idx)).otherwise(host))


def to_event_mobile(url: Column) -> Column:
    """The mobile event number is the desktop one plus 1; past events get a row count."""
    number = F.regexp_extract(url, r"pcEvtNo=(\d+)", 1)
    moved = F.replace(url, F.lit("https://event.kt.com"), F.lit("https://m.kt.com"))
    renamed = F.when(number == "", F.replace(moved, F.lit("pcEvtNo="), F.lit("mblevtno="))).otherwise(
        F.regexp_replace(moved, F.lit(r"pcEvtNo=\d+"), F.concat(F.lit("mblevtno="), (number.try_cast("long") + 1).cast("string")))
    )
    past = F.contains(renamed, F.lit("past_event_view.html")) & ~F.contains(renamed, F.lit("rows="))
    rows = F.concat(renamed, F.when(F.contains(renamed, F.lit("?")), "&").otherwise("?"), F.lit("rows=10"))
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(past, rows).otherwise(renamed)


def route(url: Column, routes: list[tuple[str, str]] = ROUTES) -> Column:
    """The handler of the first pattern that matches from the URL's start; null for none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(routes):
        out = F.when(url.rlike(f"^(?:{pattern})"), name).otherwise(out)
    return out


def urls_in_text(text: Column) -> Column:
    """The URLs of a text without closing punctuation, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(https?://[^\s,;]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;)\]}]+$", "")))


def joined(base: str | None, link: str | None) -> str | None:
    """A link resolved against its page; as it stands where either is malformed."""
    try:
        return None if link is None else urljoin(base or "", link)
    except ValueError:
        return link


#: A link resolved against its page, both columns.
absolute = row_udf(joined, "string", pa.string())


def query_value(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def year_month(url: Column) -> tuple[Column, Column]:
    """Year (two digits: 2000s) and two-digit month of a query string."""
    year = query_value(url, "year").try_cast("int")
    return F.when(year < 100, year + 2000).otherwise(year), F.lpad(query_value(url, "month"), 2, "0")


def detail_url(base: str, **parameters: Column) -> Column:
    """``base`` with those parameters that aren't null."""
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *[F.concat(F.lit(f"{k}="), v) for k, v in parameters.items()]))
