"""HTML extraction: a linear-chain CRF over the leaf blocks of a page.

A page is cut into leaf blocks, the runs of text between block-level tags, each
with its open ancestors. A block's features are its ancestors' tag names and the
words in their class, id and role, the tag of the block itself, and what its text
is like (length, share of linked characters, closing punctuation). The chain's
weights are learned on labelled pages by maximum likelihood, and Viterbi finds a
page's best labelling. Labelled pages come from ``labelled_pages``, a generator of
layouts with known roles; any (html blocks, labels) pairs will do instead.

Defined cases: a null or empty page has the empty text; unclosed tags and
attributes, and raw text with tags in it (scripts, styles), are read as browsers
do; text that is never shown (head, script, style, template, noscript ...) is no
block; a page of boilerplate alone has the empty text; pages of any length are
read whole; repeated rows give equal results; an empty table gives an empty
result; other columns are never looked at.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("audio canvas head iframe math noframes noscript object script style svg template textarea title video".split())
RAW_TAGS = frozenset("script style textarea title".split())
#: Elements that may stand in head; any other start tag, or text, closes it.
HEAD_TAGS = frozenset("base basefont bgsound command head html link meta noframes noscript script style template title".split())
#: A start tag closes these open elements, if it meets one before the second kind.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}

# text, or a tag without < in it: no try at it goes beyond the next <
_TOKEN = re.compile(r"""[^<]+|<(/?)([a-zA-Z][^\s/<>]*+)([^<>"']*+(?:"[^"<]*+"[^<>"']*+|'[^'<]*+'[^<>"']*+)*+)>""")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW_TAGS}


@dataclass
class Context:
    """An open element with its ancestors: the features they give together."""

    tag: str
    features: frozenset[str]
    hidden: bool
    linked: bool
    block: str
    holder: Context | None = None  # the block among the element and its ancestors; None for the element itself
    children: dict = field(default_factory=dict)


@dataclass
class Block:
    text: str
    context: Context
    linked: int

    def features(self) -> list[str]:
        return [*self.context.features, *self.own()]

    def own(self) -> list[str]:
        n, words = len(self.text), self.text.count(" ") + 1
        share = self.linked / n if n else 0.0
        out = ["block=" + self.context.block]
        out.append("words=" + ("1" if words < 2 else "4" if words < 5 else "10" if words < 11 else "30" if words < 31 else "more"))
        out.append("links=" + ("0" if share == 0 else "some" if share < 0.5 else "most" if share < 0.9 else "all"))
        out.append("end=" + ("stop" if self.text[-1:] in ".!?…:;\"'”»)" else "none"))
        if self.text[:1] in "©" or "©" in self.text[:40]:
            out.append("copyright")
        return out


class Contexts:
    """Contexts, kept from page to page, so many at most. Where ``known`` is given they have no other features, so
    that deeply nested elements, each with a name of its own, don't add up."""

    def __init__(self, known: frozenset[str] | None = None, most: int = 20_000):
        self.known, self.most = known, most
        self.clear()

    def clear(self) -> None:
        self.root, self.n = Context("", frozenset(), False, False, "body"), 0

    def child(self, parent: Context, tag: str, attributes: str) -> Context:
        found = parent.children.get((tag, attributes))
        if found is not None:
            return found
        features = {"in=" + tag}
        for m in _NAMED.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            kind = "role=" if m[1].lower() == "role" else "name="
            features.update(kind + w.lower() for w in _WORD.findall(value))
        if self.known is not None:
            features &= self.known
        whole = parent.features if features <= parent.features else parent.features | features
        block = tag in BLOCK_TAGS
        out = Context(tag, whole, parent.hidden or tag in HIDDEN_TAGS, parent.linked or tag == "a", tag if block else parent.block, None if block else parent.holder or parent)
        self.n += 1
        parent.children[tag, attributes] = out
        return out


class Open:
    """The open elements of a page. Where each tag is open last is known, so that no tag makes a search of them all."""

    def __init__(self, root: Context):
        self.stack, self.at, self.blocks = [root], {}, []

    def push(self, context: Context) -> None:
        tag, place = context.tag, len(self.stack)
        if tag in self.at:
            self.at[tag].append(place)
        else:
            self.at[tag] = [place]
        if tag in BLOCK_TAGS:
            self.blocks.append(place)
        self.stack.append(context)

    def cut(self, place: int) -> None:
        """Closes the elements from this place up."""
        for c in self.stack[place:]:
            self.at[c.tag].pop()
            if c.tag in BLOCK_TAGS:
                self.blocks.pop()
        del self.stack[place:]

    def last(self, *tags: str) -> int:
        """The highest place of these tags, 0 for none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def lowest(self, tags: tuple[str, ...], above: int) -> int:
        """The lowest place of these tags over ``above``, 0 for none."""
        found = [p[k] for t in tags if (p := self.at.get(t)) and (k := bisect_right(p, above)) < len(p)]
        return min(found, default=0)

    def end(self, tag: str) -> None:
        """An end tag: closes what is open of its kind; an inline one doesn't close a block."""
        if self.stack[-1].tag == tag:
            if len(self.stack) > 1:
                self.stack.pop()
                self.at[tag].pop()
                if tag in BLOCK_TAGS:
                    self.blocks.pop()
            return
        place = self.last(tag)
        if place and (tag in BLOCK_TAGS or not self.blocks or self.blocks[-1] < place):
            self.cut(place)

    def start_block(self, tag: str) -> None:
        """Closes what a block's start tag implies the end of."""
        kinds, border = IMPLIED_END.get(tag, ((), ()))
        p = self.at["p"][-1] if self.at.get("p") else 0
        if kinds:
            stop = self.last(*border)
            place = p if p > stop else self.lowest(kinds, stop)
        else:
            place = p if p and (self.blocks[-1] == p or self.blocks[-2:-1] == [p] and self.stack[self.blocks[-1]].tag == "p") else 0
        if place:
            self.cut(place)


def _tag_end(html: str, at: int, doomed: set[int]) -> int:
    """Where the tag's > is, quoted values left out; -1 if there is none.

    ``doomed`` has the opening quotes from which no end was found, so that none is tried again.
    """
    tried = []
    while m := _STOP.search(html, at):
        q = m.start()
        if m[0] == ">":
            return q
        if q in doomed:
            break
        tried.append(q)
        at = html.find(m[0], q + 1) + 1
        if not at:
            break
    doomed.update(tried)
    return -1


_ALL = Contexts()


def leaf_blocks(html: str, contexts: Contexts = _ALL) -> list[Block]:
    """The page's shown runs of text between block-level tags, in order. Time grows with the page's length."""
    if contexts.n > contexts.most:
        contexts.clear()
    opened, out, texts, linked = Open(contexts.root), [], [], 0
    stack = opened.stack
    holder: list[Context] = []
    at, end, last_end, doomed = 0, len(html), html.rfind(">"), set()

    def close() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append(Block(text, holder[0], linked))
            texts.clear()
            holder.clear()
            linked = 0

    while at < end:
        token = None
        m = _TOKEN.match(html, at)
        if m:
            at = m.end()
            if m[2]:
                attributes = m[3]
            else:
                token = m[0]
        elif at < last_end and (m := _TAG.match(html, at)):
            stop = _tag_end(html, m.end(), doomed)
            stop = stop if stop >= 0 else html.find(">", m.end())
            if stop < 0:
                token, at = "<", at + 1
            else:
                attributes, at = html[m.end() : stop], stop + 1
        elif html.startswith("<!--", at):
            stop = html.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        elif at < last_end and html[at + 1] in "!?/":
            at = html.find(">", at) + 1
            continue
        else:
            token, at = "<", at + 1
        if token is not None:
            if stack[-1].tag == "head" and not token.isspace():
                opened.cut(len(stack) - 1)
            top = stack[-1]
            if not top.hidden:
                text = entities.unescape(token) if "&" in token else token
                if not holder and not text.isspace():
                    holder.append(top.holder or top)
                texts.append(text)
                if top.linked:
                    linked += len(text.strip())
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag in BLOCK_TAGS:
                close()
            elif tag == "br":
                texts.append(" ")
            opened.end(tag)
            continue
        if tag not in HEAD_TAGS and (tag == "body" or stack[-1].tag == "head"):  # the end tag of head is optional
            place = opened.last("head")
            if place > opened.last("template"):
                opened.cut(place)
        if tag in BLOCK_TAGS:
            close()
            opened.start_block(tag)
        elif tag in ("br", "img"):
            texts.append(" ")
        if tag not in VOID_TAGS and (not attributes.endswith("/") or tag in BLOCK_TAGS):
            opened.push(contexts.child(stack[-1], tag, attributes))
        if tag in RAW_TAGS:
            found = _RAW_END[tag].search(html, at)
            at = found.start() if found else end
    close()
    return out


# The chain


@dataclass
class Chain:
    """Weights of a two-label chain: content (1) against boilerplate (0)."""

    weights: dict[str, float]
    bias: float
    transition: np.ndarray  # from label, to label
    start: float

    def blocks(self, html: str) -> list[Block]:
        """The page's blocks, their contexts without features that have no weight."""
        return leaf_blocks(html, self._met)

    def score(self, block: Block) -> float:
        w = self.weights
        kept = self._contexts.get(id(block.context))
        if kept is None or kept[0] is not block.context:
            if len(self._contexts) > 20_000:
                self._contexts.clear()
            kept = self._contexts[id(block.context)] = (block.context, sum(w.get(f, 0.0) for f in block.context.features))
        return self.bias + kept[1] + sum([w.get(f, 0.0) for f in block.own()])

    def viterbi(self, blocks: list[Block]) -> list[int]:
        """The labelling of greatest total weight; ties go to boilerplate."""
        if not blocks:
            return []
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b, back = 0.0, self.start + self.score(blocks[0]), []
        for block in blocks[1:]:
            s = self.score(block)
            to0, to1 = (0, a + t00) if a + t00 >= b + t10 else (1, b + t10), (0, a + t01) if a + t01 >= b + t11 else (1, b + t11)
            back.append((to0[0], to1[0]))
            a, b = to0[1], to1[1] + s
        labels = [int(b > a)]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]

    def __post_init__(self) -> None:
        self._contexts: dict = {}
        self._met = Contexts(frozenset(self.weights))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_contexts", "_met")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._contexts = {}
        self._met = Contexts(frozenset(self.weights))


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, l2: float = 0.3, rate: float = 0.3) -> Chain:
    """Maximum likelihood with an L2 penalty by Adam steps; forward and backward run over all pages at once."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for blocks, _ in pages for b in blocks for f in b.features()})
    index = {f: i for i, f in enumerate(names)}
    n, steps = len(pages), max(len(b) for b, _ in pages)
    cell, feature = [], []
    y, mask = np.zeros((n, steps), int), np.zeros((n, steps), bool)
    for i, (blocks, labels) in enumerate(pages):
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
        for t, b in enumerate(blocks):
            fs = [index[f] for f in b.features()]
            cell += [i * steps + t] * len(fs)
            feature += fs
    cell, feature = np.array(cell), np.array(feature)
    k = len(names)
    theta = np.zeros(k + 6)  # features, bias, start, four transitions
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pair = mask[:, 1:]
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    for r in range(1, rounds + 1):
        emission = np.bincount(cell, theta[feature], n * steps).reshape(n, steps) + theta[k]
        tr = theta[k + 2 :].reshape(2, 2)
        e = np.stack([np.zeros_like(emission), emission], axis=2)
        e[:, 0, 1] += theta[k + 1]
        e[~mask] = 0.0
        alpha, beta = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
        alpha[:, 0] = e[:, 0]
        for t in range(1, steps):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + tr, axis=1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            step = np.logaddexp.reduce(tr + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        node = np.exp(alpha + beta - z[:, None, None])[:, :, 1]
        edge = np.exp(alpha[:, :-1, :, None] + tr + (e + beta)[:, 1:, None, :] - z[:, None, None, None])
        residual = np.where(mask, y - node, 0.0)
        grad = np.concatenate((np.bincount(feature, residual.ravel()[cell], k), [residual.sum(), (y[:, 0] - node[:, 0]).sum()], (observed - edge[pair].sum(axis=0)).ravel())) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8) / (1 + r / 50)
    return Chain(dict(zip(names, theta[:k].tolist(), strict=True)), float(theta[k]), theta[k + 2 :].reshape(2, 2), float(theta[k + 1]))


# Labelled pages

#: Names that site builders give to parts of a page, by role.
BOILERPLATE_NAMES = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu submenu sitemap pager pagination toc skip menue navegacion",
    "header": "header masthead topbar banner logo branding site-header page-header tagline kopfzeile entete cabecera",
    "footer": "footer site-footer copyright legal colophon bottom credits imprint fusszeile impressum pied-de-page mentions-legales pie-de-pagina",
    "sidebar": "sidebar side aside widget related recommended popular trending archive tags categories more-stories seitenleiste barre-laterale barra-lateral",
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay disclaimer warning toast announcement hinweis bandeau aviso",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion commercial banner-ad anzeige werbung publicite publicidad anuncio",
    "form": "newsletter subscribe signup login search register contact form feedback poll formular anmeldung suche formulaire recherche formulario buscar",
    "comments": "comment comments comment-list respond reply discussion disqus thread user-comments responses kommentar kommentare commentaire commentaires comentario comentarios",
    "share": "share social follow sharing toolbar actions teilen partager compartir",
}
BOILERPLATE_TAGS = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "notice": ("div", "section", "dialog"), "advert": ("div", "aside", "section"), "form": ("form", "div"), "comments": ("section", "div", "ol"), "share": ("div", "ul")}
CONTENT_NAMES = "content article post entry story main body text page-content article-body post-content entry-content story-body main-content"


class _Writer:
    """Writes one page with known roles."""

    def __init__(self, seed: int):
        self.r, self.parts, self.labels = random.Random(seed), [], []

    def words(self, low: int, high: int) -> str:
        r = self.r
        made = ["".join(r.choice(("an", "the", "er", "ou", "in", "st", "re", "lo", "mi", "ka", "é", "ü", "zo")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(made).capitalize()

    def sentence(self) -> str:
        return self.words(*self.r.choice(((1, 3), (4, 12), (10, 40)))) + self.r.choice(("", ".", ".", ".", "?", "!"))

    def block(self, tag: str, text: str, label: int, attributes: str = "", closed: bool = True) -> None:
        self.parts.append(f"<{tag}{attributes}>{text}" + (f"</{tag}>" if closed else ""))
        self.labels.append(label)

    def named(self, names: str) -> str:
        name = self.r.choice(names.split())
        return "" if self.r.random() < 0.1 else f' {self.r.choice(("class", "class", "id"))}="{name}{self.r.choice(("", "", "-box", " left", "-1", "_wrap"))}"'

    def boilerplate(self, role: str) -> None:
        r, tag = self.r, self.r.choice(BOILERPLATE_TAGS[role])
        if role == "menu" and r.random() < 0.1:  # a layout of tables
            self.parts.append("<table><tr>")
            for _ in range(r.randint(1, 6)):
                self.block("td", f'<a href="/x">{self.words(1, 3)}</a>', 0)
            self.parts.append("</tr></table>")
            return
        own = tag in ("nav", "header", "footer", "aside", "form", "dialog")  # such a tag says enough without a name
        self.parts.append(f"<{tag}{'' if own and r.random() < 0.6 else ' class=%r' % r.choice(BOILERPLATE_NAMES[role].split())}>".replace("'", '"'))
        if role in ("menu", "share") or role in ("sidebar", "footer", "header") and r.random() < 0.5:
            listed = tag != "ul" and r.random() < 0.8
            self.parts.append("<ul>" if listed else "")
            for _ in range(r.randint(2, 7)):
                self.block("li" if listed or tag == "ul" else "p", f'<a href="/x">{self.words(1, 3)}</a>', 0, closed=r.random() < 0.9)
            self.parts.append("</ul>" if listed else "")
        elif role == "form":
            self.block("p", self.words(2, 12) + r.choice((".", "")), 0)
            self.block("button", self.words(1, 2), 0)
        elif role == "comments":
            self.block(r.choice(("h2", "h3")), self.words(1, 4), 0)
            for _ in range(r.randint(1, 5)):
                self.block(r.choice(("p", "li", "div")), self.sentence(), 0)
        elif r.random() < 0.3:
            self.parts.append(r.choice(("&copy; ", "")) + self.words(2, 14) + r.choice((".", "", "")))
            self.labels.append(0)
        else:
            for _ in range(r.randint(1, 3)):
                self.block(r.choice(("p", "div", "span", "h3")) if tag != "header" else r.choice(("p", "h1", "h2", "div")), r.choice(("", "&copy; ")) + self.sentence(), 0)
                if self.parts[-1].startswith("<span"):
                    self.parts[-1] = f"<div>{self.parts[-1]}</div>"
        self.parts.append(f"</{tag}>")

    def article(self) -> None:
        r = self.r
        tag = r.choice(("article", "article", "main", "div", "section"))
        outer = r.choice(("", "", "<main>", f"<div{self.named(CONTENT_NAMES)}>"))
        self.parts.append(outer + f"<{tag}{self.named(CONTENT_NAMES) if tag in ('div', 'section') or r.random() < 0.3 else ''}>")
        if r.random() < 0.9:
            self.block("h1", self.words(2, 14) + r.choice(("", ".")), 1)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.62:
                text = self.sentence()
                if r.random() < 0.15:
                    text += f' <a href="/y">{self.words(1, 4)}</a> {self.words(1, 6)}.'
                self.block("p", text, 1, closed=r.random() < 0.85)
            elif kind < 0.72:
                self.block("p", f"<b>{self.sentence()}<br>", 1, closed=False)
            elif kind < 0.79:
                self.block(r.choice(("h2", "h3")), self.words(1, 8), 1)
            elif kind < 0.85:
                self.parts.append("<ul>")
                for _ in range(r.randint(1, 4)):
                    self.block("li", self.sentence(), 1)
                self.parts.append("</ul>")
            elif kind < 0.89:
                self.block(r.choice(("blockquote", "pre", "div", "figcaption")), self.sentence(), 1)
            elif kind < 0.92:
                self.parts.append("<table>")
                for _ in range(r.randint(1, 3)):
                    self.parts.append("<tr>")
                    self.block("td", self.words(1, 4), 1)
                    self.parts.append("</tr>")
                self.parts.append("</table>")
            else:
                self.boilerplate(r.choice(("advert", "share", "sidebar", "notice", "form")))
        if r.random() < 0.25:
            self.boilerplate("comments")
        self.parts.append(f"</{tag}>" + ("</main>" if outer == "<main>" else "</div>" if outer else ""))

    def page(self) -> str:
        r = self.r
        self.parts.append('<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>')
        for role in r.sample(("header", "menu", "notice", "advert", "menu", "form", "sidebar"), r.randint(1, 5)):
            self.boilerplate(role)
        self.article()
        for role in r.sample(("comments", "sidebar", "advert", "form", "share", "notice", "footer", "footer", "menu"), r.randint(1, 5)):
            self.boilerplate(role)
        self.parts.append(r.choice(("</body></html>", "")))
        return "".join(self.parts)


def labelled_pages(count: int, seed: int = 0) -> list[tuple[str, list[int]]]:
    """Pages with the label of each leaf block, from layouts drawn at random (the same for a seed)."""
    out = []
    for i in range(count):
        w = _Writer(seed * 1_000_003 + i)
        out.append((w.page(), w.labels))
    return out


@functools.cache
def default_chain(count: int = 900, seed: int = 0) -> Chain:
    """The chain trained on so many generated pages, on the driver: a second or two, whatever the corpus."""
    pages = [(leaf_blocks(h), labels) for h, labels in labelled_pages(count, seed)]
    if any(len(b) != len(y) for b, y in pages):
        raise AssertionError("a generated page has other blocks than labels")
    return train(pages)


def main_text(html: str | None, chain: Chain) -> str:
    blocks = chain.blocks(html) if html else []
    return "\n\n".join(b.text for b, y in zip(blocks, chain.viterbi(blocks), strict=True) if y)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", chain: Chain | None = None) -> DataFrame:
    """key, url, text, n_chars for each page."""
    chain = chain or default_chain()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h, chain) for h in batch["html"]]
            yield pd.DataFrame({"key": batch["key"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(work, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key)
