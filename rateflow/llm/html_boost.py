"""Main-text extraction from HTML by boosted trees over DOM nodes.

Labels come without annotators: blocks of text of a bounded sample of the given pages are laid out
again in random page designs whose parts are known (article, menus, notices, adverts, forms,
comments ...). Trees learn from node statistics, attribute words, depth and siblings whether a node
belongs to the main text, and a hierarchical decoder picks the most probable choice in which no
kept node lies below a dropped one.
"""

from __future__ import annotations

import random
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateflow.llm import boosting, common, dom, rows

#: Designs of the parts that are not main text: (tags, class or id values; "" for none).
_PARTS = {
    "menu": (["nav", "div", "ul", "header"], ["menu", "nav", "navbar", "main-nav", "site-navigation", "breadcrumbs", "topmenu", "navigation", ""]),
    "header": (["header", "div"], ["header", "site-header", "masthead", "topbar", "branding", "page-header", ""]),
    "footer": (["footer", "div"], ["footer", "site-footer", "bottom", "copyright", "colophon", "footer-widgets", ""]),
    "side": (["aside", "div", "section"], ["sidebar", "widget-area", "related", "related-posts", "recommended", "popular", "more-stories", "side-col"]),
    "advert": (["div", "aside", "section", "p"], ["ad", "ads", "advert", "ad-banner", "sponsored", "promo", "adsbox", "advertisement", "promoted-content"]),
    "notice": (["div", "section", "aside", "p"], ["cookie-notice", "cookie-banner", "consent", "notice", "alert", "popup", "newsletter", "subscribe-box", "gdpr", "modal"]),
    "form": (["form", "div"], ["login", "search-form", "contact-form", "signup", "subscribe", "", "search"]),
    "comments": (["section", "div", "ol", "ul"], ["comments", "comment-list", "commentlist", "disqus_thread", "responses", "user-comments", "discussion"]),
    "share": (["div", "ul", "p"], ["share", "social", "sharing-buttons", "social-links", "print-email", "follow-us"]),
}
_MAIN = (["article", "main", "div", "section", "td"], ["", "content", "article", "post", "entry-content", "main-content", "post-body", "story", "article-body", "page", "text"])
#: Names that say nothing, for main text and for the containers around it.
_PLAIN = ["", "", "", "a1", "col-8", "x-body", "css-1q2w", "js-root", "inner", "region", "block"]
#: Attributes with stray quotes, as pages have them.
_STRAY = [" title=it's", ' data-x="5" tall"', " alt=a\"b", " data-q='>'", ' data-gt="a > b"']
_ICONS = ['<svg-icon name="a"></svg-icon>', "<template-x></template-x>", "<title-bar hidden></title-bar>", "<object-view/>", '<svg viewBox="0 0 8 8"/>', "<math/>"]


class Designer:
    """Random pages from real blocks of text; ``data-k`` marks main text (m) and the rest (b)."""

    def __init__(self, blocks: list[str], seed: int = 0):
        self.random, self.icons = random.Random(seed), random.Random(~seed)
        self.blocks = [b for b in blocks if b]
        self.words = [w for b in self.blocks[:2000] for w in b.split()] or ["text"]

    def some(self, least: int, most: int) -> str:
        n = self.random.randint(least, most)
        k = self.random.randrange(len(self.words))
        return " ".join((self.words[k : k + n] or self.words[:n]))

    def attr(self, names: list[str]) -> str:
        name = self.random.choice(names)
        return f' {self.random.choice(["class", "class", "id"])}="{name}"' if name else ""

    def icon(self) -> str:
        """At times a custom element or a self-closed picture, neither of which hides what follows."""
        return self.icons.choice(_ICONS) if self.icons.random() < 0.1 else ""

    def stray(self) -> str:
        return self.icons.choice(_STRAY) if self.icons.random() < 0.05 else ""

    def paragraph(self) -> str:
        r = self.random
        text = escape(r.choice(self.blocks) if r.random() < 0.75 else self.some(1, r.choice([3, 60])))
        if r.random() < 0.2:
            text += f' <a href="/x">{escape(self.some(1, 4))}</a> ' + escape(self.some(2, 20))
        if r.random() < 0.3:
            return f"<p><b>{text}<br>"
        return f"<p{self.stray()}>{text}</p>"

    def main(self) -> str:
        r, parts = self.random, []
        count = r.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])
        if not count or r.random() < 0.9:
            h = f"<h1>{escape(self.some(1, 12))}</h1>"
            parts.append(f"<header>{h}</header>" if r.random() < 0.1 else h)
        for _ in range(count):
            kind = r.random()
            if kind < 0.78:
                parts.append(self.paragraph())
            elif kind < 0.84:
                parts.append(f"<h{r.randint(2, 4)}>{escape(self.some(1, 8))}</h2>")
            elif kind < 0.9:
                items = "".join(f"<li>{escape(self.some(3, 25))}</li>" for _ in range(r.randint(2, 6)))
                parts.append(f"<ul>{items}</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote><p>{escape(self.some(5, 40))}</p></blockquote>")
            elif kind < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{escape(self.some(1, 4))}</td><td>{escape(self.some(1, 6))}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(self.part(r.choice(["advert", "share", "notice", "form"])))
        body = "".join(parts)
        if r.random() < 0.25:
            body = f"<div{self.attr(['', 'entry', 'inner', 'post-content', 'wrap'])}>{body}</div>"
        if r.random() < 0.15:
            body += self.part(r.choice(["share", "comments", "side"]))
        tag = r.choice(_MAIN[0])
        # the tag and its name must not be needed: most designs have neither an article nor a telling name
        names = _MAIN[1] if r.random() < 0.4 else _PLAIN
        inner = f"<{tag}{self.attr(names)} data-k=m>{self.icon()}{body}</{tag}>"
        return f"<table><tr>{inner}</tr></table>" if tag == "td" else inner

    def part(self, kind: str) -> str:
        r = self.random
        tags, names = _PARTS[kind]
        tag = r.choice(tags)
        if kind in ("menu", "share"):
            n = r.randint(2, 12)
            links = [f'<a href="/{i}">{escape(self.some(1, 3))}</a>' for i in range(n)]
            inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if r.random() < 0.75 and tag != "ul" else " | ".join(links)
            if tag == "ul":
                inner = "".join(f"<li>{x}</li>" for x in links)
            if not any(names) or tag == "div":
                names = [n for n in names if n]
        elif kind == "comments":
            item = lambda: f"<{'li' if tag in ('ol', 'ul') else 'div'}{self.attr(['comment', 'comment-body', 'reply', ''])}><p>{escape(self.some(1, 3))}</p><p>{escape(r.choice(self.blocks) if r.random() < 0.5 else self.some(3, 40))}</p></{'li' if tag in ('ol', 'ul') else 'div'}>"
            inner = (f"<h3>{escape(self.some(1, 3))}</h3>" if tag not in ("ol", "ul") else "") + "".join(item() for _ in range(r.randint(1, 6)))
        elif kind == "form":
            inner = f"<label>{escape(self.some(1, 4))}</label><input name=q><button>{escape(self.some(1, 2))}</button>" + (f"<p>{escape(self.some(2, 12))}</p>" if r.random() < 0.5 else "")
            names = names if tag == "form" else [n for n in names if n]
        elif kind == "footer":
            inner = r.choice(["&copy; ", "&copy; ", "", "Copyright "]) + escape(self.some(1, 3)) + r.choice([" &middot; ", ". ", " | "]) + escape(self.some(2, 25))
            if r.random() < 0.3:
                inner = f"<p>{inner}</p>"
            names = names if tag == "footer" else [n for n in names if n]
        elif kind == "header":
            inner = r.choice([f'<a href="/">{escape(self.some(1, 3))}</a>', f"<h2>{escape(self.some(1, 4))}</h2>", f"<p>{escape(self.some(2, 10))}</p>", escape(self.some(1, 6))])
            names = names if tag == "header" else [n for n in names if n]
        elif kind == "side":
            inner = f"<h3>{escape(self.some(1, 3))}</h3>" + (
                "<ul>" + "".join(f'<li><a href="/r">{escape(self.some(2, 8))}</a></li>' for _ in range(r.randint(2, 7))) + "</ul>" if r.random() < 0.6 else f"<p>{escape(self.some(5, 40))}</p>"
            )
            if r.random() < 0.3:
                inner += f'<div class="widget"><p>{escape(self.some(3, 30))}</p></div>'
        else:
            text = escape(self.some(2, 30))
            inner = text if r.random() < 0.5 or tag == "p" else f"<p>{text}</p>"
            if r.random() < 0.3:
                inner += f' <a href="/ok">{escape(self.some(1, 2))}</a>'
        return f"<{tag}{self.attr(names)} data-k=b>{self.icon()}{inner}</{tag}>"

    def page(self) -> str:
        r = self.random
        before = [k for k in ("header", "menu", "notice", "advert", "side", "form") if r.random() < {"menu": 0.85, "header": 0.4, "advert": 0.5}.get(k, 0.2)]
        after = [k for k in ("share", "advert", "side", "comments", "form", "notice", "menu", "footer") if r.random() < {"footer": 0.9, "comments": 0.35}.get(k, 0.2)]
        r.shuffle(before)
        main = self.main()
        if r.random() < 0.3:
            inside = self.part("side") if r.random() < 0.5 else ""
            main = f"<div{self.attr(['', 'container', 'wrapper', 'row', 'content', 'page', 'main'])}>" + (main + inside if r.random() < 0.5 else inside + main) + "</div>"
        return "<html><body>" + "".join(map(self.part, before)) + main + "".join(map(self.part, after)) + "</body></html>"


def learn(html_pages: list[str], designs: int = 2500, seed: int = 0) -> boosting.Forest:
    """Trees fitted on ``designs`` laid-out pages made of the text blocks of ``html_pages``."""
    blocks = [n.text for h in html_pages for n in dom.parse(h)[1] if n.text]
    designer = Designer(blocks or ["text"], seed)
    trees = [dom.parse(designer.page())[1] for _ in range(designs)]
    return boosting.fit(dom.features(trees), np.concatenate([dom.labels(t) for t in trees]))


def extract(htmls: list[str], forest: boosting.Forest) -> list[list[str]]:
    """The kept blocks of each page, scored in one go."""
    trees = [dom.parse(h)[1] for h in htmls]
    if not trees:
        return []
    p = forest.probabilities(dom.features(trees))
    cuts = np.cumsum([len(t) for t in trees])[:-1]
    return [dom.decode(t, q) for t, q in zip(trees, np.split(p, cuts), strict=True)]


def main_text(pages: DataFrame, sample: int = 300, sample_chars: int = 20_000) -> DataFrame:
    """(row, text) for every page: its main blocks joined by newlines, from the whole html.

    The text blocks for the designs come from at most ``sample`` pages (of each at most
    ``sample_chars`` characters; the extraction itself reads all). Null or empty html gives an
    empty text; repeated pages are extracted each; an empty table gives no rows.
    """
    some = rows.sample(pages.where("html IS NOT NULL").select(F.col("page_id").alias("doc_id"), F.substring("html", 1, sample_chars).alias("html")), sample)
    forest = learn([r["html"] for r in some.collect()])  # bounded by sample x sample_chars
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    def one(batch: pa.RecordBatch) -> dict:
        return {"content": ["\n".join(blocks) for blocks in extract(common.strings(batch, "text"), shared.value)]}

    return rows.annotate(pages, {"text": F.col("html")}, "content STRING", one, 1 << 20)


def op8_boosted_dom(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    found = main_text(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", F.col("content").alias("text"), F.length("content").cast("bigint").alias("n_chars"))
