"""Main text of web pages by a tree-structured graphical model.

A page is a tree of block elements (``html_tree``). Each node has a label,
content or not; parent-child potentials connect the nodes (``tree_model``).
Sum-product messages upward and downward give each node's probability of being
content, and the text blocks of nodes at 0.5 or more are the main text.

The model is trained on labelled pages of two kinds. The first is a bounded
sample of the table's own pages whose markup says where the article is (an
``article`` element; what lies in it is content unless an element's name says
otherwise). The second sets the text of those pages into layouts whose labels
are known since they are made here: the article in ``div``s of many names, with
menus, headers, footers, sidebars, notices, adverts, forms and comments around
and inside it. So the model also learns pages without an ``article`` element.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import batches, text_bytes
from loanlens.llm.html_tree import Page, parse
from loanlens.llm.tree_model import Forest, marginals, train

#: Expected pages of the training sample, and the longest page taken into it.
SAMPLE_PAGES = 300
SAMPLE_CHARS = 100_000
LAYOUTS_PER_PAGE = 3

# Words in element names that web authors give these parts.
PARTS = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs toc topbar pagination pager tabs skip".split(),
    "header": "header masthead banner site-header page-header branding logo".split(),
    "footer": "footer site-footer page-footer copyright colophon legal bottom".split(),
    "sidebar": "sidebar side-bar aside widget widgets rail secondary related recommended popular trending "
               "tags".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay paywall disclaimer message".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted outbrain".split(),
    "form": "form subscribe newsletter signup login search contact-form register".split(),
    "comments": "comment comments commentlist reply replies respond discussion disqus responses feedback".split(),
    "share": "share sharing social follow toolbar buttons".split(),
}
ARTICLE = ("article article-body content post post-content entry entry-content main main-content story story-body "
           "text body-text page-content").split()
#: Element tags that also stand for a part.
PART_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
NOT_CONTENT_TAGS = frozenset(
    "nav header footer aside form head title button select menu dialog script style fieldset".split())
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_PART_NAMES = frozenset(w for names in PARTS.values() for n in names for w in n.split("-")) - {
    "site", "page", "side", "bar", "contact", "bottom", "body"}
#: Kind of part by a word of a name, and by a tag.
KIND_OF = {w: kind for kind, names in PARTS.items() for n in names for w in n.split("-") if w in _PART_NAMES}
KIND_OF_TAG = {tag: kind for kind, tag in PART_TAGS.items()}


def name_words(names: str) -> set[str]:
    return {w.lower() for w in _NAME.findall(names)}


def node_features(page: Page) -> list[list[str]]:
    """Features of each node by name: its tag and those around it, the words
    of its names, and the amount and form of its own and all its text."""
    nodes = page.nodes
    chars = [n.chars for n in nodes]
    links = [n.link_chars for n in nodes]
    children = [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        p = nodes[k].parent
        chars[p] += chars[k]
        links[p] += links[k]
        children[p] += 1
    everything = max(1, chars[0])
    out = []
    within: list[frozenset[str]] = []  # the kinds of part around each node
    for k, n in enumerate(nodes):
        parent = nodes[n.parent].tag if n.parent >= 0 else "-"
        f = ["any", f"tag={n.tag}", f"in={parent}>{n.tag}"]
        own = name_words(n.names) if n.names else ()
        f += [f"name={w}" for w in own] if n.names else ["unnamed"]
        around = within[n.parent] if n.parent >= 0 else frozenset()
        f += [f"within={kind}" for kind in around]
        kinds = {KIND_OF[w] for w in own if w in KIND_OF}
        if n.tag in KIND_OF_TAG:
            kinds.add(KIND_OF_TAG[n.tag])
        within.append(around | kinds)
        f += [f"is={kind}" for kind in kinds]
        f.append(f"own={min(5, n.chars.bit_length() // 2)}")
        f.append(f"all={min(6, chars[k].bit_length() // 2)}")
        f.append(f"share={int(4 * chars[k] / everything)}")
        f.append(f"links={int(4 * links[k] / chars[k])}" if chars[k] else "empty")
        f.append(f"children={min(4, children[k].bit_length())}")
        if n.blocks:
            text = page.blocks[n.blocks[-1]][1]
            f.append("ends=" + ("stop" if text[-1] in ".!?…:\"”" else "other"))
        out.append(f)
    return out


def article_labels(page: Page) -> np.ndarray | None:
    """Labels by the page's own ``article`` element; None without one."""
    labels = np.zeros(len(page.nodes), np.int64)
    for k, n in enumerate(page.nodes):
        inside = n.tag == "article" or (n.parent >= 0 and labels[n.parent] == 1)
        labels[k] = inside and n.tag not in NOT_CONTENT_TAGS and not (name_words(n.names) & _PART_NAMES)
    return labels if any(n.tag == "article" for n in page.nodes) else None


def layout(rng: random.Random, paragraphs: list[str], phrases: list[str]) -> str:
    """A page whose content nodes carry the attribute ``y``: the paragraphs in
    a random layout, with other parts around and inside."""
    def words(n: int) -> str:
        return html.escape(" ".join(rng.choice(phrases).split()[:n]))

    def link() -> str:
        return f'<a href="/{rng.randint(1, 99)}">{words(rng.randint(1, 4))}</a>'

    def part(kind: str) -> str:
        tag = PART_TAGS.get(kind, "div") if rng.random() < 0.4 else rng.choice(["div", "section", "ul", "div"])
        name = rng.choice(PARTS[kind]) if tag in ("div", "section", "ul") or rng.random() < 0.5 else ""
        attribute = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
        if kind in ("menu", "share") or (kind in ("footer", "sidebar", "header") and rng.random() < 0.5):
            inner = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 7)))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f"<label>{words(3)}</label><input name=q><button>{words(1)}</button>"
            inner = inner if tag == "form" else f"<form>{inner}</form>"
        elif kind == "comments":
            one = rng.choice(["comment", "reply", "comment-body"])
            wrap = rng.choice(['<div class="%s"><p>%s</p></div>', '<li class="%s">%s</li>', "<p class=%s>%s</p>",
                               "<!-- %s --><p>%s</p>", '<article class="%s"><p>%s</p></article>'])
            inner = (f"<h3>{words(2)}</h3>" if rng.random() < 0.6 else "") + "".join(
                wrap % (one, html.escape(rng.choice(phrases))) for _ in range(rng.randint(1, 5)))
        else:
            text = html.escape(rng.choice(phrases))
            inner = rng.choice([text, f"<p>{text}</p>", f"<p>{words(12)}</p><p>{link()}</p>", f"&copy; {words(6)}"])
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def block(text: str) -> str:
        kind = rng.random()
        text = html.escape(text)
        if kind < 0.75:
            return f"<p y>{text}</p>"
        if kind < 0.83:
            return f"<blockquote y><p y>{text}</p></blockquote>"
        if kind < 0.91:
            return f"<ul y><li y>{text}</li></ul>"
        return f"<h2 y>{words(5)}</h2><p y>{text}</p>"

    kinds = list(PARTS)
    inside = []
    for p in paragraphs:
        inside.append(block(p))
        if rng.random() < 0.08:
            inside.append(part(rng.choice(["advert", "sidebar", "share", "notice", "form"])))
    if rng.random() < 0.3:
        inside.append(part("comments"))
    title = f"<h1 y>{words(8)}</h1>" if rng.random() < 0.8 else ""
    if rng.random() < 0.05:  # text without any markup
        return html.escape(" ".join(paragraphs)) if rng.random() < 0.5 else "".join(map(block, paragraphs))
    tag = rng.choice(["article", "div", "div", "main", "section"])
    name = f' class="{rng.choice(ARTICLE)}"' if tag not in ("article", "main") or rng.random() < 0.5 else ""
    body = f"<{tag}{name} y>{title}{''.join(inside)}</{tag}>"
    if rng.random() < 0.4:
        body = f'<div class="{rng.choice(["wrapper", "container", "page", "row"])}">{body}{part("sidebar")}</div>'
    before = "".join(part(k) for k in rng.sample(kinds, rng.randint(1, 4)) if k != "comments")
    after = "".join(part(k) for k in rng.sample(kinds, rng.randint(1, 4)))
    return (f"<html><head><title>{words(8)}</title></head><body>{part('menu') if rng.random() < 0.7 else ''}"
            f"{before}{body}{after}</body></html>")


def labelled_layout(source: str) -> tuple[Page, np.ndarray]:
    """The parsed page, without the ``y`` marks, and the labels they gave."""
    marked = re.sub(r"<(\w+)((?: [a-z]+=\"[^\"]*\")*) y>",
                    lambda m: f'<{m[1]} class="{MARK}{" " + m[2].split(chr(34))[1] if m[2] else ""}">', source)
    page = parse(marked)
    labels = np.array([int(MARK in n.names) for n in page.nodes], np.int64)
    labels[0] = int(bool(page.nodes[0].blocks))  # bare text is the page's content
    for n in page.nodes:
        n.names = n.names.replace(MARK, "").strip()
    return page, labels


MARK = "y0y"


class PageModel:
    """Weights by feature name, and the parent-child potentials."""

    def __init__(self, weights: dict[str, float], edge: np.ndarray):
        self.number = {f: k for k, f in enumerate(weights)}
        self.weights = np.array(list(weights.values()))
        self.edge = edge

    def forest(self, pages: list[Page]) -> Forest:
        parents, features, shift = [], [], 0
        get = self.number.get
        for page in pages:
            parents += [n.parent + shift if n.parent >= 0 else -1 for n in page.nodes]
            features += [[c for c in map(get, f) if c is not None] for f in node_features(page)]
            shift += len(page.nodes)
        return Forest(np.array(parents, np.int64), features)

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """P(content) of the nodes of each page."""
        if not pages:
            return []
        forest = self.forest(pages)
        one, _, _ = marginals(forest, forest.scores(self.weights), self.edge)
        return np.split(one, np.cumsum([len(p.nodes) for p in pages])[:-1])

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [parse(s or "") for s in sources]
        return ["\n".join(text for node, text in page.blocks if one[node] >= 0.5)
                for page, one in zip(pages, self.content(pages))]


def fit(pages: list[tuple[Page, np.ndarray]]) -> PageModel:
    """A model from labelled pages; features on fewer than 3 nodes are left out."""
    counts: dict[str, int] = {}
    for page, _ in pages:
        for f in node_features(page):
            for name in f:
                counts[name] = counts.get(name, 0) + 1
    model = PageModel({f: 0.0 for f, n in counts.items() if n >= 3}, np.zeros((2, 2)))
    labels = np.concatenate([y for _, y in pages])
    model.weights, model.edge = train(model.forest([p for p, _ in pages]), labels, len(model.number))
    return model


def labelled_pages(sources: list[str], seed: int = 7) -> list[tuple[Page, np.ndarray]]:
    """Training pages from sampled sources: those with an ``article`` element
    as they are, and their text in made layouts."""
    rng, out, paragraphs = random.Random(seed), [], []
    for source in sources:
        page = parse(source)
        labels = article_labels(page)
        if labels is not None:
            out.append((page, labels))
            own = [text for node, text in page.blocks if labels[node]]
        else:
            own = [text for _, text in page.blocks if len(text) > 80]
        paragraphs.append(own or ["A page without an article."])
    paragraphs = paragraphs or [["The river rose in the night.", "By noon the road to the mill was under water."]]
    phrases = [p for own in paragraphs for p in own][:5000]
    for own in paragraphs:
        for _ in range(LAYOUTS_PER_PAGE):
            some = [rng.choice(own)[:rng.choice([60, 200, 1000])] for _ in range(rng.randint(1, 12))]
            out.append(labelled_layout(layout(rng, some, phrases)))
    return out


def train_model(pages: DataFrame, id_col: str = "page_id", html_col: str = "html",
                sample_pages: int = SAMPLE_PAGES) -> PageModel:
    """A model from ``sample_pages`` expected pages, drawn by a hash of the id
    and of ``SAMPLE_CHARS`` characters at most."""
    some = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).cast("string").alias("html"))
    n = some.count()
    drawn = F.pmod(F.xxhash64("id", F.lit("pages")), F.lit(1_000_000)) / 1_000_000.0
    rows = (some.where((drawn < min(1.0, sample_pages / max(1, n))) & (F.length("html") <= SAMPLE_CHARS))
            .collect())
    return fit(labelled_pages([r["html"] for r in sorted(rows, key=lambda r: (r["id"] or "", r["html"]))]))


def extract(pages: DataFrame, model: PageModel, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text string (main text, its
    blocks joined by a line feed; empty if none), n_chars long.

    Null and empty html have no text. Null ids and urls stay; repeated rows
    give repeated results; an empty table gives no rows; other columns are
    ignored."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                          text_bytes(html_col).alias("data"))
    id_type = picked.schema["page_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in it:
            for k in range(0, whole.num_rows, 64):
                b = whole.slice(k, 64)
                texts = model.texts([None if t is None else t.decode("utf-8", "replace")
                                     for t in b.column(2).to_pylist()])
                schema = pa.schema([whole.schema.field(0), whole.schema.field(1),
                                    ("text", pa.string()), ("n_chars", pa.int64())])
                yield from batches(schema, [[b.column(0), b.column(1), texts, list(map(len, texts))]])

    return picked.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
