"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks, the stretches of text between block-level tags, in page order. Each block is described
by its ancestors' tags, classes, ids and roles and by its text; a chain of two labels, text of the article or not, is
decoded by Viterbi. The weights are learned from labelled pages: pages of the corpus whose own mark-up names one article
(a bounded sample), and pages of other layouts that are made of the sample's paragraphs.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from siftmill.llm import crf
from siftmill.llm.common import table

#: Fixed values of HTML: elements that end a block, elements whose content is no text of the page, elements without content.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table
    tbody td tfoot th thead title tr ul""".split()
)
RAW_TAGS = ("script", "style", "template", "iframe", "svg", "textarea", "noembed", "noframes")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What is never closed runs to the end, so that no part of a page is scanned twice.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW_TAGS)})\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>=]++|=\s*+\"[^\"]*+(?:\"|\Z)|=\s*+'[^']*+(?:'|\Z)|=)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
MARKED = re.compile(r"\bdata-label\s*=\s*\"?([01])")
SECTIONS = frozenset("article aside dialog footer form header main nav section".split())
NAME_PART = re.compile(r"[a-z]+")
WORD = re.compile(r"[^\W\d_]+")
#: Words of a class or id that tell what a part of a page is for; others are described by themselves only.
ENDS = re.compile(r"[.!?…]['\"»”)]*$")
LEGAL = re.compile(r"©|copyright|all rights reserved|cookie|privacy|subscribe|newsletter|sign up|log in|advert|sponsored|share|comment|repl(?:y|ies)", re.I)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that their own kind closes.
ALIKE = frozenset("li dd dt option td th tr".split())


@dataclass
class Block:
    """A leaf block: its text, the characters of it inside links, its features from the ancestors, and its label if marked."""

    text: str
    linked: int
    above: frozenset
    label: int | None


@dataclass
class Level:
    """An open element: its own features, those of the innermost one that says what it is for, and the heading above it."""

    tag: str
    own: frozenset
    label: int | None
    near: frozenset = frozenset()
    heading: tuple[str, ...] = ()


def opened(tag: str, attributes: str, parent: Level) -> Level:
    found = {f"in:{tag}"}
    for kind, *values in NAMED.findall(attributes) if "=" in attributes else ():
        value = next((v for v in values if v), "").lower()
        found |= {f"role:{value}"} if kind.lower() in ("role", "itemprop") else {f"name:{p}" for p in NAME_PART.findall(value)}
    mark = MARKED.search(attributes) if "data-label" in attributes else None
    near = frozenset("near " + f for f in found) if len(found) > 1 or tag in SECTIONS else parent.near
    return Level(tag, frozenset(found), int(mark[1]) if mark else parent.label, near, parent.heading)


def few_words(text: str, most: int) -> tuple[str, ...]:
    """The distinct lower-cased words of a short text; of a longer one none."""
    return tuple(sorted(set(WORD.findall(text.lower())))) if text.count(" ") < most else ()


def blocks(page: str | None, label: int | None = None) -> list[Block]:
    """The leaf blocks of a whole page; broken mark-up never fails, an unclosed comment or script runs to the end.

    Elements may be nested to any depth. ``label`` is that of blocks inside no marked element.
    """
    out: list[Block] = []
    stack = [Level("", frozenset(), label)]
    held: Counter[str] = Counter()  # features of the open elements, and how many of these have them
    open_tags: Counter[str] = Counter()
    above: frozenset | None = frozenset()
    pieces: list[str] = []
    links, linked, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked, above
        text = "".join(pieces)
        pieces.clear()
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            top = stack[-1]
            if above is None:
                above = frozenset(held)
            out.append(Block(text, min(linked, len(text)), above | top.near | {f"tag:{top.tag}", *(f"under:{w}" for w in top.heading)}, top.label))
            if top.tag in HEADINGS:
                stack[-2].heading = few_words(text, 5)
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        linked += len(text) if links else 0

    def close(k: int) -> None:
        nonlocal above
        for level in stack[k:]:
            open_tags[level.tag] -= 1
            for f in level.own:
                if held[f] == 1:
                    del held[f]
                else:
                    held[f] -= 1
        del stack[k:]
        above = None

    page = page or ""
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m["end"] else 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            links = 0
            if m["end"]:
                if open_tags[tag]:
                    close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            elif tag not in VOID_TAGS:
                inside = stack[-1].tag
                if inside == "p" or inside in HEADINGS or (inside == tag and tag in ALIKE):
                    close(len(stack) - 1)
                stack.append(opened(tag, m["attr"], stack[-1]))
                open_tags[tag] += 1
                held.update(stack[-1].own)
                above = None
    add(page[at:])
    flush()
    return out


def described(found: list[Block]) -> list[list[str]]:
    """The features of each block of a page."""
    out = []
    for k, b in enumerate(found):
        n, words = len(b.text), b.text.count(" ") + 1
        out.append([
            *b.above,
            *(f"says:{w}" for w in few_words(b.text, 6)),
            f"chars:{n.bit_length()}",
            f"words:{min(words.bit_length(), 9)}",
            f"links:{round(4 * b.linked / n)}",
            f"ends:{bool(ENDS.search(b.text))}",
            f"stops:{min(b.text.count('. ') + b.text.count(', '), 5)}",
            f"upper:{b.text[0].isupper()}",
            f"legal:{words < 60 and bool(LEGAL.search(b.text))}",
            f"place:{4 * k // len(found)}",
            f"alone:{len(found) == 1}",
        ])
    return out


def own_label(b: Block) -> int:
    """The label that a page with one article gives its blocks by its own mark-up."""
    inside = "in:article" in b.above or "in:main" in b.above
    apart = b.above & {"in:nav", "in:aside", "in:footer", "in:form", "in:button", "name:comments", "name:comment", "name:ad", "name:ads", "name:sidebar", "name:share", "name:related"}
    return int(inside and not apart)


#: Names that pages give their parts, by what the part is for, and what stands over such a part.
PARTS = {
    "menu": (("nav", "div", "ul", "header"), "nav navbar menu navigation breadcrumb breadcrumbs topbar toolbar links".split()),
    "header": (("header", "div"), "header masthead branding logo tagline top".split()),
    "footer": (("footer", "div", "p"), "footer copyright colophon legal bottom imprint".split()),
    "sidebar": (("aside", "div", "section"), "sidebar widget rail secondary aside complementary".split()),
    "notice": (("div", "section", "aside", "p", "dialog", "dialog", "dialog"), "notice cookie consent gdpr alert popup modal overlay message dialog paywall".split()),
    "advert": (("div", "section", "aside"), "ad ads advert advertisement sponsored sponsor promo banner partner partners outbrain taboola dfp affiliate".split()),
    "form": (("form", "div"), "form search newsletter subscribe signup login contact".split()),
    "comments": (("section", "div", "ol"), "comments comment replies reply respond discussion disqus reviews review opinions opinion feedback responses".split()),
    "related": (("div", "section", "ul", "aside"), "related recommended more popular trending tags share social".split()),
}
TITLES = {
    "comments": ("Comments", "Reader reviews", "Reviews", "Opinions", "What readers say", "Your opinion", "Bewertungen", "Avis", "Opiniones", "3 comments", "12 Comments", "Leave a reply", "Leave a comment", "Replies", "Responses", "Discussion", "Join the discussion", "Reader comments", "Kommentare", "Kommentar schreiben", "Commentaires", "Laisser un commentaire", "Comentarios", "Deja un comentario"),
    "related": ("Related articles", "Related", "You may also like", "Read more", "Read next", "Most read", "Popular", "More stories", "Recommended", "Share", "Tags", "Mehr zum Thema", "Lesen Sie auch", "À lire aussi", "Artículos relacionados"),
    "sidebar": ("About", "Archive", "Categories", "Recent posts", "Follow us", "Archiv", "Kategorien", "Archives", "Categorías"),
    "advert": ("Advertisement", "Sponsored", "Anzeige", "Werbung", "Publicité", "Publicidad"),
    "form": ("Newsletter", "Subscribe", "Sign up", "Log in", "Search", "Contact", "Anmelden", "Suche", "Inscription", "Suscríbete"),
    "notice": ("We use cookies", "Cookie settings", "Privacy", "Wir verwenden Cookies", "Nous utilisons des cookies", "Usamos cookies"),
}
MAIN = (("article", "main", "div", "section", "td"), "content article post entry story main body text page".split())
INSIDE = ("advert", "related", "comments", "form", "notice", "sidebar", "footer", "menu")


def made_page(paragraphs: list[str], rng: np.random.Generator) -> tuple[str, int]:
    """A labelled page of random layout, and the label of what no element marks.

    Parts stand around and inside the article, named as pages name theirs, by names that tell nothing, or not at all;
    some pages are text only, or paragraphs without any element around them.
    """
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    text = lambda: html.escape(pick(paragraphs))
    short = lambda: html.escape(" ".join(pick(paragraphs).split()[: int(rng.integers(1, 7))]))
    blind = rng.random() < 0.3  # names tell nothing

    def named(tag: str, names: list[str], inner: str, label: int, plain: float = 0.0) -> str:
        if blind:
            tag = "div" if tag in ("article", "main", "section", "aside", "header", "footer") else tag
            attribute = pick(("", ' class="c{}"', ' class="css-{}x"', ' id="b{}"', ' class="col-{} row"')).format(int(rng.integers(1, 99)))
        else:
            kind = pick(("class", "class", "id"))
            attribute = "" if rng.random() < (0.7 if tag == "dialog" else plain) else f' {kind}="{pick(("", "", "site-", "main-", "block "))}{pick(names)}"'
        inner = f"<div>{inner}</div>" if rng.random() < 0.15 else inner
        return f'<{tag}{attribute} data-label="{label}">{inner}</{tag}>'

    def part(kind: str) -> str:
        tags, names = PARTS[kind]
        tag = pick(tags)
        heading = pick(("h2", "h3", "h4"))
        over = f"<{heading}>{pick(TITLES[kind])}</{heading}>" if kind in TITLES and (blind or rng.random() < 0.6) else ""
        if kind in ("menu", "related"):
            inner = over + "".join(f'<{pick(("li", "div"))}><a href="/x">{short()}</a>' for _ in range(int(rng.integers(2, 7))))
        elif kind in ("footer", "header"):
            inner = pick(("&copy; ", "&copy; 2020 ", "" if not blind else "Copyright ")) + short() + pick(("", f"<p>{text()}</p>" if not blind else ""))
        elif kind == "form":
            inner = over + f"<label>{short()}</label><input name=q><button>{short()}</button>" + pick(("", f"<p>{text()}</p>"))
        elif kind == "comments":
            one = pick(('<div class="comment"><p>{}</p></div>', "<p>{}</p>", "<li><b>{}</b> <p>{}</p>", "<div>{}</div>", '<div class="comment"><h4>{}</h4><p>{}</p></div>'))
            over = over or (f"<h3>{short()}</h3>" if rng.random() < 0.5 else "")
            inner = over + "".join(one.format(*[short()] * (one.count("{}") - 1), text()) for _ in range(int(rng.integers(1, 5))))
        else:
            inner = over + "".join(f"<p>{text()}</p>" for _ in range(int(rng.integers(1, 3)))) + pick(("", f"<button>{short()}</button>"))
        return named(tag, names, inner, 0, plain=0.3 if tag in ("nav", "footer", "aside", "form", "header") else 0.0)

    blocks_of_text = [f"<h1>{short()}</h1>" if rng.random() < 0.7 else ""]
    for _ in range(int(rng.integers(2, 8))):
        blocks_of_text.append(pick((f"<p>{text()}</p>",) * 6 + (f"<h2>{short()}</h2><p>{text()}</p>", f"<ul><li>{text()}</li><li>{short()}</li></ul>", f"<blockquote>{text()}</blockquote>", f"<div>{text()}</div>", f"<p>{short()}</p>")))
        if rng.random() < 0.25:
            blocks_of_text.append(part(pick(INSIDE)))
    bare = rng.random()
    if bare < 0.04:
        return "\n\n".join(text() for _ in range(int(rng.integers(1, 5)))), 1
    if bare < 0.1:
        return "".join(b for b in blocks_of_text if "data-label" not in b), 1
    if rng.random() < 0.4:
        blocks_of_text.append(part(pick(("comments", "comments", "related", "form"))))
    tags, names = MAIN
    tag = pick(tags)
    body = named(tag, names, "".join(blocks_of_text), 1, plain=0.5 if tag in ("article", "main") else 0.1)
    before = [part(k) for k in ("header", "menu", "notice", "advert", "form") if rng.random() < 0.5]
    after = [part(k) for k in ("sidebar", "comments", "related", "form", "advert", "menu", "footer") if rng.random() < 0.45]
    title = f"<head><title>{short()}</title></head>" if rng.random() < 0.7 else ""
    return f"{title}<body>{''.join(before)}{body}{''.join(after)}</body>", 0


def filled(paragraphs: list[str], pages: int, seed: int = 11) -> list[tuple[str, int]]:
    """Labelled pages made of the given paragraphs."""
    rng = np.random.default_rng(seed)
    return [made_page(paragraphs, rng) for _ in range(pages if paragraphs else 0)]


@dataclass
class PageModel:
    index: dict[str, int]
    chain: crf.Chain | None

    def ids(self, features: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        get, ids, starts = self.index.get, [], []
        for fs in features:
            starts.append(len(ids))
            ids.append(0)
            ids += [i for f in fs if (i := get(f)) is not None]
        return np.array(ids), np.array(starts)

    def extract(self, pages: list[str | None]) -> list[str]:
        found = [blocks(p) for p in pages]
        lengths = np.array([len(f) for f in found])
        if not lengths.sum() or self.chain is None:
            return [""] * len(pages)
        ids, starts = self.ids([fs for f in found for fs in described(f)])
        real = lengths[lengths > 0]
        labels = iter(crf.viterbi(self.chain, crf.summed(self.chain.weights, ids, starts), real).tolist())
        return ["\n\n".join([b.text for b in f if next(labels)]) for f in found]


def fit(pages: list[str], made: int = 2_000, least_seen: int = 2) -> PageModel:
    """A model from pages of the corpus that have one article, and from as many made pages as given."""
    labelled = []
    for page in pages:
        found = blocks(page)
        if len(re.findall(r"<(?:article|main)\b", page, re.I)) == 1 and found:
            labelled.append((found, [own_label(b) for b in found]))
    paragraphs = [b.text for found, gold in labelled for b, y in zip(found, gold, strict=True) if y and len(b.text) > 40] or ["No page of the sample has an article."]
    for page, rest in filled(sorted(set(paragraphs)), made):
        found = blocks(page, rest)
        labelled.append((found, [b.label or 0 for b in found]))
    seen = Counter(f for found, _ in labelled for fs in described(found) for f in fs)
    index = {f: k + 1 for k, f in enumerate(sorted(f for f, n in seen.items() if n >= least_seen))}
    model = PageModel(index, None)
    ids, starts = model.ids([fs for found, _ in labelled for fs in described(found)])
    gold = np.array([y for _, ys in labelled for y in ys])
    model.chain = crf.fit(ids, starts, gold, np.array([len(ys) for _, ys in labelled]), len(index) + 1, 2, epochs=30, batch=32)
    return model


def learn(pages: DataFrame, sample: int = 300, longest: int = 200_000, id_col: str = "page_id", html_col: str = "html") -> PageModel:
    """A model from at most ``sample`` pages, the first by a hash of the id.

    Pages of over ``longest`` characters are not taken to learn from, so that what comes to the driver is bounded; an id
    that occurs repeatedly teaches once.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter(F.col("html").isNotNull() & (F.length("html") <= longest))
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
    once = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by("html", F.xxhash64("html")).alias("html"))
    return fit([r["html"] for r in once.orderBy("id").collect()])


def extracted(pages: DataFrame, model: PageModel, html_col: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text: blocks of the article in page order, joined by blank lines.

    Null and empty pages, and pages without article text, give an empty text. References are decoded once, white space
    inside a block becomes one space; nothing is dropped from a block and no page is cut. Repeated rows are each read.
    """

    @pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.extract(texts.where(texts.notna(), None).tolist()), dtype=object)

    return pages.withColumn(into, extract(F.col(html_col)))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extracted(pages, learn(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
