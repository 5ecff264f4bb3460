"""Main text of HTML pages: boosted trees over the nodes of a page, decoded along its tree.

A page becomes a tree of its block elements, with each run of inline text a leaf. A node's features are its subtree's
text, link share and density, attribute tokens of itself and its ancestors, depth, place, and what its siblings are like.
The trees give each node the odds of holding main text; the labelling of the whole page with the best likelihood is taken
under the rule that below a node without main text there is none (one pass up, one pass down).

The model is trained here on TRAIN_PAGES pages at most, of at most TRAIN_LENGTH code points (lowest hash of the url and id first), whose own markup names the main
part, as they are and in variants without such names: element names turn into ``div``, class names change or go, and
comment lists, notices and side bars made of other pages' sentences are put in. All pages are then read where they lie,
without a shuffle; the model is a few kilobytes.

A null or empty page, or one without main text, gives an empty text. Markup may be broken: what isn't closed ends with its parent.
Rows with one id are separate pages. Without a page to train on, markup alone decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csilake.llm.common import lowest, table

TRAIN_PAGES = 200
#: Code points above which a page isn't one to train on; it is read whole like any other.
TRAIN_LENGTH = 200_000
TREES, LEVELS, BINS, RATE = 40, 4, 32, 0.25

# What elements and attribute tokens usually stand for.
SKIPPED = frozenset("script style noscript template iframe svg math object embed canvas audio video select datalist button textarea title head".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meta link q ruby rp rt s samp small span strike strong sub sup time tt u var wbr picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OTHER_TAGS = frozenset("nav footer aside header form menu dialog fieldset".split())
MAIN_TAGS = frozenset("article main".split())
OTHER_TOKENS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies copyright dialog disclaimer discussion disqus "
    "footer form gdpr header masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion recommended related replies reply reader "
    "respond search share sharing sidebar signup side social sponsor sponsored subscribe tags toolbar topbar widget login alert feedback teaser".split()
)
MAIN_TOKENS = frozenset("article articlebody body content entry main maincontent post postcontent story text prose".split())
HEAD_TAGS = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
FOREIGN = frozenset("svg math".split())
#: Short texts that announce what readers wrote.
REPLIES = re.compile(
    r"\W*(?:\d+\W+)?(?:(?:reader|user)s?\W+)?(?:comments?|repl(?:y|ies)|responses?|kommentare?|antworten|commentaires?|réponses?|comentarios?|respuestas?)(?:\W+\d+)?\W*|\W*\d+\W+(?:thoughts|opinions|messages|discussions?)\W*",
    re.IGNORECASE,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element of the first kind ends an open one of the second, up to the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?""", re.DOTALL)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")


@dataclass
class Page:
    """Nodes in page order, each after its parent; leaves (tag ``#text``) hold a block's text and the length of its links."""

    tag: list[str] = field(default_factory=lambda: ["#page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    tokens: list[frozenset] = field(default_factory=lambda: [frozenset()])
    text: list[str] = field(default_factory=lambda: [""])
    links: list[int] = field(default_factory=lambda: [0])

    def add(self, tag: str, parent: int, tokens: frozenset = frozenset(), text: str = "", links: int = 0) -> int:
        for values, value in ((self.tag, tag), (self.parent, parent), (self.tokens, tokens), (self.text, text), (self.links, links)):
            values.append(value)
        return len(self.tag) - 1


def names_of(attributes: str) -> frozenset:
    """Lower-case words of class, id and role."""
    return frozenset(x.lower() for m in NAMES.finditer(attributes) for x in PARTS.findall(m[1])) if "=" in attributes else frozenset()


def parse(html: str) -> Page:
    page, open_, skip = Page(), [0], 0
    pieces: list[str] = []
    linked, in_link = 0, False
    at, n = 0, len(html)
    low = html.lower() if "<" in html else ""
    # a control that is never closed ends with the next block
    last_end = {tag: low.rfind(f"</{tag}") for tag in ("button", "select", "datalist")}
    loose = -1

    def flush() -> None:
        nonlocal linked, in_link
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.add("#text", open_[-1], text=text, links=min(linked, len(text)))
            pieces.clear()
        linked, in_link = 0, False

    def leave_head() -> None:
        if page.tag[open_[-1]] == "head":
            close_to(len(open_) - 1)

    def say(raw: str) -> None:
        nonlocal linked
        if skip and page.tag[open_[-1]] == "head" and not raw.isspace() and raw:
            leave_head()
        if raw and not skip:
            raw = unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if in_link:
                linked += len(raw)

    def close_to(place: int) -> None:
        nonlocal skip
        flush()
        while len(open_) > place:
            skip -= page.tag[open_.pop()] in SKIPPED

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if not closing and tag not in HEAD_TAGS:
            leave_head()
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                say(" ")
            continue
        if closing:
            for place in range(len(open_) - 1, 0, -1):
                if page.tag[open_[place]] == tag:
                    close_to(place)
                    break
            continue
        flush()
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
            continue
        if tag in VOID or (attributes.endswith("/") and (tag in FOREIGN or any(page.tag[i] in FOREIGN for i in open_))):
            continue
        if loose >= 0 and tag not in ("option", "optgroup"):
            if loose in open_:
                close_to(open_.index(loose))
            loose = -1
        if tag == "body":
            close_to(1)
        ends, limit = CLOSES.get(tag, (set(), set()))
        for place in range(len(open_) - 1, 0, -1):
            known = page.tag[open_[place]]
            if known == "p" or known in ends:
                close_to(place)
                break
            if known in limit or not ends:
                break
        open_.append(page.add(tag, open_[-1], names_of(attributes)))
        skip += tag in SKIPPED
        if last_end.get(tag, n) < at:
            loose = open_[-1]
    flush()
    return page


def numbers(pages: list[Page]) -> np.ndarray:
    """A row of features for each node of the pages, one after the other."""
    starts = np.cumsum([0, *(len(x.tag) for x in pages)])
    root = np.repeat(starts[:-1], np.diff(starts))
    tag = [t for x in pages for t in x.tag]
    text = [t for x in pages for t in x.text]
    up = [max(p, 0) + int(at) for x, at in zip(pages, starts, strict=False) for p in x.parent]
    top = [p < 0 for x in pages for p in x.parent]
    tokens = [k for x in pages for k in x.tokens]
    other = [(t in OTHER_TAGS) + len(k & OTHER_TOKENS) for t, k in zip(tag, tokens, strict=True)]
    main = [(t in MAIN_TAGS) + len(k & MAIN_TOKENS) for t, k in zip(tag, tokens, strict=True)]
    size = [len(x) for x in text]
    own, longest = np.array(size, dtype=float), size.copy()
    links = [x for page in pages for x in page.links]
    stops = [x.count(".") + x.count(",") + x.count("?") + x.count("!") for x in text]
    n = len(tag)
    before = np.cumsum(own) - own
    depth, others, mains, below, children, place = [0] * n, other.copy(), main.copy(), [0] * n, [0] * n, [0] * n
    kinds: dict[tuple[int, str], int] = {}
    announces = [t == "#text" and len(x) < 60 and REPLIES.fullmatch(x) is not None for t, x in zip(tag, text, strict=True)]
    # what comes after such a text in its block, or in the block that its heading stands in
    heard, told = [False] * n, [False] * n
    for i in range(n):
        if not top[i]:
            p = up[i]
            depth[i], others[i], mains[i] = depth[p] + 1, others[p] + other[i], mains[p] + main[i]
            place[i] = children[p]
            children[p] += 1
            told[i] = told[p] or heard[p]
            if announces[i]:
                heard[p] = heard[up[p]] = True
        kinds[up[i], tag[i]] = kinds.get((up[i], tag[i]), 0) + 1
    for i in range(n - 1, -1, -1):
        if not top[i]:
            p = up[i]
            size[p] += size[i]
            links[p] += links[i]
            stops[p] += stops[i]
            below[p] += below[i] + 1
            longest[p] = max(longest[p], longest[i])
    alike = np.array([kinds[p, t] for p, t in zip(up, tag, strict=True)])
    size, links, stops, below, children, place, up = (np.array(x, dtype=np.int64) for x in (size, links, stops, below, children, place, up))
    mates = np.maximum(children[up], 1)
    share = links / np.maximum(size, 1)
    total = np.maximum(size[root], 1)
    heading, item, para = (np.array([t in x for t in tag]) for x in (HEADINGS, {"li"}, {"p"}))
    return np.column_stack(
        [depth, np.log1p(size), share, np.log1p(size / (1 + below)), np.log1p(own), np.array(other) > 0, np.array(main) > 0]
        + [np.minimum(others, 3), np.minimum(mains, 3), size / total, np.log1p(mates), place / mates, alike / mates, [t == "#text" for t in tag]]
        + [heading, heading[up], item[up], para[up], np.log1p(size[up] / mates), stops / np.maximum(size, 1), share[up]]
        + [(before - before[root]) / total, np.log1p(longest), np.log1p(below), announces, told]
    ).astype(np.float32)


@dataclass
class Boosted:
    """Trees of LEVELS levels over binned features: per inner node a feature and a bin, per leaf a value."""

    edges: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def odds(self, rows: np.ndarray) -> np.ndarray:
        binned = np.column_stack([np.searchsorted(e, rows[:, k]) for k, e in enumerate(self.edges)]).astype(np.int16)
        out, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, limit, value in zip(self.feature, self.bin, self.value, strict=True):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(LEVELS):
                at = 2 * at + 1 + (binned[every, feature[at]] > limit[at])
            out += value[at - len(feature)]
        return out


def boost(rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Boosted:
    """Gradient boosting of the logistic loss, by histograms."""
    edges = np.array([np.quantile(rows[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(rows.shape[1])])
    binned = np.column_stack([np.searchsorted(e, rows[:, k]) for k, e in enumerate(edges)])
    inner, score = 2**LEVELS - 1, np.zeros(len(rows))
    model = Boosted(edges, *(np.zeros((TREES, k), dtype=t) for k, t in ((inner, np.int64), (inner, np.int64), (inner + 1, float))))
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (label - p), weight * np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(rows), dtype=np.int64)
        for level in range(LEVELS):
            first, many = 2**level - 1, 2**level
            best = np.full(many, -np.inf)
            node = at - first
            for k in range(rows.shape[1]):
                cell = node * BINS + binned[:, k]
                sums = [np.cumsum(np.bincount(cell, weights=w, minlength=many * BINS).reshape(many, BINS), axis=1) for w in (g, h)]
                (gl, hl), (gt, ht) = sums, [s[:, -1:] for s in sums]
                gain = np.where((hl > 1e-3) & (ht - hl > 1e-3), gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1), 0)
                top = gain.argmax(axis=1)
                better = gain[np.arange(many), top] > best
                best = np.where(better, gain[np.arange(many), top], best)
                model.feature[tree, first : first + many][better] = k
                model.bin[tree, first : first + many][better] = top[better]
            f, b = model.feature[tree][at], model.bin[tree][at]
            at = 2 * at + 1 + (binned[np.arange(len(rows)), f] > b)
        end = at - inner
        total = [np.bincount(end, weights=w, minlength=inner + 1) for w in (g, h)]
        model.value[tree] = RATE * total[0] / (total[1] + 1)
        score += model.value[tree][end]
    return model


def decode(page: Page, odds: np.ndarray) -> list[int]:
    """Leaves with main text under the likeliest labelling in which nothing lies below a node without any."""
    parent, n = page.parent, len(page.tag)
    plus, minus = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    yes, no = plus.copy(), minus.copy()
    for i in range(n - 1, 0, -1):
        yes[parent[i]] += max(yes[i], no[i])
        no[parent[i]] += no[i]
    holds = np.zeros(n, dtype=bool)
    holds[0] = True
    for i in range(1, n):
        holds[i] = holds[parent[i]] and yes[i] > no[i]
    return [i for i in range(n) if holds[i] and page.tag[i] == "#text"]


def marked(page: Page) -> np.ndarray | None:
    """Which nodes hold main text by the page's own markup; None if it doesn't name a main part."""
    n = len(page.tag)
    inside, outside = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for i in range(1, n):
        p, tag, tokens = page.parent[i], page.tag[i], page.tokens[i]
        inside[i] = inside[p] or tag in MAIN_TAGS
        headline = tag == "header" and inside[p]
        outside[i] = outside[p] or (tag in OTHER_TAGS and not headline) or bool(tokens & OTHER_TOKENS and not headline)
    truth = np.array([t == "#text" for t in page.tag]) & inside & ~outside
    if not truth.any():
        return None
    for i in range(n - 1, 0, -1):
        truth[page.parent[i]] |= truth[i]
    return truth


def variant(page: Page, truth: np.ndarray, others: list[str], rng: np.random.Generator) -> tuple[Page, np.ndarray]:
    """The page with other names for its parts, and with parts added that hold other pages' sentences."""
    tell, out, label, place = rng.random() < 0.6, Page(), [bool(truth[0])], {0: 0}
    names = {True: sorted(MAIN_TOKENS), False: sorted(OTHER_TOKENS)}
    some = lambda yes: frozenset([names[yes][rng.integers(len(names[yes]))]])

    def put(*node, yes: bool) -> int:
        label.append(yes)
        return out.add(*node)

    def sentence() -> str:
        return " ".join(others[rng.integers(len(others))].split(" ")[: rng.integers(3, 60)])

    def readers(parent: int) -> None:
        """Remarks of readers in elements without names, under a line that announces them."""
        top = parent if rng.random() < 0.3 else put("div", parent, yes=False)
        line = put(("div", "h2", "h3", "p")[rng.integers(4)], top, yes=False)
        count, word = rng.integers(1, 200), ("replies", "comments", "responses", "Kommentare", "commentaires", "comentarios")[rng.integers(6)]
        put("#text", line, frozenset(), (f"{count} {word}", f"{word.title()} ({count})", word.title())[rng.integers(3)], yes=False)
        for _ in range(rng.integers(1, 8)):
            one = put("div", top, yes=False)
            if rng.random() < 0.7:
                put("#text", put("div", one, yes=False), frozenset(), " ".join(sentence().split(" ")[:2]), yes=False)
            put("#text", put(("p", "div")[rng.integers(2)], one, yes=False), frozenset(), sentence(), yes=False)

    def extra(parent: int) -> None:
        kind = rng.integers(4)
        top = put(*(("aside", parent) if rng.random() < 0.3 else ("div", parent, some(False))), yes=False)
        for _ in range(1 if kind == 0 else rng.integers(1, 8)):
            words = others[rng.integers(len(others))].split(" ")
            words = words[: rng.integers(3, 60)]
            inner = put("div", top, some(False) if rng.random() < 0.4 else frozenset(), yes=False)
            inner = put("p" if kind < 3 else "li", inner, yes=False)
            text = " ".join(words)
            put("#text", inner, frozenset(), text, len(text) if kind == 3 else 0, yes=False)

    def listed(parent: int) -> None:
        """A heading and a list of the article's own."""
        words = sentence().split(" ")[: rng.integers(1, 8)]
        put("#text", put(("h2", "h3")[rng.integers(2)], parent, yes=True), frozenset(), " ".join(words), yes=True)
        top = put(("ul", "ol")[rng.integers(2)], parent, yes=True)
        for _ in range(rng.integers(2, 6)):
            text = " ".join(sentence().split(" ")[: rng.integers(2, 15)])
            put("#text", put("li", top, yes=True), frozenset(), text, yes=True)

    last_main = max(np.flatnonzero(truth[: len(page.tag)]), default=0)
    for i in range(1, len(page.tag)):
        tag, tokens, parent = page.tag[i], page.tokens[i], place[page.parent[i]]
        if tag in MAIN_TAGS or tag in OTHER_TAGS or tokens & (MAIN_TOKENS | OTHER_TOKENS):
            yes = bool(truth[i])
            tag, tokens = ("div", some(yes) if tell else frozenset()) if rng.random() < 0.7 else (tag, tokens)
        if tag in ("body", "div", "article", "main") and rng.random() < 0.25:
            extra(parent)
        place[i] = put(tag, parent, tokens, page.text[i], page.links[i], yes=bool(truth[i]))
        if tag == "p" and truth[i] and rng.random() < 0.1:
            listed(parent)
        if i == last_main and rng.random() < 0.5:
            (extra if rng.random() < 0.5 else readers)(place[page.parent[page.parent[i]]] if page.parent[i] > 0 else parent)
    return out, np.array(label)


def train(pages: DataFrame, limit: int = TRAIN_PAGES) -> Boosted | None:
    known = pages.filter(F.length("html") <= TRAIN_LENGTH).select("url", "page_id", "html")
    rows = lowest(known, ["url", "page_id"], limit).select("html").collect()
    read = [(page, truth) for page in (parse(x.html) for x in rows) if (truth := marked(page)) is not None]
    if not read:
        return None
    rng = np.random.default_rng(7)
    others = [text for page, _ in read for text in page.text if len(text) > 20] or ["more"]
    every = [*read, *(variant(page, truth, others, rng) for page, truth in read for _ in range(4))]
    size = [len(page.tag) for page, _ in every]
    weight = np.repeat(1 / np.sqrt(size), size)
    return boost(numbers([page for page, _ in every]), np.concatenate([t for _, t in every]).astype(float), weight / weight.mean())


def extract(pages: DataFrame, model: Boosted | None) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def texts(htmls: list[str]) -> list[str]:
        read = [parse(x) for x in htmls]
        if shared.value is None:
            named = [marked(x) for x in read]
            return ["\n".join(t for t, yes in zip(p.text, m, strict=True) if yes and t) if m is not None else "" for p, m in zip(read, named, strict=True)]
        ends = np.cumsum([len(x.tag) for x in read])
        odds = shared.value.odds(numbers(read))
        return ["\n".join(page.text[i] for i in decode(page, own)) for page, own in zip(read, np.split(odds, ends[:-1]), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                found = texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract(pages, train(pages))
