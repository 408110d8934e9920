"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text.  A linear classifier gives each block the cost of
calling it content and the cost of calling it boilerplate; these are the capacities from
the source and to the sink.  Blocks next to each other on the page, and blocks that share
a parent element, are joined by smoothness edges.  The minimum cut (by max-flow) is the
cheapest labelling, and the source side is the article.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed vocabularies of the markup language.
#: Their text is code up to the closing tag, or to the end of the page.
CODE_TAGS = ("script", "style")
#: Left out with all they hold where they are closed; else they are elements like any other.
DROPPED_TAGS = frozenset("noscript template textarea svg iframe object canvas select".split())
#: Elements that "/>" closes; elsewhere the slash says nothing.
FOREIGN_TAGS = ("svg", "math")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
#: Opening one of the first closes an open paragraph.
CLOSES_P = BLOCK_TAGS - {"button", "caption", "legend", "option", "body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "title", "summary"}
#: An item closes the open item of its kind, up to the container.
CLOSES_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",), "td": ("tr",), "th": ("tr",)}
AROUND_P = BLOCK_TAGS - {"p"}
GOOD_TAGS = ("article", "main")
BAD_TAGS = ("nav", "header", "footer", "aside", "form", "menu", "button", "dialog", "head", "title", "label", "fieldset")
BAD_NAMES = (
    "nav menu sidebar side footer header banner ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies "
    "consent notice notices alert popup modal newsletter subscribe signup login share sharing social breadcrumb breadcrumbs "
    "comment comments comments-area reply replies respond discussion disqus related recommended widget toolbar pagination pager copyright legal "
    "disclaimer search masthead topbar toc skip form"
).split()
GOOD_NAMES = "article content main post entry story body text articlebody post-content entry-content".split()

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_PLAIN = re.compile(r"[^>=]*+")
_BLANK = re.compile(r"\s*+")
_UNQUOTED = re.compile(r"[^\s>]*+")
_COMMENT_END = re.compile(r"--!?>")
_CODE_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in CODE_TAGS}
_NAMED = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|\bhidden\b(?!\s*=\s*[\"']?(?:false|until))|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT_NAME = re.compile(r"[\s_]+|-+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")

#: Elements deeper than this count as part of the one that holds them.
MAX_DEPTH = 512
N_FEATURES = 27


class BlockOfText:
    """One block: its text, the marks of the elements around it, its parent and length of link text."""

    __slots__ = ("parts", "good", "bad", "named_good", "named_bad", "hidden", "heading", "item", "parent", "linked", "text")

    def __init__(self, frame: "Frame", linked: bool) -> None:
        self.parts: list[str] = []
        self.good, self.bad, self.named_good, self.named_bad, self.hidden = frame.marks
        self.heading, self.item = frame.heading, frame.item
        self.parent, self.linked, self.text = frame.parent, 0, ""


class Frame:
    """An open element and what its ancestors say about its text."""

    __slots__ = ("tag", "marks", "heading", "item", "parent", "number")

    def __init__(self, tag: str, above: "Frame | None", attributes: str, number: int) -> None:
        good, bad, named_good, named_bad, hidden = above.marks if above else (False,) * 5
        in_page = tag in ("html", "body")
        if tag in GOOD_TAGS:
            # Names of the layout around an article say nothing about it.
            good, named_bad = True, False
        if tag in BAD_TAGS:
            bad = True
        if attributes and not in_page:
            hidden = hidden or _HIDDEN.search(attributes) is not None
            for m in _NAMED.finditer(attributes):
                whole = (m[1] or m[2] or m[3] or "").lower()
                names = {whole, *whole.split(), *(_SPLIT_NAME.split(m[1] or m[2] or m[3] or "")), *_SPLIT_NAME.split(whole)}
                named_bad = named_bad or not names.isdisjoint(_BAD)
                named_good = named_good or not names.isdisjoint(_GOOD)
        self.tag, self.marks, self.number = tag, (good, bad, named_good, named_bad, hidden), number
        self.heading = (above.heading if above else False) or (len(tag) == 2 and tag[0] == "h" and tag[1].isdigit())
        self.item = (above.item if above else False) or tag in ("li", "td", "th", "dt", "dd")
        self.parent = above.number if above else 0


_BAD, _GOOD = frozenset(BAD_NAMES), frozenset(GOOD_NAMES)


class Tag(NamedTuple):
    """A tag, comment or declaration of a page; ``name`` is None if it isn't a tag."""

    start: int
    onward: int
    name: str | None = None
    closing: bool = False
    attributes: str = ""
    closed: bool = False


def tags_of(page: str) -> Iterator[Tag]:
    """Tags, comments and declarations in page order, and where the page goes on after each, in linear time.

    That is behind the closing tag for code, else behind the tag itself; nothing inside code or a comment is a tag. A quote
    holds back the end of a tag only where it begins a value and is closed again; without a ">" there is no tag.
    """
    size = len(page)
    last = {c: page.rfind(c) for c in ">\"'"}
    at = 0
    while 0 <= (start := page.find("<", at)) < last[">"]:
        at = start + 1
        m = _NAME.match(page, start)
        if m is None:
            if page.startswith("<!--", start):
                # "<!-->" and "<!--->" are whole comments.
                end = _COMMENT_END.search(page, start + 2 if page[start + 4 : start + 6] in ("->", ">") or page[start + 4 : start + 5] == ">" else start + 4)
                at = end.end() if end else size
                yield Tag(start, at)
            elif page[at : at + 1] in ("!", "?"):
                at = page.index(">", at) + 1
                yield Tag(start, at)
            continue
        end, bare = m.end(), -1
        while True:
            end = _PLAIN.match(page, end).end()
            if end >= size or page[end] == ">":
                break
            end = _BLANK.match(page, end + 1).end()
            quote = page[end : end + 1]
            if quote and quote in "\"'" and last[quote] > end:
                end = page.index(quote, end + 1) + 1
            else:
                end = bare = _UNQUOTED.match(page, end).end()
        if end >= size:
            continue
        name, at = m[2].lower(), end + 1
        if not m[1] and name in CODE_TAGS:
            found = _CODE_END[name].search(page, at)
            at = page.find(">", found.end()) + 1 or size if found else size
        yield Tag(start, at, name, bool(m[1]), page[m.end() : end], page[end - 1] == "/" and bare != end)
    if (start := page.find("<!--", at)) >= 0:
        yield Tag(start, size)


def dropped(tags: list[Tag]) -> dict[int, int]:
    """Number of each opening tag whose closed element is left out, and of its closing tag."""
    open_tags: dict[str, list[int]] = {}
    ends = {}
    for k, tag in enumerate(tags):
        if tag.name not in DROPPED_TAGS:
            continue
        if not tag.closing:
            if not (tag.name in FOREIGN_TAGS and tag.closed):
                open_tags.setdefault(tag.name, []).append(k)
        elif open_tags.get(tag.name):
            ends[open_tags[tag.name].pop()] = k
    return ends


def blocks_of(page: str) -> list[BlockOfText]:
    """Non-empty blocks of text in page order; broken markup never fails, and time is linear in the page."""
    tags = list(tags_of(page))
    ends = dropped(tags)
    stack = [Frame("", None, "", 0)]
    done: list[BlockOfText] = []
    block: BlockOfText | None = None
    links = 0
    at = number = 0

    def text(piece: str) -> None:
        nonlocal block
        if not piece or (block is None and piece.isspace()):
            return
        if block is None:
            block = BlockOfText(stack[-1], links > 0)
        if "&" in piece:
            piece = entities.unescape(piece)
        block.parts.append(piece)
        if links:
            block.linked += len(piece)

    def end() -> None:
        nonlocal block
        if block is not None:
            block.text = _SPACE.sub(" ", "".join(block.parts)).strip()
            if block.text:
                done.append(block)
            block = None

    def close(tag: str, stops) -> None:
        """Close the innermost open ``tag``, unless an element of ``stops`` is open inside it."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return
            if stack[k].tag in stops:
                return

    until = -1
    for place, tag in enumerate(tags):
        if place <= until:
            continue
        text(page[at : tag.start])
        at, name = tag.onward, tag.name
        if name is None:
            continue
        if not tag.closing and (name in CODE_TAGS or place in ends):
            if name not in CODE_TAGS:
                until = ends[place]
                at = tags[until].onward
            text(" ")
            continue
        if tag.closing:
            if name in BLOCK_TAGS:
                end()
            if name == "a":
                links = max(0, links - 1)
            close(name, () if name in BLOCK_TAGS else BLOCK_TAGS)
            continue
        if name in BLOCK_TAGS:
            end()
            # An element left open ends where the next of its kind must begin.
            if name in CLOSES_P:
                close("p", AROUND_P)
            elif name in CLOSES_SELF:
                close(name, CLOSES_SELF[name])
        elif name == "br":
            text(" ")
        if name in VOID_TAGS or (tag.closed and name in FOREIGN_TAGS):
            continue
        if name == "a":
            links += 1
        number += 1
        if len(stack) < MAX_DEPTH:
            stack.append(Frame(name, stack[-1], tag.attributes, number))
    text(page[at:])
    end()
    return done


def block_features(blocks: list[BlockOfText]) -> np.ndarray:
    """Features of each block: its text, the text that its parent holds, the elements around it and their names."""
    x = np.zeros((len(blocks), N_FEATURES))
    words = [b.text.count(" ") + 1 for b in blocks]
    total = sum(words)
    held: dict[int, list[float]] = {}
    for b, n in zip(blocks, words, strict=True):
        # Words of the parent's blocks outside links, words in links, and blocks.
        of = held.setdefault(b.parent, [0.0, 0.0, 0.0])
        share = min(1.0, b.linked / len(b.text))
        of[0] += n * (1 - share)
        of[1] += n * share
        of[2] += 1
    most = max((of[0] for of in held.values()), default=0)
    told = any(b.good for b in blocks)
    for k, (b, n) in enumerate(zip(blocks, words, strict=True)):
        size, of = len(b.text), held[b.parent]
        x[k] = (
            1,
            b.good,
            b.bad,
            b.named_good and not b.named_bad,
            b.named_bad,
            b.hidden,
            b.heading,
            b.item,
            min(1.0, b.linked / size),
            b.linked * 2 > size,
            n >= 10,
            n >= 40,
            n <= 3,
            b.text[-1] in ".!?:\"”",
            "©" in b.text or "cookie" in b.text.lower(),
            np.log1p(n) / 5,
            min(1.0, 5 * sum(map(b.text.count, ".,;:!?")) / n),
            of[0] / (1 + most),
            of[0] * 4 > total,
            of[1] > of[0],
            np.log1p(of[0]) / 7,
            min(1.0, of[2] / 10),
            of[2] == 1,
            k * 4 < len(blocks),
            (k + 1) * 4 > 3 * len(blocks),
            b.good and not (b.bad or b.named_bad or b.hidden),
            told and not b.good,
        )
    return x


class Cut:
    """Maximum flow by shortest augmenting paths on a small graph with undirected inner edges."""

    def __init__(self, nodes: int) -> None:
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def join(self, a: int, b: int, there: float, back: float) -> None:
        self.edges[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.edges[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def source_side(self, s: int, t: int) -> list[bool]:
        to, room, edges = self.to, self.room, self.edges
        while True:
            level = [-1] * len(edges)
            level[s] = 0
            queue = [s]
            for a in queue:
                for e in edges[a]:
                    if room[e] > 1e-9 and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        queue.append(to[e])
            if level[t] < 0:
                return [x >= 0 for x in level]
            # One blocking flow over the level graph, with a stack instead of recursion.
            left = [0] * len(edges)
            path: list[int] = []
            a = s
            while True:
                if a == t:
                    most = min(room[e] for e in path)
                    for e in path:
                        room[e] -= most
                        room[e ^ 1] += most
                    k = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                    a = to[path[k] ^ 1]
                    del path[k:]
                    continue
                while left[a] < len(edges[a]):
                    e = edges[a][left[a]]
                    if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                        break
                    left[a] += 1
                if left[a] < len(edges[a]):
                    path.append(e)
                    a = to[e]
                elif path:
                    a = to[path.pop() ^ 1]
                    left[a] += 1
                else:
                    break


#: Share of the classifier's log odds that counts as cost: words and names of one block may be wrong, its neighbours then decide.
SOFTNESS = 0.6
#: Capacity between blocks that follow each other on the page, and between those of one parent.
ADJACENT = 0.35
SIBLING = 0.8


def label(blocks: list[BlockOfText], weights: np.ndarray) -> list[bool]:
    """Content or not for each block: the minimum cut."""
    n = len(blocks)
    if not n:
        return []
    z = np.clip(SOFTNESS * (block_features(blocks) @ weights), -6, 6)
    keep, drop = np.logaddexp(0, z), np.logaddexp(0, -z)
    links = [(k, k + 1, ADJACENT) for k in range(n - 1)]
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if b.parent in last:
            links.append((last[b.parent], k, SIBLING))
        last[b.parent] = k
    wanted = (z > 0).tolist()
    if all(wanted[a] == wanted[b] for a, b, _ in links):
        return wanted  # no edge is cut by the terminals' own choice, so that choice is the minimum cut
    cut = Cut(n + 2)
    for k in range(n):
        cut.join(n, k, float(keep[k]), 0.0)
        cut.join(k, n + 1, float(drop[k]), 0.0)
    for a, b, room in links:
        cut.join(a, b, room, room)
    return cut.source_side(n, n + 1)[:n]


#: Made-up words, by rule.
VOCABULARY = [a + b + c for a in ("ba", "che", "du", "fi", "go", "le", "mo", "ru") for b in ("", "n", "st", "r") for c in ("a", "e", "ing", "on", "er")]


def made_up_page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page in one of many layouts, and the texts of its content blocks; each text is unique."""
    count = 0

    def words(low: int, high: int, stop: str = ".") -> str:
        nonlocal count
        count += 1
        some = [VOCABULARY[k] for k in rng.integers(0, len(VOCABULARY), rng.integers(low, high))]
        return " ".join([f"W{count}", *some]) + stop

    pick = lambda *a: a[int(rng.integers(0, len(a)))]
    named, tagged = rng.random() < 0.5, rng.random() < 0.6

    def wrap(tag: str, name: str, inner: str) -> str:
        if not named and tag in ("div", "section"):
            name = pick("", "", f"c{rng.integers(0, 99)}", "box", "row", "wrap")
        if not tagged and tag in ("nav", "header", "footer", "aside", "article", "main"):
            tag = "div"
        return f"<{tag}{name and pick(' class=', ' id=') + chr(34) + name + chr(34)}>{inner}</{tag}>"

    menu = lambda: "<ul>" + "".join(f'<li><a href="/x">{words(0, 2, "")}</a></li>' for _ in range(rng.integers(2, 8))) + "</ul>"
    noise = lambda: pick(words(2, 30), f"<p>{words(2, 30)}</p>", f"<div>{words(2, 12)}</div><div>{words(3, 30)}</div>")
    content: set[str] = set()

    def good(tag: str, low: int, high: int, stop: str = ".") -> str:
        t = words(low, high, stop)
        content.add(t)
        return f"<{tag}>{t}</{tag}>"

    body = good("h1", 3, 12, "")
    for _ in range(rng.integers(1, 12)):
        body += pick(
            good("p", 0, 4), good("p", 5, 40), good("p", 30, 150), good("p", 30, 150), good("h2", 1, 8, ""),
            "<ul>" + good("li", 2, 20) + good("li", 2, 20) + "</ul>", f"<blockquote>{good('p', 5, 40)}</blockquote>", good("div", 10, 60), good("figcaption", 3, 15),
        )
        if named and rng.random() < 0.08:
            body += wrap("div", pick("ad", "advert", "share-buttons", "newsletter-signup", "related-posts"), noise())
    page = pick(wrap("nav", "", menu()), wrap("div", pick("menu", "navbar", "site-nav"), menu()), menu(), "")
    page = pick(wrap("header", "", words(1, 6, "") + page), wrap("div", pick("header", "masthead"), words(1, 5, "") + page), page)
    for _ in range(rng.integers(0, 3)):
        page += wrap("div", pick("ad", "ads", "ad-slot", "sponsored", "cookie-notice", "banner", "notice", "alert popup"), noise())
    page += pick(
        wrap("article", "", body), wrap("article", "", body), wrap("main", "", body), wrap("div", pick("content", "post", "story", "entry-content"), body),
        wrap("main", "", wrap("article", "", body)), wrap("div", pick("legal", "with-sidebar", "page", "layout"), wrap("article", "", body)),
    )
    page += pick("", wrap("aside", "", menu() + noise()), wrap("div", pick("sidebar", "widget", "related"), menu() + noise()))
    page += pick("", wrap(pick("div", "section"), pick("comments", "comment-list", "disqus", "replies"), "".join(wrap("div", pick("comment", "reply", ""), noise()) for _ in range(rng.integers(1, 5)))))
    page += pick("", "", f"<div hidden>{noise()}</div>", f'<div style="display:none">{noise()}</div>')
    page += pick("", f"<form><label>{words(1, 3, '')}</label><input><button>{words(0, 2, '')}</button></form>")
    page += pick(wrap("footer", "", f"&copy; {words(2, 15)}"), wrap("div", "footer", words(2, 15)), "")
    page = f"<html><head><title>{words(3, 8, '')}</title></head><body>{page}</body></html>"
    return page, {t for t in content if f">{t}<" in page}


@lru_cache(maxsize=1)
def classifier(pages: int = 400, steps: int = 300, seed: int = 11) -> np.ndarray:
    """Logistic regression on the blocks of ``pages`` made-up pages."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, content = made_up_page(rng)
        found = blocks_of(page)
        xs.append(block_features(found))
        ys += [b.text in content for b in found]
    x, y = np.concatenate(xs), np.array(ys, float)
    w, seen = np.zeros(N_FEATURES), np.full(N_FEATURES, 1e-6)
    for _ in range(steps):
        slope = x.T @ (y - 1 / (1 + np.exp(-x @ w))) / len(y) - 1e-4 * w
        seen += slope**2
        w += 0.5 * slope / np.sqrt(seen)
    return w


def main_text(page: str, weights: np.ndarray | None = None) -> str:
    """Text of the blocks on the content side, joined by line feeds."""
    found = blocks_of(page)
    kept = label(found, classifier() if weights is None else weights)
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``page_id, url, text`` for every row; null or empty html gives an empty text.

    Every task labels pages one by one; a page is the largest thing in memory. Repeated rows are
    extracted each; other columns are not read.
    """
    weights = classifier() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
