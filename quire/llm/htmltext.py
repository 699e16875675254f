"""Main text of pages by gradient-boosted trees over DOM nodes, decoded along the tree.

A page becomes a tree of block elements, and of inline ones that name themselves by a class, an id
or a role, with a leaf for each run of text. Trees boosted on
generated pages, whose main text is known, give each node the log odds of holding main text,
from its subtree's density and links, the tokens of its tag and attributes and of its ancestors',
its depth, place and siblings. Decoding picks the set of nodes with the highest total that is
closed towards the root: a node is kept only below kept ancestors, and a dropped one takes its
descendants along.
"""

from __future__ import annotations

import html as references
import itertools
import math
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import gbdt
from quire.llm.shared import map_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>])*+)>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|name)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: HTML's own lists, fixed values.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("script style head noscript template svg math iframe object select textarea button title canvas audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes, up to one of the elements after the bar.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
#: What may stand in a head, fixed values; anything else ends it, with or without its end tag.
HEADED = frozenset("base basefont bgsound command head html link meta noscript script style template title".split())
#: Skipped elements that a block element ends, as no block can stand in them.
INLINE = frozenset("svg math select".split())
RAW_END = {t: re.compile(rf"</{t}(?![A-Za-z0-9])[^>]*>?", re.I) for t in RAW}


class Node:
    __slots__ = ("block", "children", "controls", "depth", "links", "parent", "pieces", "tag", "tags", "text", "tokens")

    def __init__(self, tag: str, parent: int, depth: int, tokens: tuple[str, ...], text: str = ""):
        self.tag, self.parent, self.depth, self.tokens, self.text = tag, parent, depth, tokens, text
        self.children: list[int] = []
        self.tags = self.links = self.controls = self.block = 0
        self.pieces: list[tuple[int, str]] = []


def attribute_tokens(tag: str, attributes: str) -> tuple[str, ...]:
    pieces = [p.lower() for m in ATTRIBUTE.finditer(attributes) for p in PIECE.findall(m[2] or m[3] or m[4] or "")]
    return (f"<{tag}>", *dict.fromkeys(pieces))


def parse(page: str) -> list[Node]:
    """Elements and text leaves in page order; the first node is the root. Leaves of one block share its number."""
    nodes = [Node("#root", -1, 0, ())]
    stack, run, skip, links = [0], [], 0, 0
    link_chars = block = serial = 0
    own: dict[int, Node] = {}

    def flush(ends: bool = True) -> None:
        """The text so far as a leaf, or as more of the leaf that its element has in this block; the block ends, or goes on in or after an inline element."""
        nonlocal run, link_chars, block, serial
        raw = "".join(run)
        if raw.strip():
            serial += 1
            leaf = own.get(stack[-1])
            if leaf is None:
                leaf = own[stack[-1]] = Node("#text", stack[-1], nodes[stack[-1]].depth + 1, ("#text",))
                leaf.block = block
                nodes[stack[-1]].children.append(len(nodes))
                nodes.append(leaf)
            leaf.pieces.append((serial, raw))
            leaf.text = " ".join(" ".join(x for _, x in leaf.pieces).split()) if len(leaf.pieces) > 1 else " ".join(raw.split())
            leaf.links = min(leaf.links + link_chars, len(leaf.text))
        # white space between inline elements belongs to what comes next
        run, link_chars = [] if raw.strip() or ends else [raw], 0
        if ends:
            block += 1
            own.clear()

    def opened(tag: str, attributes: str) -> None:
        parent = stack[-1]
        nodes[parent].children.append(len(nodes))
        stack.append(len(nodes))
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, attribute_tokens(tag, attributes)))

    def outer() -> int:
        """Place in the stack of the innermost block."""
        return next(i for i in range(len(stack) - 1, -1, -1) if nodes[stack[i]].tag in BLOCKS or i == 0)

    def said(piece: str) -> None:
        nonlocal link_chars
        if piece and not skip:
            piece = references.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if links:
                link_chars += len(piece.strip())

    at, skipped = 0, ""
    inner: Counter = Counter()  # elements that are open inside the skipped one

    def ends_skip(tag: str, closing: bool) -> bool:
        """Whether a tag ends the skipped element though it isn't its end tag."""
        if skipped == "head":
            return tag not in HEADED
        if not closing:
            return skipped in INLINE and tag in BLOCKS
        if inner[tag]:
            inner[tag] -= 1
            return False
        return tag == "body" or any(nodes[i].tag == tag for i in stack[1:])  # an ancestor closes

    while (m := TOKEN.search(page, at)) is not None:
        piece = page[at : m.start()]
        if skip and skipped == "head" and piece.strip():
            skip = 0
        said(piece)
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if skip:
            if tag == skipped:
                skip += -1 if m[1] else int(skipped not in ("button", "select", "head"))
                continue
            if not ends_skip(tag, bool(m[1])):
                if not m[1] and tag in RAW:
                    end = RAW_END[tag].search(page, at)
                    at = end.end() if end else len(page)
                elif not m[1] and tag not in VOID and not m[3].endswith("/"):
                    inner[tag] += 1
                continue
            skip = 0
        if not m[1]:
            if tag in SKIPPED:
                nodes[stack[-1]].controls += tag in ("select", "textarea", "button")
                if tag in RAW:
                    end = RAW_END[tag].search(page, at)
                    at = end.end() if end else len(page)
                elif not m[3].endswith("/"):
                    skip, skipped = 1, tag
                    inner.clear()
            elif tag == "br":
                run.append(" ")
            elif tag == "hr":
                flush()
            elif tag in BLOCKS:
                flush()
                if "p" == nodes[stack[outer()]].tag:
                    del stack[outer() :]
                if tag in IMPLIED:
                    closes, within = IMPLIED[tag]
                    for i in range(len(stack) - 1, 0, -1):
                        if nodes[stack[i]].tag in closes.split():
                            del stack[i:]
                        elif nodes[stack[i]].tag in within.split():
                            break
                opened(tag, m[3])
                links = 0
            else:
                nodes[stack[-1]].tags += 1
                nodes[stack[-1]].controls += tag == "input"
                if tag not in VOID and not m[3].endswith("/") and ATTRIBUTE.search(m[3]):
                    flush(False)
                    opened(tag, m[3])
                links += tag == "a"
        elif tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == tag:
                    del stack[i:]
                    break
        else:
            for i in range(len(stack) - 1, outer(), -1):
                if nodes[stack[i]].tag == tag:
                    flush(False)
                    del stack[i:]
                    break
            if tag == "a":
                links = max(0, links - 1)
    if skip and skipped == "head" and page[at:].strip():
        skip = 0
    said(page[at:])
    flush()
    return nodes


def describe(nodes: list[Node], odds: dict[str, float]) -> np.ndarray:
    """Features of every node."""
    n = len(nodes)
    chars, tags, links, controls, leaves, stops, words = (np.zeros(n) for _ in range(7))
    start = np.zeros(n)
    position = 0
    for i, node in enumerate(nodes):
        start[i] = position
        if node.tag == "#text":
            chars[i], links[i], leaves[i] = len(node.text), node.links, 1
            stops[i] = sum(map(node.text.count, ".,;:!?"))
            words[i] = node.text.count(" ") + 1
            position += len(node.text)
        else:
            tags[i] = 1 + node.tags
        controls[i] = node.controls
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        for column in (chars, tags, links, controls, leaves, stops, words):
            column[p] += column[i]
    low, high, above_low, above_high = (np.zeros(n) for _ in range(4))
    x = np.zeros((n, 24))
    total = max(1.0, chars[0])
    for i, node in enumerate(nodes):
        own = [odds.get(t, 0.0) for t in node.tokens] or [0.0]
        low[i], high[i] = min(own), max(own)
        if i:
            p = node.parent
            above_low[i], above_high[i] = min(above_low[p], low[p]), max(above_high[p], high[p])
    for i, node in enumerate(nodes):
        kin = nodes[node.parent].children if i else [0]
        x[i, :] = (
            node.depth, chars[i], chars[i] / total, chars[i] / (tags[i] + 1), links[i] / max(1, chars[i]), tags[i], stops[i] / max(1, words[i]), low[i], high[i], above_low[i], above_high[i],
            len(kin), 0, 0, chars[i] / max(1, chars[node.parent] if i else total), start[i] / total, stops[i], chars[i] / max(1, words[i]), controls[i], leaves[i], node.tag == "#text", 0, 0, words[i] / max(1, leaves[i]),
        )
    for node in nodes:
        same = Counter(nodes[c].tag for c in node.children)
        for k, c in enumerate(node.children):
            x[c, 12] = k / max(1, len(node.children) - 1)
            x[c, 13] = same[nodes[c].tag] / len(node.children)
            x[c, 21] = chars[node.children[k - 1]] if k else 0
            x[c, 22] = chars[node.children[k + 1]] if k + 1 < len(node.children) else 0
    x[:, [1, 3, 5, 16, 18, 19, 21, 22]] = np.log1p(x[:, [1, 3, 5, 16, 18, 19, 21, 22]])
    return x


def decode(nodes: list[Node], logits: np.ndarray) -> list[int]:
    """Kept text leaves in page order: the best total over sets that are closed towards the root.

    A node weighs the logarithm of its text's length, so that an element speaks for its subtree.
    """
    n = len(nodes)
    chars = np.array([len(v.text) for v in nodes], float)
    for i in range(n - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
    best = np.log1p(chars) * logits
    best[0] = 0.0
    for i in range(n - 1, 0, -1):
        best[i] = max(best[i], 0.0)
        best[nodes[i].parent] += best[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and best[i] > 0
    return [i for i in range(n) if kept[i] and nodes[i].tag == "#text"]


def joined(leaves: list[Node]) -> str:
    """Text of kept leaves in page order: those of one block on one line."""
    pieces = sorted((leaf.block, at, raw) for leaf in leaves for at, raw in leaf.pieces)
    blocks = ("".join(raw for _, _, raw in group) for _, group in itertools.groupby(pieces, lambda x: x[0]))
    return "\n".join(" ".join(x.split()) for x in blocks)


@dataclass
class Extractor:
    odds: dict[str, float]
    trees: gbdt.Boosted

    def texts(self, pages: list[str | None]) -> list[str]:
        trees = [parse(p or "") for p in pages]
        x = np.concatenate([describe(t, self.odds) for t in trees]) if trees else np.zeros((0, 24))
        logits, at, out = self.trees.logits(x), 0, []
        for nodes in trees:
            own = logits[at : at + len(nodes)]
            at += len(nodes)
            out.append(joined([nodes[i] for i in decode(nodes, own)]))
        return out


# Generated pages -------------------------------------------------------------------------------

#: Names that page authors give to what is main and what isn't, fixed values.
MAIN_NAMES = "article content main post entry story body text page-content post-content article-body entry-content main-content blog-post story-body prose".split()
#: Kinds of what isn't: tags and names, fixed values.
OTHER = {
    "menu": ("nav ul div", "nav navbar menu navigation breadcrumb topnav toolbar tabs pagination"),
    "header": ("header div", "header masthead site-header branding logo top-bar"),
    "footer": ("footer div", "footer site-footer copyright colophon legal bottom"),
    "sidebar": ("aside div section", "sidebar side aside widget related recommended trending popular tags secondary"),
    "notice": ("div section aside p", "notice cookie consent banner alert gdpr disclaimer warning message popup modal overlay"),
    "advert": ("div aside section", "ad ads advert advertisement sponsored promo promotion sponsor adsense commercial"),
    "form": ("form div", "form newsletter subscribe search login signup contact"),
    "comments": ("section div ol ul", "comments comment comment-list commentlist discussion replies respond disqus reviews"),
    "share": ("div ul", "share social sharing follow buttons"),
}
#: Inline elements that page authors name: what belongs to the text, and what doesn't, fixed values.
INLINE_MAIN, INLINE_OTHER = "highlight term ref citation emphasis quote name date first-letter link external", "advert sponsored ad share promo comment-count social badge-ad follow"
SYLLABLES = "an be con der el fi gra ho in jo ka li men nor ou per qui ra sto ter un vi wo xen yo zu tion ing ment er es en é ä ó".split()


def _words(r: random.Random, n: int) -> str:
    out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join([out[0].capitalize(), *(w + ("," if r.random() < 0.1 else "") for w in out[1:])]) + ("." if r.random() < 0.9 else "")


def _sentences(r: random.Random) -> str:
    return " ".join(_words(r, r.randint(1, 16)) for _ in range(r.choice((1, 1, 1, 2, 4, 7))))


def generated_page(seed: int) -> tuple[str, set[str]]:
    """A page and the texts of its main blocks, each marked by a word of its own."""
    r = random.Random(seed)
    mine: set[str] = set()
    serial = iter(range(1_000_000))

    def text(main: bool, n: int | None = None) -> str:
        mark = f"{'m' if main else 'o'}{next(serial)}q"
        if main:
            mine.add(mark)
        return f"{mark} {_words(r, n) if n else _sentences(r)}"

    def named(names: list[str] | str, chance: float = 0.85) -> str:
        name = r.choice(names if isinstance(names, list) else names.split())
        return r.choice((f' class="{name}"', f' id="{name}"', f' class="{name} {r.choice(("wide", "left", "col", "x1"))}"')) if r.random() < chance else ""

    def inline(main: bool) -> str:
        """An inline element: part of the text, or an advert, a share link, a count of comments."""
        tag = r.choice(("span", "span", "em", "a", "b"))
        return f"<{tag}{named(INLINE_MAIN if main else INLINE_OTHER, 1.0)}>{text(main, r.randint(1, 5))}</{tag}>"

    def main(inner_comment: bool) -> str:
        parts = [f"<h1>{text(True, r.randint(1, 9))}</h1>"] if r.random() < 0.9 else []
        for _ in range(r.choice((1, 2, 3, 5, 8, 12, 20))):
            kind = r.random()
            if kind < 0.75:
                body = text(True)
                body = f"<b>{body}<br>" if r.random() < 0.1 else f'{body} <a href="/x">{_words(r, 2)}</a> {_words(r, 3)}' if r.random() < 0.1 else body
                if seed % 2:  # every other page has inline elements with names
                    body = f"{inline(True)} {body}" if r.random() < 0.15 else f"{body} {inline(True)} {_words(r, 3)}" if r.random() < 0.2 else body
                    body = f"{body} {inline(False)}" if r.random() < 0.12 else body
                parts.append(f"<p>{body}" + r.choice(("</p>", "</p>", "</p>", "")))
            elif kind < 0.83:
                parts.append(f"<h{r.randint(2, 4)}>{text(True, r.randint(1, 6))}</h2>" if r.random() < 0.1 else f"<h2>{text(True, r.randint(1, 6))}</h2>")
            elif kind < 0.89:
                parts.append("<ul>" + "".join(f"<li>{text(True, r.randint(1, 12))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote><p>{text(True)}</p></blockquote>")
            elif kind < 0.96:
                parts.append("<table>" + "".join(f"<tr><td>{text(True, 2)}</td><td>{text(True, 3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<div>{text(True)}</div>")
        if r.random() < 0.25:
            parts.insert(r.randrange(len(parts) + 1), other(r.choice(("advert", "share", "notice"))))
        if seed % 2 and r.random() < 0.3:
            parts.insert(r.randrange(len(parts) + 1), inline(False))
        if inner_comment:
            parts.append(other("comments"))
        tag = r.choice(("article", "article", "main", "div", "section"))
        opened = f"<{tag}{named(MAIN_NAMES, 0.35 if tag in ('article', 'main') else 1.0)}>"
        return opened + "".join(parts) + f"</{tag}>"

    def other(kind: str) -> str:
        tags, names = OTHER[kind]
        tag = r.choice(tags.split())
        opened = f"<{tag}{named(names, 0.4 if tag in ('nav', 'header', 'footer', 'aside', 'form') else 1.0)}>"
        if tag in ("ul", "ol"):
            inner = "".join(f'<li><a href="/{i}">{text(False, r.randint(1, 3))}</a></li>' if kind != "comments" else f"<li><p>{text(False)}</p></li>" for i in range(r.randint(2, 8)))
        elif kind in ("menu", "share") or (kind in ("sidebar", "header", "footer") and r.random() < 0.5):
            inner = "<ul>" + "".join(f'<li><a href="/{i}">{text(False, r.randint(1, 3))}</a></li>' for i in range(r.randint(2, 9))) + "</ul>"
        elif kind == "form":
            inner = f'<label>{text(False, 2)}</label><input name="q"><button>Go</button>'
        elif kind == "comments":
            inner = f"<h3>{text(False, 2)}</h3>" * (r.random() < 0.5) + "".join(f'<div{named("comment reply", 0.6)}><p>{text(False)}</p></div>' for _ in range(r.randint(1, 5)))
        elif kind == "footer":
            inner = r.choice(("<p>{}</p>", "{}")).format("&copy; " + text(False, r.randint(2, 10)))
        else:
            inner = r.choice(("<p>{}</p>", "{}", "<h4>{}</h4>", "<div>{}</div>")).format(text(False))
        return f"{opened}{inner}</{tag}>"

    if r.random() < 0.15:  # an article that nothing stands around, and has no element of its own
        parts = [r.choice(("<p>{}</p>", "<p>{}</p>", "{}<br>", "<div>{}</div>")).format(text(True)) for _ in range(r.choice((1, 1, 2, 3, 6)))]
        if r.random() < 0.4:
            parts.insert(0, f"<h1>{text(True, r.randint(1, 9))}</h1>")
        if r.random() < 0.4:
            parts.append(other(r.choice(("footer", "menu", "comments", "advert"))))
        if r.random() < 0.2:
            parts.insert(0, other(r.choice(("header", "menu", "notice"))))
        return r.choice(("<html><body>{}</body></html>", "{}", "<html><head><title>t</title></head><body>{}")).format("".join(parts)), mine
    before = [other(k) for k in ("header", "menu", "advert", "notice", "form") if r.random() < 0.5]
    after = [other(k) for k in ("sidebar", "comments", "share", "advert", "form", "footer") if r.random() < 0.45]
    r.shuffle(before)
    middle = main(r.random() < 0.15)
    if r.random() < 0.35:
        side = after.pop(0) if after else ""
        middle = f'<div{named("wrapper container layout row grid columns", 0.7)}>{middle}{side}</div>'
    return f"<html><head><title>t</title><style>x</style></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>", mine


@lru_cache(maxsize=2)
def train(pages: int = 700) -> Extractor:
    """Fit on so many generated pages: token odds first, then the trees."""
    parsed = []
    for seed in range(pages):
        page, mine = generated_page(seed)
        nodes = parse(page)
        label = np.zeros(len(nodes))
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[i].tag == "#text" and any(w in mine for w in nodes[i].text.split()):
                label[i] = 1
            label[nodes[i].parent] = max(label[nodes[i].parent], label[i])
        parsed.append((nodes, label))
    seen, hits = Counter(), Counter()
    for nodes, label in parsed:
        for node, y in zip(nodes, label, strict=True):
            for t in node.tokens:
                seen[t] += 1
                hits[t] += y
    odds = {t: math.log((hits[t] + 0.5) / (n - hits[t] + 0.5)) for t, n in seen.items() if n >= 5}
    x = np.concatenate([describe(nodes, odds) for nodes, _ in parsed])
    y = np.concatenate([label for _, label in parsed])
    return Extractor(odds, gbdt.fit(x, y, np.ones(len(y))))


def main_text(pages: DataFrame, extractor: Extractor | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages(page_id, url, html).

    A null html counts as empty and gives an empty text; null ids and urls pass through; very long
    pages are read whole, 64 at a time; repeated rows give a row each, other columns are ignored and
    an empty table gives an empty result.
    """
    extractor = extractor or train()

    def rows(columns: list[list]) -> list[list]:
        texts: list[str] = []
        for at in range(0, len(columns[2]), 64):
            texts += extractor.texts(columns[2][at : at + 64])
        return [columns[0], columns[1], texts, [len(t) for t in texts]]

    return map_batches(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), rows, "page_id long, url string, text string, n_chars long")
