"""Operator 2: main text of web pages by tag-path ratios.

A page is read into text nodes, each with its root-to-leaf path of structural
tags. For each path, two ratios are aggregated: text length for each node and
punctuation for each node. Along the page each node takes its path's ratios;
both are smoothed with a Gaussian window, fused by their geometric mean, and
paths whose mean fused score reaches ``LEVEL`` of the page's deviation are
content. The content nodes' common container (the deepest article or main
element that holds all of them, else the lowest element that does) recovers
what is short: if it is part of an article or main element, or at least
``WHOLE`` of its blocks are content, all of it belongs to the page's article. In a
wider container, such as a whole body, only what stands between two content
nodes and the headings right before the first one are recovered; the rest,
such as plain lists of links before and after the article, is left out.

Never content, whatever its ratios: scripts, styles, forms, navigation,
footers, asides, a page's header, hidden parts (also what browsers show only
without scripts, frames or plug-ins), and parts whose role, class or id names a
menu, sidebar, notice, advert or reader comments. A class or id is no such name
where the part holds the page's article: its main element, all its first-rank
headings, or, if the class or id says anything else besides and no article or
main element has text elsewhere, more than half of the chosen paths' text.

Blocks are joined in page order by two line feeds; white space inside a block
becomes one space; character references are decoded. Nothing is dropped or
capped beside that.

Defined results: a null or empty page, and one without any text outside those
parts, has an empty text and n_chars 0; markup that is never closed ends with
its parent; equal rows each keep a row; further columns are left out.
"""

from __future__ import annotations

import collections
import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

LEVEL = 0.5
SIGMA = 1.0
WHOLE = 0.5

BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noembed noframes xmp iframe textarea title noscript template annotation annotation-xml".split())
NEVER = set("nav footer aside form button select dialog menu fieldset head".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
ARTICLE = set("article main".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())

#: Start tags that end an open element of the second set, up to one of the third.
ENDS = {
    **{t: (["p"], {"button", "td", "th", "table"}) for t in BLOCK - {"tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "option", "optgroup", "caption", "body", "html"}},
    "li": (["p", "li"], {"ul", "ol", "menu", "dir"}),
    "dd": (["p", "dd", "dt"], {"dl"}),
    "dt": (["p", "dd", "dt"], {"dl"}),
    "tr": (["td", "th", "tr", "p"], {"table"}),
    "td": (["td", "th", "p"], {"tr", "table"}),
    "th": (["td", "th", "p"], {"tr", "table"}),
    "tbody": (["td", "th", "tr", "tbody", "thead", "tfoot"], {"table"}),
    "thead": (["td", "th", "tr", "tbody", "thead", "tfoot"], {"table"}),
    "tfoot": (["td", "th", "tr", "tbody", "thead", "tfoot"], {"table"}),
    "option": (["option"], {"select"}),
}

TAG = re.compile(r"<(?:!--(?P<note>.*?)(?:-->|--!>|\Z)|(?P<other>[!?][^>]*)(?:>|\Z)|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|side|footer|masthead|breadcrumbs?|ads?|adv|advert\w*|adsense|adslot|adbox|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notices|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|share|sharing|related|recommended|recommendations|comments?|commentlist|disqus|replies|reply|respond|widget|toolbar|pagination|pager|copyright|disclaimer|search|skip|paywall)(?:$|[\s_-])"
)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|reply|respond)(?:$|[\s_-])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACES = re.compile(r"[ \t\n\r\f\v\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；：¡¿،؟]")


class Element:
    """path: the number of its path of structural tags; block: itself or the
    nearest block above it; named: the kind of its class or id, 0 if it names
    nothing, 1 if a part among other words, 2 for comments and where all words
    do; under, article and main: itself or the nearest element above that is
    named, that is an article or main element, and that is a main element."""

    __slots__ = ("tag", "parent", "path", "skip", "depth", "block", "named", "under", "article", "main")

    def __init__(self, tag: str, parent: "Element | None", skip: bool, paths: dict[tuple[int, str], int], named: int = 0):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.depth = 0 if parent is None else parent.depth + 1
        self.named = named
        self.under = self if named else None if parent is None else parent.under
        self.article = self if tag in ARTICLE else None if parent is None else parent.article
        self.main = self if tag == "main" else None if parent is None else parent.main
        if parent is None or tag in BLOCK:
            self.path = paths.setdefault((-1 if parent is None else parent.path, tag), len(paths))
            self.block = self
        else:
            self.path, self.block = parent.path, parent.block


def left_out(tag: str, attrs: str, inside: set[str]) -> bool:
    if tag in NEVER or tag == "header" and not inside & ARTICLE:
        return True
    if not attrs.strip(" /\n"):
        return False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def named(tag: str, attrs: str) -> int:
    """Whether the class or id names a part beside the article: 1 among other
    words, 2 for comments and where all words do."""
    if not attrs.strip(" /\n") or tag in ("html", "body") or tag in ARTICLE:
        return 0
    values = [CAMEL.sub("-", m[2] or m[3] or m[4] or "").lower() for m in ATTR.finditer(attrs) if m[1].lower() in ("class", "id")]
    if not any(map(NAMES.search, values)):
        return 0
    return 2 if any(map(COMMENTS.search, values)) or all(NAMES.fullmatch(w) for v in values for w in v.split()) else 1


def blocks_of(page: str) -> list[tuple[Element, str]]:
    """The page's blocks of text with their elements, in page order, without
    those that are never content; parts named by class or id are still there."""
    paths: dict[tuple[int, str], int] = {}
    root = Element("html", None, False, paths)
    open_: list[Element] = [root]
    count: collections.Counter[str] = collections.Counter()  # open elements by tag
    out: list[tuple[Element, str]] = []
    buffer: list[str] = []
    owner = root

    def flush() -> None:
        if buffer:
            if text := SPACES.sub(" ", "".join(buffer)).strip(" "):
                out.append((owner, text))
            buffer.clear()

    def close(k: int) -> None:
        if any(e.tag in BLOCK for e in open_[k:]):
            flush()
        count.subtract([e.tag for e in open_[k:]])
        del open_[k:]

    def start(tag: str, parent: Element, skip: bool, kind: int = 0) -> None:
        open_.append(Element(tag, parent, skip, paths, kind))
        count[tag] += 1

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at and not open_[-1].skip:
            if not buffer:
                owner = open_[-1].block
            buffer.append(html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        if m["name"] is None:
            continue
        tag, attrs = m["name"].lower(), m["attrs"] or ""
        if m["end"]:
            k = next((k for k in range(len(open_) - 1, 0, -1) if open_[k].tag == tag), 0) if count[tag] > 0 else 0
            if k and (tag in BLOCK or not any(e.tag in BLOCK for e in open_[k:])):
                close(k)
            elif tag == "p":
                flush()
            elif k:  # an inline end tag across blocks ends its own element alone
                del open_[k]
                count[tag] -= 1
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/") or tag in ("script", "style", "title", "textarea", "iframe"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if tag == "xmp" and not open_[-1].skip:
                    flush()
                    owner = open_[-1].block
                    buffer.append(page[at : end.start() if end else size])
                    flush()
                    at = size if end is None else at
                at = end.end() if end else size if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag in VOID:
            if tag == "br" and not open_[-1].skip:
                buffer.append(" ") if buffer else None
            elif tag == "hr":
                flush()
            continue
        if tag in ("html", "body"):
            flush()
            if tag == "body" and not count["body"]:
                close(1)
                start("body", root, False)
            continue
        if tag in BLOCK:
            flush()
            tags, until = ENDS.get(tag, ([], set()))
            if any(count[t] > 0 for t in tags):
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k].tag in until:
                        break
                    if open_[k].tag in tags:
                        close(k)
                        if not any(count[t] > 0 for t in tags):
                            break
            parent = open_[-1].block
        else:
            parent = open_[-1]
        inside = {t for t in ARTICLE if count[t] > 0}
        start(tag, parent, open_[-1].skip or left_out(tag, attrs, inside), named(tag, attrs))
    flush()
    return out


def smooth(values: list[float]) -> list[float]:
    """Gaussian window of three deviations each way, renormalised at the ends."""
    r = math.ceil(3 * SIGMA)
    w = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-r, r + 1)]
    out = []
    for i in range(len(values)):
        near = [(w[d + r], values[i + d]) for d in range(-r, r + 1) if 0 <= i + d < len(values)]
        out.append(sum(a * b for a, b in near) / sum(a for a, _ in near))
    return out


def content_paths(blocks: list[tuple[Element, str]]) -> set[int]:
    """Paths whose smoothed and fused ratios reach the page's threshold."""
    stat: dict[int, list[float]] = {}
    for e, text in blocks:
        s = stat.setdefault(e.path, [0, 0, 0])
        s[0] += 1
        s[1] += len(text)
        s[2] += len(PUNCTUATION.findall(text))
    length = smooth([stat[e.path][1] / stat[e.path][0] for e, _ in blocks])
    marks = smooth([(stat[e.path][2] + 1) / stat[e.path][0] for e, _ in blocks])
    fused = [math.sqrt(a * b) for a, b in zip(length, marks)]
    mean = sum(fused) / len(fused)
    level = min(LEVEL * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused)) if len(fused) > 1 else 0.0, max(fused))
    score: dict[int, list[float]] = {}
    for (e, _), x in zip(blocks, fused):
        score.setdefault(e.path, []).append(x)
    return {p for p, x in score.items() if sum(x) / len(x) >= level}


def container(chosen: list[tuple[Element, str]]) -> Element:
    """The deepest article or main element with all of the chosen text, else
    the deepest element that holds all of it."""
    total = sum(len(t) for _, t in chosen)
    held: dict[Element, int] = {}
    for e, text in chosen:
        held[e] = held.get(e, 0) + len(text)
    by_depth: dict[int, list[Element]] = {}
    for e in held:
        by_depth.setdefault(e.depth, []).append(e)
    for depth in range(max(by_depth, default=0), 0, -1):  # each passes its sum on once, the deepest first
        for e in by_depth.get(depth, ()):
            if e.parent not in held:
                by_depth.setdefault(e.parent.depth, []).append(e.parent)
            held[e.parent] = held.get(e.parent, 0) + held[e]
    marked = [e for e, n in held.items() if e.tag in ARTICLE and n == total]
    if marked:
        return max(marked, key=lambda e: (e.depth, held[e]))
    all_ = [e for e, n in held.items() if n == total]
    return max(all_, key=lambda e: e.depth)


def without_named(blocks: list[tuple[Element, str]]) -> list[tuple[Element, str]]:
    """The blocks without the parts named by class or id, but for those parts
    that hold the page's article."""
    if not any(e.under for e, _ in blocks):
        return blocks
    paths = content_paths(blocks)
    total, heads, elsewhere = 0, 0, False
    held: dict[Element, list[int]] = {}  # chosen text, first-rank headings, main elements
    for e, text in blocks:
        part = e.under
        chosen = len(text) if e.path in paths and not (part and part.named == 2) else 0
        total += chosen
        heads += e.tag == "h1"
        elsewhere = elsewhere or part is None and e.article is not None
        if part:
            own = held.setdefault(part, [0, 0, 0])
            own[0] += chosen
            own[1] += e.tag == "h1"
        if e.main and e.main.under:
            held.setdefault(e.main.under, [0, 0, 0])[2] = 1
    by_depth: dict[int, list[Element]] = {}
    for e in held:
        by_depth.setdefault(e.depth, []).append(e)
    for depth in range(max(by_depth), -1, -1):  # each passes its sums on once, the deepest first
        for e in by_depth.get(depth, ()):
            above = e.parent.under
            if above:
                if above not in held:
                    by_depth.setdefault(above.depth, []).append(above)
                own = held.setdefault(above, [0, 0, 0])
                for k, x in enumerate(held[e]):
                    own[k] += 0 if k == 0 and e.named == 2 else x
    kept: dict[Element | None, bool] = {None: True}
    for depth in sorted(by_depth):
        for e in by_depth[depth]:
            text, h1, main = held[e]
            kept[e] = kept[e.parent.under] and (main > 0 or 0 < h1 == heads or e.named == 1 and not elsewhere and 2 * text > total)
    return [x for x in blocks if kept[x[0].under]]


def extract(page: str | None) -> str:
    blocks = without_named(blocks_of(page or ""))
    if not blocks:
        return ""
    paths = content_paths(blocks)
    top = container([x for x in blocks if x[0].path in paths])

    known = {top: True}

    def inside(e: Element | None) -> bool:
        path = []
        while e is not None and e not in known:
            path.append(e)
            e = e.parent
        found = e is not None and known[e]
        known.update(dict.fromkeys(path, found))
        return found

    return "\n\n".join([text for _, text in recovered([x for x in blocks if inside(x[0])], paths, top)])


def recovered(blocks: list[tuple[Element, str]], paths: set[int], top: Element) -> list[tuple[Element, str]]:
    """Of the container's blocks those that are content or belong to it."""
    chosen = [e.path in paths for e, _ in blocks]
    if top.article or sum(chosen) >= WHOLE * len(blocks):
        return blocks
    first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
    while first and blocks[first - 1][0].tag in HEADINGS:
        first -= 1
    return blocks[first : last + 1]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of each page."""

    def run(keys: list, urls: list, htmls: list) -> list:
        texts = [extract(h) for h in htmls]
        return [keys, urls, texts, [len(t) for t in texts]]

    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))
    src = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("address"), F.col(html_col).alias("page"))
    return map_rows(src, run, ["key", "address", "page"], f"{id_col} {kind}, {url_col} {url_kind}, text string, n_chars bigint")
