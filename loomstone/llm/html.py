"""HTML main text by tag-path ratios.

Each block of text belongs to a root-to-leaf tag path. Text length and punctuation are summed per path; both ratios (per block of the
path) are smoothed over neighbouring blocks in page order, fused by their product, averaged per path and multiplied by all its text. Paths whose fused score
reaches a share of the page's highest are content. Names of furniture (tags, roles, words of classes and ids) lower the score of
what is under them, links that of lists and cells. With the selected blocks go short ones between them or directly before them, and the
rest of a container whose text is mostly selected. Only what a browser does not show always goes.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from .common import map_text

# Quotation marks part a tag only after "="; possessive, so that a broken tag costs one scan.
TAG = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe textarea title noembed noframes xmp".split())  # ended by their own end tag only
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
UNSEEN = set("head template svg object canvas select datalist".split())
IN_HEAD = RAW | set("head meta link base template".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul video audio picture".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var math mi mo mn ms mtext mrow mfrac msup msub msqrt".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
ITEM = set("li dd dt tr td th option".split())
LIST = ("ul", "ol", "dl", "table", "tbody", "menu", "select")
BOILER = set("nav aside footer form menu button dialog fieldset search".split())
FIRM = BOILER - {"form", "fieldset"}  # furniture even where it holds most of the page's text
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = set("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing comment comments commentlist reply replies respond discussion discussions thread talkback guestbook reactions responses disqus pagination pager toolbar widget paywall".split())
WEAK = set("notice alert social related recommended recommendations trending popular copyright legal disclaimer skip".split())  # may as well name what the text is about
SHARE = 0.5  # of the highest path score on the page, to be content
OUTSIDE = 0.5  # what scores keep beside an article or main element that holds most of the text
SIGN = (1.0, 0.6, 0.4)  # what they keep under no sign of furniture, a weak word or one in a longer name, and a whole name, role or tag
LITTLE = 1000  # characters of a page at which signs count as much again, since its scores say little
MOST = 0.5  # of a container's text is selected: the rest belongs to it


class _Node:
    """An element: its place in the order of creation, that of its parent, the number of its tag path, and what is known of it."""

    __slots__ = ("at", "tag", "up", "path", "sign", "hidden", "named", "link", "block")

    def __init__(self, at, tag, up, path, sign, hidden, named, link, block):
        self.at, self.tag, self.up, self.path, self.sign = at, tag, up, path, sign
        self.hidden, self.named, self.link = hidden, named, link  # not shown; in an article or main element; in a link
        self.block = block  # depth of the nearest element that is not inline


def _signs(tag: str, named: bool, token: str) -> tuple[str, int, bool]:
    """The path's mark of the element (its class), its sign of furniture (an index of SIGN), and whether it is not shown."""
    mark, hidden = "", tag in UNSEEN
    sign = 2 if tag in BOILER or tag == "header" and not named else 0
    if "=" in token or "hidden" in token:
        for name, value in ATTR.findall(token, len(tag) + 1):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "role":
                sign = 2 if value in ROLES else sign
            elif name in ("class", "id"):
                mark += f".{value}" if name == "class" else "#" if len(value) < 24 else ""
                if tag not in ("html", "body", "article", "main", *HEADING):
                    for word in value.split():
                        parts = set(re.split(r"[^a-z0-9]+", word)) - {""}
                        if parts & WORDS or parts & WEAK:
                            sign = max(sign, 2 if parts <= WORDS else 1)
            elif name == "aria-hidden" and value == "true":
                sign = max(sign, 1)
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    return ("" if tag in BOILER else mark), sign, hidden


class _Tree:
    """The open elements of a page while it is read. Each step is amortised: what is passed over is closed for good."""

    def __init__(self):
        self.nodes = [_Node(0, "", -1, 0, 0, False, False, False, 0)]
        self.stack, self.open, self.paths = [self.nodes[0]], {}, {}

    def push(self, tag: str, token: str) -> None:
        up = self.stack[-1]
        mark, sign, hidden = _signs(tag, up.named, token)
        path = self.paths.setdefault((up.path, tag + mark), len(self.paths) + 1)
        depth = len(self.stack)
        node = _Node(len(self.nodes), tag, up.at, path, sign, up.hidden or hidden, up.named or tag in ("article", "main"), up.link or tag == "a", up.block if tag in INLINE else depth)
        self.nodes.append(node)
        self.stack.append(node)
        self.open.setdefault(tag, []).append(depth)

    def deepest(self, *tags: str) -> int:
        """Depth of the innermost open element of the tags; 0 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.stack.pop().tag].pop()

    def start(self, tag: str, token: str) -> None:
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.close(len(self.stack) - 1)
        if tag in BLOCK and self.stack[self.stack[-1].block].tag == "p":
            self.close(self.stack[-1].block)  # a block ends an open paragraph, and what is open inside it
        if tag in ITEM and (at := self.deepest(tag)) > self.deepest(*LIST):
            self.close(at)
        self.push(tag, token)

    def end(self, tag: str) -> None:
        at = self.deepest(tag)
        if at and not (tag in INLINE and at < self.stack[-1].block):
            self.close(at)


def blocks(html: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """The elements, and (element, text, links' characters) of each block in page order: character references decoded, white space
    one space."""
    tree, out, parts, link = _Tree(), [], [], 0
    owner = tree.nodes[0]

    def flush():
        nonlocal parts, link
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((owner, text, min(link, len(text))))
            parts, link = [], 0

    def say(text):
        nonlocal owner, link
        if tree.stack[-1].tag == "head" and not text.isspace():
            tree.close(len(tree.stack) - 1)
        node = tree.stack[-1]
        if not parts:
            owner = tree.stack[node.block]
        text = unescape(text) if "&" in text else text
        parts.append(text)
        if node.link:
            link += len(text)

    at, size, endless = 0, len(html), set()  # endless: raw tags that nothing ends from here on
    while at < size:
        start = html.find("<", at)
        found = TAG.match(html, start) if start >= 0 else None
        if start < 0 or not found:
            upto = size if start < 0 else start + 1
            say(html[at:upto])
            at = upto
            continue
        if start > at:
            say(html[at:start])
        token, at = found[0], found.end()
        if token[1] in "!?":
            continue
        tag = NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag in BLOCK:
                flush()
            tree.end(tag)
        elif tag in RAW:
            ends = None if tag in endless else RAW_END[tag].search(html, at)
            if not ends:
                endless.add(tag)
            at = ends.start() if ends else size if tag in ("script", "style") else at
        elif tag == "br":
            parts.append(" ")
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            if tag in BLOCK:
                flush()
            if not token.endswith("/>") or tag in BLOCK or tag in INLINE:
                tree.start(tag, token)
    flush()
    return tree.nodes, out


def tag_path_scores(paths: list[int], texts: list[str]) -> np.ndarray:
    """Fused score of each block's path: its text length and its punctuation per block, smoothed where that does not raise them (a
    neighbour's length is no sign of content), multiplied, averaged over the blocks of the path, and times all text of the path."""
    _, path = np.unique(np.asarray(paths), return_inverse=True)
    n = np.bincount(path)
    total = lambda of: np.bincount(path, [of(t) for t in texts])
    size, marks = total(len), (total(lambda t: sum(map(t.count, ".,;:!?"))) / n)[path]
    length = (size / n)[path]
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), kernel / kernel.sum(), "valid")
    fused = np.sqrt(np.minimum(smooth(length) * (1 + smooth(marks)), length * (1 + marks)))
    return (np.bincount(path, fused) / n * size)[path]


def _below(nodes: list[_Node], found, values) -> list[float]:
    """Sum of the blocks' values under each element."""
    total = [0.0] * len(nodes)
    for (node, _, _), v in zip(found, values):
        total[node.at] += v
    for node in reversed(nodes[1:]):
        total[node.up] += total[node.at]
    return total


def main_text(html: str) -> str:
    """Main text of a page: its blocks joined by one newline; "" if it has none.

    Content are the blocks whose path's score is at least SHARE of the page's highest; scores are lowered by links and by signs of furniture (to
    0.4 of themselves, to less only where the whole page has little text). With them go blocks between the first and the last of them,
    headings and siblings directly before one, a paragraph between a heading and one, and all of an article, main or parent element (but body)
    whose text is mostly content; none of these if a sign is above it that is above no content, and lists of links only after content. A sign is refuted by
    most of the page's text (a form or wrapper round all).
    """
    nodes, found = blocks(html)
    found = [x for x in found if not x[0].hidden]
    if not found:
        return ""
    prose = [len(text) - link for _, text, link in found]
    inside = [node.named for node, _, _ in found]
    under, named = _below(nodes, found, prose), _below(nodes, found, inside)
    keep, wrong, weight = [1.0] * len(nodes), [False] * len(nodes), 1 + LITTLE / sum(len(text) for _, text, _ in found)
    for node in nodes[1:]:
        wrong[node.at] = bool(node.sign) and node.tag not in FIRM and 2 * under[node.at] >= under[0] > 0 and (named[node.at] > 0 or not named[0])
        keep[node.at] = min(keep[node.up], 1.0 if wrong[node.at] else SIGN[node.sign] ** (weight if node.sign == 2 else 1))
    linked = [link >= 0.8 * len(text) and node.tag not in ("p", *HEADING) for node, text, link in found]
    lowered = np.array([keep[node.at] * (0.1 if much else 1.0) for (node, _, _), much in zip(found, linked)])
    size = lowered * [len(text) for _, text, _ in found]
    scores = tag_path_scores([node.path for node, _, _ in found], [text for _, text, _ in found])
    apart = 2 * sum(p for p, x in zip(prose, inside) if x) >= under[0]
    scores = scores * lowered * np.where(apart & ~np.array(inside), OUTSIDE**weight, 1.0)
    content = (scores > 0) & (scores >= SHARE * scores.max())
    if not content.any() or all(much or keep[node.at] <= SIGN[2] ** weight for (node, _, _), much in zip(found, linked)):
        return ""  # nothing, or nothing but furniture
    first, last = int(content.argmax()), len(content) - 1 - int(content[::-1].argmax())
    chosen, whole = _below(nodes, found, content * size), _below(nodes, found, size)
    likely = _below(nodes, found, (scores >= 0.5 * SHARE * scores.max()) * size)  # a weak sign does not keep these from their article
    parents = {nodes[node.at].up for (node, _, _), ok in zip(found, content) if ok}
    closed, home = [False] * len(nodes), [False] * len(nodes)
    for node in nodes[1:]:
        closed[node.at] = closed[node.up] or bool(node.sign) and not wrong[node.at] and not (chosen if node.sign == 2 else likely)[node.at]
        frame = node.tag in ("article", "main") or node.at in parents and node.tag not in ("html", "body")
        home[node.at] = home[node.up] or frame and chosen[node.at] > 0 and chosen[node.at] >= MOST * whole[node.at]
    taken = content.copy()
    for k in reversed(range(len(found))):
        node = found[k][0]
        if content[k] or closed[node.at]:
            continue
        lead = 0 < k and node.tag == "p" and keep[node.at] == 1 and found[k - 1][0].tag in HEADING and found[k - 1][0].up == node.up
        before = k < last and taken[k + 1] and (node.tag in HEADING or node.up == found[k + 1][0].up or lead and not linked[k])
        taken[k] = before or (first < k < last or home[node.at]) and (k > first or not linked[k])
    return "\n".join(text for (_, text, _), ok in zip(found, taken) if ok)


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """keep columns plus text and n_chars (code points). Null or empty html: "" and 0; repeated rows each give a row. No shuffle."""

    def fn(texts):
        out = [main_text(t) for t in texts]
        return [out, [len(t) for t in out]]

    return map_text(pages, html_col, fn, [("text", "string"), ("n_chars", "bigint")], list(keep), rows=64)
