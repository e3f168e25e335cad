"""A small tolerant HTML reader for operator 3: blocks of text and the tree of block elements they stand in.

One regular expression cuts a page into tags and text. Elements that end a block become tree nodes; elements whose
role is a menu, header, footer, sidebar, notice, advert, form or comment list are marked as dropped with all they hold.
A role is a tag, or a whole class token, id or role value made of role words and neutral ones ("site-header"; not
"related-work", "has-sidebar"); words that name nothing else ("advert", "comments") also count beside other words of a class.
Headings have no role by their attributes. Inside an article ids are anchors (but for those made of such words), and a
paragraph is dropped only for a class that is one such word.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^>]*(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"""(?i)(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# fixed values: element names of the HTML standard and the role words
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg select canvas audio video annotation".split())
_BLOCK = frozenset(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary fieldset hr br center nav header footer aside form menu dialog hgroup".split()
)
_DROP = frozenset("head nav header footer aside form menu button dialog label fieldset".split())
_ROLES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget cookie cookies "
    "consent gdpr notice notices alert banner popup modal overlay newsletter subscribe signup paywall ad ads advert adverts "
    "advertisement advertising sponsor sponsored sponsors promo promotion promoted comment comments commentlist reply replies respond disqus discussion "
    "share sharing social related recommended form login search toolbar pagination pager complementary contentinfo".split()
)
_STRONG = frozenset(
    "cookie cookies gdpr ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promoted comment "
    "comments commentlist respond disqus newsletter paywall popup breadcrumb breadcrumbs navbar pagination pager".split()
)
_COMMENT = frozenset("comment comments commentlist reply replies respond disqus".split())
_NEUTRAL = frozenset(
    "site page main top bottom left right box block area wrapper wrap container section bar list links inner outer global "
    "primary secondary sticky fixed group holder panel module region content slot item items posts buttons icons form widgets thread".split()
)
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 dt dd td th blockquote pre figcaption caption".split())
_STATE = frozenset("no has with without is hide show not non enable disable".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_MAIN = ("article", "main")
_CLOSES_P = _BLOCK - {"br", "html", "head", "body"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = frozenset("article section main div table ul ol dl td th body html nav header footer aside form blockquote".split())
#: Levels of the tree that take part in alignment; what lies deeper is content like all else, in the slot of the element around it.
ALIGNED_DEPTH = 100


def _role(tag: str, attrs: list[tuple[str, str]], inside: bool) -> int:
    """0 if the attributes of an element name no role, 2 for reader comments, 1 for the others. inside: in an article."""
    role = 0
    for name, value in attrs:
        for token in value.split():
            words = [w.lower() for w in _WORD.findall(token)]
            hits = [w for w in words if w in _ROLES]
            if not hits or words[0] in _STATE:
                continue
            strong = any(w in _STRONG for w in hits)
            whole = all(w in _ROLES or w in _NEUTRAL for w in words)
            if tag == "p" and inside:
                found = name == "class" and strong and len(words) == 1
            elif name == "id" and inside:
                found = strong and whole
            else:
                found = whole or strong and name == "class" and tag != "p"
            if found:
                role = max(role, 2 if any(w in _COMMENT for w in hits) else 1)
    return role


class Page:
    """Nodes as parallel lists (parent, tag, label, dropped: 0, 1 or 2 for comments) in page order; blocks as [node, raw
    text, linked length]."""

    __slots__ = ("parent", "tag", "label", "dropped", "blocks")

    def __init__(self, text: str | None):
        self.parent, self.tag, self.label, self.dropped = [-1], ["#"], ["#"], [0]
        self.blocks: list[list] = []
        if text:
            self._read(text)

    def _node(self, parent: int, tag: str, label: str, dropped: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.label.append(label)
        self.dropped.append(dropped)
        return len(self.parent) - 1

    def _read(self, text: str) -> None:
        stack: list[tuple[str, int]] = []  # (element, its node or that around it)
        links, here, buffer, linked, at = 0, 0, [], 0, 0
        lower = None
        opened: dict[str, int] = defaultdict(int)  # how many of each element are open

        def flush() -> None:
            nonlocal buffer, linked
            if buffer:
                self.blocks.append([here, "".join(buffer), linked])
                buffer, linked = [], 0

        def pop_to(i: int) -> None:
            nonlocal here, links
            if any(t in _BLOCK or n != (stack[k - 1][1] if k else 0) for k, (t, n) in enumerate(stack[i:], i)):
                flush()
            for t, _ in stack[i:]:
                opened[t] -= 1
            links = opened["a"]
            del stack[i:]
            here = stack[-1][1] if stack else 0

        end, n = 0, len(text)
        while end < n:
            m = _TOKEN.search(text, end)
            raw = text[end : m.start() if m else n]
            if raw:
                buffer.append(html.unescape(raw) if "&" in raw else raw)
                linked += len(raw) if links else 0
            if not m:
                break
            end = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                for i in range(len(stack) - 1 if opened[tag] else -1, -1, -1):
                    if stack[i][0] == tag:
                        pop_to(i)
                        break
                    if tag not in _BLOCK and stack[i][0] in _SCOPE:
                        break
                else:
                    if tag in _BLOCK:
                        flush()
                continue
            if tag in _RAW:
                if not m[3].rstrip(">").endswith("/") or tag in ("script", "style", "title", "textarea"):
                    lower = text.lower() if lower is None else lower
                    at = lower.find(f"</{tag}", end)
                    if len(lower) != n:  # lower case of another length: look in the text itself
                        found = re.compile(f"</{tag}", re.I).search(text, end)
                        at = found.start() if found else -1
                    if at < 0:
                        break
                    close = text.find(">", at)
                    end = n if close < 0 else close + 1
                continue
            if tag in _VOID:
                if tag in _BLOCK:
                    flush()
                elif tag == "wbr" or tag == "img":
                    pass
                continue
            if tag in _CLOSES_P and opened["p"] or any(opened[t] for t in _SAME.get(tag, ())):
                for i in range(len(stack) - 1, -1, -1):
                    t = stack[i][0]
                    if t in _SAME.get(tag, ()) or t == "p" and tag in _CLOSES_P:
                        pop_to(i)
                        break
                    if t in _SCOPE and t not in _SAME:
                        break
            label = tag
            drop = int(tag in _DROP)
            if m[3] and len(m[3]) > 4:
                attrs = [(a[1].lower(), a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])]
                if tag == "article":
                    drop = max(drop, 2 * any(w.lower() in _COMMENT for _, v in attrs for t in v.split() for w in _WORD.findall(t)[:1]))
                elif tag not in _HEADING and tag not in ("html", "body", "main"):
                    drop = max(drop, _role(tag, attrs, opened["article"] > 0))
                label = f"{tag}.{' '.join(re.sub(r'[0-9]+', '', v) for _, v in attrs)}"[:80]
            if tag in _BLOCK or drop:
                if tag in _BLOCK or buffer:
                    flush()
                here = self._node(here, tag, label, drop)
            opened[tag] += 1
            links = opened["a"]
            stack.append((tag, here))
        flush()

    def inherit(self) -> list[bool]:
        """Whether a node or one around it is dropped. Where an article or main element stands only inside dropped elements
        (a form around the page, an advert that never ends) and holds more text than all that is kept, these count as
        kept; not so for comments."""
        out = self._below()
        if not any(t in _MAIN and not o for t, o in zip(self.tag, out, strict=True)):
            size = self._sizes(self._below(inner=True))
            found = [i for i, t in enumerate(self.tag) if t in _MAIN and not self.dropped[i] and out[i] < 2]
            kept = sum(len(t) for n, t, _ in self.blocks if not out[n] and not t.isspace())
            if found:
                top = max(found, key=lambda i: (size[i], -i))
                if size[top] > kept:
                    p = self.parent[top]
                    while p > 0:
                        self.dropped[p] = 0
                        p = self.parent[p]
                    out = self._below()
        return [o > 0 for o in out]

    def _below(self, inner: bool = False) -> list[int]:
        """The strongest mark of a node and those around it; ``inner``: of those inside the nearest main element."""
        out = list(self.dropped)
        for i in range(1, len(out)):
            if not (inner and self.tag[i] in _MAIN):
                out[i] = max(out[i], out[self.parent[i]])
        return out

    def _sizes(self, out: list) -> list[int]:
        """Characters of the blocks that aren't dropped, in each subtree."""
        size = [0] * len(self.tag)
        for node, text, _ in self.blocks:
            if not out[node] and not text.isspace():
                size[node] += len(text)
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
        return size


def squeeze(text: str) -> str:
    return " ".join(text.split())


def main_region(page: Page, out: list[bool]) -> tuple[list[bool], bool]:
    """(whether each node lies in the main region, whether an article or main element marks it): all articles that hold
    text, else the main elements that do, else all."""
    size = page._sizes(out)
    for tag in _MAIN:
        inside = [t == tag and not o and n > 0 for t, o, n in zip(page.tag, out, size, strict=True)]
        if any(inside):
            for i in range(1, len(inside)):
                inside[i] = inside[i] or inside[page.parent[i]]
            return inside, True
    return [True] * len(size), False


def candidates(page: Page, out: list[bool] | None = None) -> list[tuple[int, str]]:
    """(node, text) of the blocks that may be content: in the main region, not dropped, and, where no element marks the
    region, no menu: a bare block that is mostly links, or an entry of a list in which every entry is."""
    out = page.inherit() if out is None else out
    inside, marked = main_region(page, out)
    found, lists = [], {}
    for node, text, linked in page.blocks:
        if inside[node] and not out[node]:
            t = squeeze(text)
            if t:
                mostly = not marked and 2 * linked > len(text)
                found.append((node, t, mostly))
                if page.tag[node] == "li":
                    lists.setdefault(page.parent[node], []).append(mostly)
    menus = {p for p, links in lists.items() if len(links) > 1 and all(links)}
    return [(n, t) for n, t, mostly in found if not (mostly and (page.parent[n] in menus if page.tag[n] == "li" else page.tag[n] not in _TEXT))]


Tree = tuple  # (label, (children ...))


def skeleton(page: Page, out: list[bool]) -> tuple[Tree, list[int]]:
    """The tree without dropped nodes in which siblings of equal shape are one node, and each node's number in it
    (preorder, -1 if dropped). Nodes below ALIGNED_DEPTH levels have the number of the node around them."""
    n = len(page.tag)
    kids: list[list[int]] = [[] for _ in range(n)]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[page.parent[i]] + 1
        if not out[i] and depth[i] < ALIGNED_DEPTH:
            kids[page.parent[i]].append(i)
    shape: list = [None] * n
    for i in range(n - 1, -1, -1):
        shape[i] = (page.label[i], tuple(dict.fromkeys(shape[k] for k in kids[i])))
    number, count = [-1] * n, 0
    order: list[tuple[list[int], Tree]] = [([0], shape[0])]
    while order:
        nodes, s = order.pop()
        for i in nodes:
            number[i] = count
        count += 1
        below = {c: [] for c in s[1]}
        for i in nodes:
            for k in kids[i]:
                below[shape[k]].append(k)
        order += [(below[c], c) for c in reversed(s[1])]
    for i in range(1, n):
        if depth[i] >= ALIGNED_DEPTH and not out[i]:
            number[i] = number[page.parent[i]]
    return shape[0], number


def match(a: Tree, b: Tree, memo: dict) -> tuple[int, tuple]:
    """Simple tree matching: the most nodes that two trees with equal roots can pair in order, and which children
    pair ((i, j), ...)."""
    if a[0] != b[0]:
        return 0, ()
    if (a, b) in memo:
        return memo[a, b]
    x, y = a[1], b[1]
    w = [[match(p, q, memo)[0] for q in y] for p in x]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w[i - 1][j - 1])
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    memo[a, b] = 1 + best[-1][-1], tuple(reversed(pairs))
    return memo[a, b]


def merge(a: Tree, b: Tree, memo: dict) -> Tree:
    """The wrapper of both: paired children merge, the others stand between them as they came."""
    pairs = match(a, b, memo)[1]
    kids, i, j = [], 0, 0
    for p, q in (*pairs, (len(a[1]), len(b[1]))):
        kids += [c for c in (*a[1][i:p], *b[1][j:q])]
        if p < len(a[1]):
            kids.append(merge(a[1][p], b[1][q], memo))
        i, j = p + 1, q + 1
    return (a[0], tuple(dict.fromkeys(kids)))


def sizes(t: Tree, memo: dict) -> int:
    if t not in memo:
        memo[t] = 1 + sum(sizes(c, memo) for c in t[1])
    return memo[t]


def align(page: Tree, wrapper: Tree) -> list[int]:
    """For each node of a page's skeleton (preorder) its slot: the wrapper's node in preorder, or -1."""
    memo, size, out = {}, {}, [-1] * sizes(page, {})

    def walk(a: Tree, b: Tree, i: int, j: int) -> None:
        out[i] = j
        x, y = [i + 1], [j + 1]
        for c in a[1]:
            x.append(x[-1] + sizes(c, size))
        for c in b[1]:
            y.append(y[-1] + sizes(c, size))
        for p, q in match(a, b, memo)[1]:
            walk(a[1][p], b[1][q], x[p], y[q])

    if page[0] == wrapper[0]:
        walk(page, wrapper, 0, 0)
    return out


def to_json(t: Tree) -> list:
    return [t[0], [to_json(c) for c in t[1]]]


def from_json(x: list) -> Tree:
    return (x[0], tuple(from_json(c) for c in x[1]))
