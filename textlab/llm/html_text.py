"""Main text of web pages by minimum-cut labelling of text blocks.

Each block of text is a node. A classifier's cost becomes its capacity to the content or to the boilerplate terminal;
neighbours in page order, and the next block under the same container, are joined by edges that weigh more the
closer the blocks are in the DOM. The maximum flow splits the graph where that costs least; blocks on the content side
are the page's text. Blocks whose own cost outweighs all their edges are settled before the flow is computed,
which leaves few nodes for it and the same cut.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textlab.llm.common import as_text

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIPPED = frozenset("head template svg math object select datalist canvas audio video noscript".split())
BLOCK = frozenset("""html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup option p pre search section summary table tbody td
    tfoot th thead tr ul caption legend button""".split())
#: Opening one of these ends an open one of the same group that no container stands between.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",)}
_CONTAINERS = frozenset("html body div section article main aside nav ul ol dl table td th header footer form blockquote".split())
_ENDS_P = BLOCK - {"html", "body", "li", "dt", "dd", "tr", "td", "th", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "legend",
                   "summary", "button"}

BAD_TAGS = frozenset("nav footer aside menu dialog button search".split())
FORM_TAGS = frozenset("form fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
BAD_NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup
    login paywall sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar
    comment comments commentlist disqus reply replies respond discussion feedback related recommended recommendations trending popular
    share sharing social widget widgets pagination pager search skip copyright outbrain taboola teaser""".split())
GOOD_NAMES = frozenset("article articlebody content main post entry story body text prose".split())
#: First words of names that tell about a page, not what the part is: has-sidebar, category-social.
ABOUT = frozenset("has no not is with without hide show category cat tag type format status".split())
#: Words that are headings of an article's own sections as well.
SLUGS = frozenset("""discussion feedback related recommended recommendations popular trending social search notice notices notification
    alert consent promotion promotions advertising advertisement copyright navigation menu login subscription cookies""".split())
#: Names that say what a part is whatever its size, unless it reads as one text and nothing outside it does.
SURE = frozenset("""ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent gdpr notice notices newsletter sidebar sidebars aside
    menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus reply replies respond feedback related
    recommended recommendations trending share sharing pagination teaser""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# costs, in units of log odds times 100
OUTSIDE, INSIDE, NAMED, BAD, LINKS = -350, 300, 120, -3000, -500
TAG_COST = {"p": 100, "blockquote": 80, "pre": 80, "h1": 150, "h2": 80, "h3": 60, "h4": 40, "figcaption": 20, "li": -20, "td": -40, "th": -60}
NAME, COMPOUND, FORM, WEAK = -1200, -700, -1200, -200      # of a name, of one with other words too, of a form, of a doubtful mark
CLEARS = 0.3            # an article with this share of the page's characters ends what it inherits
MOST = 0.8              # a marked container with this share of them may be the page; with half of them, it may be doubtful
FREE = 20               # not so if this many words in sentences stand outside all marks
NEAR = 240              # weight of an edge between blocks in one container; it falls with distance in the DOM

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/<>]*)([^<>]*)>|<[!?/][^>]*>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _name_cost(value: str, tag: str, slug: bool) -> tuple[int, bool]:
    """Cost of the names in a class or id, and whether one of them is in SURE; ``slug``: an id of a section inside an article."""
    least, sure = 0, False
    for name in value.split():
        words = _WORD.findall(_CAMEL.sub(" ", name).lower())
        bad = [w in BAD_NAMES for w in words]
        if not any(bad) or words[0] in ABOUT and not all(bad):
            continue
        if len(words) > 2 and not bad[0] and not bad[-1] and any(w in GOOD_NAMES for w in words):
            continue                                            # content-sidebar-wrap holds both
        if tag in HEADINGS or slug and all(w in SLUGS for w, x in zip(words, bad) if x):
            least = min(least, WEAK)
        else:
            least = min(least, NAME if all(bad) else COMPOUND)
            sure = sure or not SURE.isdisjoint(words)
    return least, sure


class _Node:
    __slots__ = ("tag", "parent", "depth", "good", "named", "skip", "own", "heart", "up", "size", "hearts", "holds", "bad", "sure")

    def __init__(self, tag: str, parent: _Node | None, attrs: str):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.good = parent.good if parent else False
        self.named = parent.named if parent else False
        self.skip = bool(parent and parent.skip) or tag in SKIPPED
        self.own, self.heart, self.sure = 0, tag in ("article", "main"), False
        if tag in BAD_TAGS or tag == "header" and not self.good:
            self.own = BAD
        elif tag in FORM_TAGS:
            self.own = FORM
        if attrs:
            self._read(attrs)
        if self.heart:
            self.good = True
        # own: the mark's cost; heart: an article or main; up: the nearest node, itself included, that is either
        self.up = self if self.own or self.heart else parent.up if parent else None
        self.size, self.hearts, self.holds, self.bad = 0, 0, False, 0

    def _read(self, attrs: str) -> None:
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), html.unescape(next((v for v in values if v), ""))
            if name in ("class", "id"):
                if self.tag not in ("html", "body", "main") and not (name == "id" and self.tag in HEADINGS):
                    own, sure = _name_cost(value, self.tag, name == "id" and self.tag == "section" and self.good)
                    self.own, self.sure = min(self.own, own), self.sure or sure
                if not GOOD_NAMES.isdisjoint(_WORD.findall(_CAMEL.sub(" ", value).lower())):
                    self.named = True
            elif name == "role":
                if value.lower() in BAD_ROLES:
                    self.own = BAD
                elif value.lower() == "form":
                    self.own = min(self.own, FORM)
                elif value.lower() in ("main", "article"):
                    self.heart = True
            elif name == "itemprop" and value.lower() == "articlebody":
                self.good = True
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or (
                    name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                self.skip = True


def weigh(found: list[tuple[str, int, _Node]]) -> None:
    """Set ``bad`` of the nodes that are marked, or an article or main: the cost that their blocks have from marks.

    A mark is inherited until a main, or an article with a good part of the page's text, that has no mark itself. A name or
    form counts little or not at all around such a one, or around most of the text when no other article is there, no
    sentences stand outside all marks and, for a name that is plain enough, what is inside is one text.
    """
    seen: dict[int, _Node] = {}
    total = 0
    for text, _, node in found:
        total += len(text)
        top = node.up
        if top is not None:
            top.size += len(text)
        while top is not None and id(top) not in seen:
            seen[id(top)] = top
            top = top.parent.up if top.parent else None
    order = sorted(seen.values(), key=lambda n: n.depth)
    everywhere = sum(n.heart for n in order)

    def clears(n: _Node) -> bool:
        return n.heart and not n.own and (n.tag == "main" or n.size >= CLEARS * total)

    for n in reversed(order):
        n.hearts += n.heart
        n.holds = n.holds or clears(n)
        box = n.parent.up if n.parent else None
        if box is not None:
            box.size += n.size
            box.hearts += n.hearts
            box.holds = box.holds or n.holds
    free = sum(len(text.split()) for text, linked, node in found if _sentences(text, linked) and not _marked(node))
    for n in order:
        own = n.own
        if own > BAD and own:
            inside = n.parent is not None and n.parent.good
            alone = own != NAME or n.tag in FORM_TAGS or not inside and everywhere == n.hearts
            if alone and own < WEAK and n.tag not in FORM_TAGS and n.size * 2 >= total:
                alone = free < FREE and (not n.sure or _one_text(n, found))
            if n.size >= MOST * total and alone:
                own = 0
            elif n.holds or n.size * 2 >= total and alone:
                own = max(own, WEAK)
        box = n.parent.up if n.parent else None
        n.bad = own if clears(n) or box is None else min(own, box.bad)


def _sentences(text: str, linked: int) -> bool:
    return len(text) >= 40 and linked * 3 < len(text)


def _marked(node: _Node) -> bool:
    top = node.up
    while top is not None and not top.own:
        top = top.parent.up if top.parent else None
    return top is not None


def _one_text(top: _Node, found: list[tuple[str, int, _Node]]) -> bool:
    """Whether ``top`` has a first heading or an article body, or one container in it holds most of its text directly, as paragraphs
    of an article and unlike comments, teasers or entries of a list, of which each has its own."""
    size: dict[int, int] = {}
    for text, _, node in found:
        box, heading = _block_node(node), False
        up = node
        while up is not None and up is not top:
            heading = heading or up.tag == "h1"
            up = up.parent
        if up is None:
            continue
        if heading or node.good and not top.good:
            return True
        if box is not top and box.parent is not None and box.tag == "p":
            size[id(box.parent)] = size.get(id(box.parent), 0) + len(text)
    return max(size.values(), default=0) >= 0.6 * top.size


def _bad(node: _Node) -> int:
    return node.up.bad if node.up is not None else 0


def blocks(page: str) -> list[tuple[str, int, _Node]]:
    """(text, characters inside links, containing node) of the non-empty text blocks of ``page``, in order.

    Character references are decoded, white space becomes one space; scripts, styles, comments, forms' option lists and
    hidden parts give no text. Unclosed and stray tags are taken as a browser would, roughly.
    """
    out: list[tuple[str, int, _Node]] = []
    here = _Node("#page", None, "")
    parts: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, linked, here))
            parts.clear()
        linked = 0

    def add(a: int, b: int) -> None:
        nonlocal linked
        if a < b and not here.skip:
            text = page[a:b]
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += sum(map(len, text.split()))

    at, n, scan = 0, len(page), _TAG.search
    while at < n:
        m = scan(page, at)
        if m is None:
            add(at, n)
            break
        add(at, m.start())
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                links = max(0, links - 1)
            node = here
            while node and node.tag != tag:
                node = node.parent
            if node is None or node.parent is None:
                continue
            if tag not in BLOCK and any(x in BLOCK for x in _tags(here, node)):
                continue                                       # </b> does not end the blocks opened since <b>
            if tag in BLOCK:
                flush()
            here = node.parent
            continue
        attrs = m[3] or m[6] or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            if tag in ("iframe", "textarea"):
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            links = 0
            ends = CLOSES.get(tag, ()) + (("p",) if tag in _ENDS_P else ())
            node, last = here, None
            while ends and node and (node.tag in ends or node.tag not in _CONTAINERS):
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None and last.parent is not None:
                here = last.parent
        if tag in ("br", "img"):
            parts.append(" ")
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag != "a":
            continue
        if tag == "a":
            links += 1
        here = _Node(tag, here, attrs)
    flush()
    return out


def _tags(node: _Node, top: _Node) -> list[str]:
    out = []
    while node is not top:
        out.append(node.tag)
        node = node.parent
    return out


def _block_node(node: _Node) -> _Node:
    while node.tag not in BLOCK and node.parent is not None:
        node = node.parent
    return node


def cost(text: str, linked: int, node: _Node, has_article: bool) -> int:
    """Log odds (times 100) that a block is content."""
    words = len(text.split())
    s = -60 + min(200, int(60 * math.log1p(words))) + TAG_COST.get(_block_node(node).tag, -30)
    if node.good:
        s += INSIDE
    elif has_article:
        s += OUTSIDE
    if node.named:
        s += NAMED
    s += _bad(node)
    if linked:
        s += int(LINKS * min(1.0, linked / max(1, sum(map(len, text.split())))))
    if text[-1] in ".!?…\"”»" and words > 4:
        s += 60
    return s


def _distance(a: _Node, b: _Node) -> int:
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


def edges(nodes: list[_Node]) -> list[tuple[int, int, int]]:
    """(i, j, weight): blocks next to each other, and each block with the next one in its parent's container."""
    out, last = [], {}
    for i, node in enumerate(nodes):
        if i:
            out.append((i - 1, i, NEAR // (1 + max(0, _distance(nodes[i - 1], node) - 2))))
        box = id(node.parent)
        before = last.get(box)
        if before is not None and before < i - 1:
            out.append((before, i, NEAR // 2))
        last[box] = i
    return out


def minimum_cut(score: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut: node i has capacity ``score[i]`` from the source if positive,
    ``-score[i]`` to the sink if negative; ``links`` are undirected edges."""
    n, s = len(score), list(score)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in links:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    total = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    todo = deque(i for i in range(n) if abs(s[i]) >= total[i])
    while todo:                                      # a node that outweighs its edges has the same label in some minimum cut
        i = todo.popleft()
        if label[i] is not None:
            continue
        label[i] = s[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                s[j] += w if label[i] else -w
                total[j] -= w
                del near[j][i]
                if abs(s[j]) >= total[j]:
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _flow_side([s[i] for i in rest], rest, near, label)):
            label[i] = side
    return [bool(x) for x in label]


def _flow_side(s: list[int], rest: list[int], near: list[dict[int, int]], label: list) -> list[bool]:
    """Source side after a maximum flow (shortest augmenting paths by levels, iterative)."""
    place = {i: k for k, i in enumerate(rest)}
    n = len(rest)
    source, sink = n, n + 1
    cap: list[dict[int, int]] = [{} for _ in range(n + 2)]
    for k, i in enumerate(rest):
        for j, w in near[i].items():
            if j in place:
                cap[k][place[j]] = w
        if s[k] > 0:
            cap[source][k], cap[k][source] = s[k], 0
        elif s[k] < 0:
            cap[k][sink], cap[sink][k] = -s[k], 0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [k in level for k in range(n)]
        nexts = {u: iter(list(cap[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= push
                    cap[b][a] += push
                keep = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] == 0)
                del path[keep + 1:]
                nexts[path[-1]] = iter(list(cap[path[-1]]))
                continue
            for v in nexts[u]:
                if cap[u][v] > 0 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                if path:
                    level[u] = -1


def main_text(page: str) -> str:
    """The main text of ``page``: content blocks in page order joined by newlines, empty if there are none."""
    found = blocks(page)
    if not found:
        return ""
    weigh(found)
    has_article = any(node.good and _bad(node) >= WEAK for _, _, node in found)
    score = [cost(text, linked, node, has_article) for text, linked, node in found]
    keep = minimum_cut(score, edges([_block_node(node) for _, _, node in found]))
    return "\n".join(text for (text, _, _), yes in zip(found, keep) if yes)


def _main_texts(column: pa.Array) -> pa.Array:
    return pa.array([main_text(page) for page in as_text(column)], pa.string())


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null or empty html has empty text; ids and urls are only carried and may be null or repeat; an empty table gives an
    empty result; other columns are not read. One pass, no shuffle.
    """
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        arrow_udf(_main_texts, "string")(F.col(page)).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))
