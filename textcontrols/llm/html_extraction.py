"""Main text of HTML pages by composite text density.

Each page is parsed into a tree.  Elements that never hold the article
(scripts, menus, forms, ...) are left out.  A class or id that speaks of
nothing but notices, adverts, comments and the like lowers a container's claim
to be the article, never that of a heading, paragraph or inline element; such a node is left out unless it holds the article all the same (the
node of the largest claim, or an ``article`` or ``main`` element), has only
words of such a one, or lies within the article, or as one of several sections beside it, under a word
that articles use too (a discussion, a notice): then densities decide.  Every
other node gets its composite text density: characters for each tag, adjusted
by the share of characters and tags that lie in links.  A node's density sum
adds the densities of its children.  The node with the largest sum marks the
article; the least density on its path from the body is the threshold, and
each branch up to the body that reaches it, at its size, is read too, without the containers
below it beside the path to the branch's own node of the largest sum.

Defined results: null, empty and tag-only pages give an empty text and 0; an
unclosed or unopened tag is closed as browsers do; a page of any length is
parsed whole in one pass; repeated rows get equal results; ties go to the node
that comes first; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textcontrols.llm.work import require, text_udf

_SPLIT = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<end2>/)?(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)  # the last: with a quote left open
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section
summary table tbody td tfoot th thead tr ul""".split()) - {"br"}
#: A start tag of the first kind ends an open element of the others.
ENDS = {"li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
        "tbody": "tr td th thead tbody", "tfoot": "tr td th tbody"}
SCOPE = frozenset("ul ol dl table td th div article section main body blockquote aside nav header footer form".split())
CONTAINERS = frozenset("div section ul ol dl table fieldset details center hgroup address".split())
CLOSES_P = BLOCK - {"body", "html", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}

#: Elements, ARIA roles and words of class or id that mark what is not the article.
SKIP_TAGS = RAW | frozenset("head nav header footer aside form button select input svg canvas object menu dialog".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
SKIP_WORDS = frozenset("""ad ads advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promos
promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead
comment comments disqus respond reply replies discussion cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay newsletter
subscribe subscription signup login share sharing social related recommended pagination pager toolbar widget widgets
skip hidden""".split())
#: Such words that an article's own sections and boxes use too: within the article the density decides.
SHARED_WORDS = frozenset("""discussion related notice notices alert header footer share sharing social reply replies respond disclaimer
banner consent promotion widget widgets recommended subscription signup login menu menus modal overlay popup toolbar search""".split())
#: A class or an id speaks of these only if it has no other words than them and words of place and layout.
LAYOUT_WORDS = frozenset("""a area article bar block blog body bottom box col column container content div entry fixed global group holder
info inline inner item items left list lists main medium outer page panel post posts primary reader readers right row secondary section
site slot small sticky style text thread top unit user users view warning wrap wrapper""".split())
#: What densities count for in the sums at and below a node with such a word.
LOWERED = 0.25


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "skip", "weak", "claim", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", skip: bool = False, weak: frozenset = frozenset()):
        self.tag, self.parent, self.skip, self.weak = tag, parent, skip, weak
        self.claim = LOWERED if weak else parent.claim if parent else 1.0
        self.children: list[Node] = []
        self.parts: list = []  # strings and nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _skipped(tag: str, attrs: str) -> tuple[bool, frozenset]:
    """Is an element left out, and the words of its class or id that lower its claim."""
    weak: frozenset = frozenset()
    if tag in SKIP_TAGS:
        return True, weak
    if not attrs.strip():
        return False, weak
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if tag in ("html", "body", "main", "article"):
            break
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, weak
        if key == "role" and value.lower() in SKIP_ROLES:
            return True, weak
        if key in ("class", "id") and tag in CONTAINERS:
            for name in value.split():
                words = {w.lower() for w in _NAME.findall(name)}
                if all(w in SKIP_WORDS or w in LAYOUT_WORDS or w.isdigit() for w in words):
                    weak |= words & SKIP_WORDS
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, weak
    return False, weak


def parse(page: str) -> Node:
    """The tree of a page; nodes that are left out are kept in it with ``skip`` set."""
    root = Node("html", None)
    at, node, end_of = 0, root, len(page)

    def say(text: str) -> None:
        if text and not node.skip:
            node.parts.append(html.unescape(text))

    while at < end_of:
        m = _SPLIT.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        if m["cdata"] is not None and not node.skip:
            node.parts.append(m["cdata"])
        tag, attrs = (m["tag"] or m["tag2"] or "").lower(), m["attrs"] or m["attrs2"] or ""
        if not tag:
            continue
        if m["end"] or m["end2"]:
            above = node
            while above is not None and above.tag != tag:
                above = above.parent if tag in BLOCK or above.tag not in SCOPE else None
            if above is not None and above.parent is not None:
                node = above.parent
            continue
        if tag in ("html", "body") and node.parent is not None or tag == "html":
            if node.tag != "head":
                continue
        if tag in ENDS or tag in CLOSES_P or node.tag == "head" and tag not in SKIP_TAGS | VOID:
            closed = set(ENDS.get(tag, "").split()) | ({"p"} if tag in CLOSES_P else set())
            closed |= {"head"} if node.tag == "head" and tag not in SKIP_TAGS | VOID else set()
            above = node
            while above.parent is not None:
                if above.tag in closed:
                    node = above.parent
                    if above.tag in ("p", "li", "head"):
                        break
                elif above.tag in SCOPE:
                    break
                above = above.parent
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
            at = close.end() if close else end_of
            node.parts.append(" ")
            continue
        skip, weak = _skipped(tag, attrs)
        child = Node(tag, node, node.skip or skip, weak)
        node.children.append(child)
        node.parts.append(child)
        if tag not in VOID and not attrs.rstrip().endswith("/"):
            node = child
    return root


def _order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    found = [root]
    for node in found:
        found.extend(node.children)
    return found


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    plain = max(1, chars - link_chars)
    base = chars / plain * link_chars + share * chars + math.e
    inner = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return chars / tags * math.log(max(1.0, inner)) / math.log(math.log(base) + math.e - 1)


def _length(text: str) -> int:
    return len(_SPACE.sub(" ", text).strip())


def densities(root: Node) -> list[Node]:
    """Set characters, tags, densities and density sums; the nodes, parents first."""
    nodes = _order(root)
    for node in reversed(nodes):
        node.chars = 0 if node.skip else sum(_length(p) for p in node.parts if isinstance(p, str))
        node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            node.chars += c.chars
            node.tags += c.tags + 1
            node.link_chars += c.link_chars
            node.link_tags += c.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    share = root.link_chars / max(1, root.chars)
    for node in nodes:
        node.density = 0.0
        if node.chars:
            node.density = _density(node.chars, max(1, node.tags), node.link_chars, node.link_tags, share)
    for node in nodes:
        node.total = sum(c.density * c.claim for c in node.children if not c.skip)
        if any(isinstance(p, str) and p.strip() for p in node.parts):
            node.total = max(node.total, node.density * node.claim)
    return nodes


def article(root: Node) -> bool:
    """Set ``skip`` on what is not the article; False if the page has no text.

    The node of the largest density sum is the core.  The threshold is the
    least density from it up to the body.  From the core to the outermost
    ``article`` or ``main`` around it, or else to below the body, containers
    below the threshold go.  Above, each branch, and each run of text between
    branches, stays if it reaches the threshold; of a branch that does not,
    each ``article`` or ``main`` that does.
    """
    nodes = [n for n in densities(root) if n.chars and not n.skip]
    if not nodes:
        return False
    core = max(nodes, key=lambda n: n.total)
    doubtful: list[Node] = []
    if any(n.weak for n in nodes):
        held = {id(a) for n in nodes if n is core or n.tag in ("article", "main") for a in (n, *_above(n))}
        said = frozenset().union(*(n.weak for n in nodes if id(n) in held))
        spoken = [n for n in nodes if n.weak and id(n) not in held and not n.weak <= said]
        holder = next((n for n in [core, *_above(core)] if n.tag in ("article", "main")), core)
        doubtful = [n for n in spoken if n.weak <= SHARED_WORDS and (holder in _above(n) or _one_of_sections(n))]
        weak = {id(n) for n in spoken} - set(map(id, doubtful))
        below: set[int] = set()
        for n in _order(root)[1:]:
            if id(n) in weak or id(n.parent) in below:
                below.add(id(n))
        if any(id(n) not in below and any(isinstance(p, str) and p.strip() for p in n.parts) for n in nodes):  # some text is left
            for n in _order(root):
                n.skip = n.skip or id(n) in below
        nodes = [n for n in densities(root) if n.chars and not n.skip]
        core = max(nodes, key=lambda n: n.total)
    while core.tag not in BLOCK and core.parent is not None:
        core = core.parent
    with_body = any(n.tag == "body" for n in [core, *_above(core)])
    path = [core, *(a for a in _above(core) if a is not root or not with_body)]
    reaches = _threshold(core, path, root.link_chars / max(1, root.chars))
    for n in doubtful:
        n.skip = n.skip or not reaches(n)
    named = [n for n in path if n.tag in ("article", "main")]
    inner = [n for n in path if n.tag != "body" and n is not root] or path
    near = path.index(named[-1] if named else inner[-1]) + 1
    _trim(path[:near], reaches)
    above = path[near:] if path[-1] is root else [*path[near:], root]
    _branches(above, set(map(id, path)), reaches, {id(a) for n in nodes if n.tag in ("article", "main") for a in (n, *_above(n))})
    return True


def _one_of_sections(node: Node) -> bool:
    """Do two or more containers of the same tag stand beside it that no word speaks against?"""
    beside = [c for c in node.parent.children if c is not node and c.tag == node.tag and c.chars and not c.skip and not c.weak] if node.parent else []
    return node.tag == "section" and len(beside) > 1


def _threshold(core: Node, path: list[Node], share: float):
    """Function of a run of strings and nodes: does it reach the least density on the path?

    Composite density grows with the size at equal characters a tag, so a part
    is held against what the path's node of the least density would have if it
    were of the part's size; a short part of an article counts as a long one.
    """

    def scaled(n: Node, chars: int) -> float:
        f = chars / n.chars
        return _density(chars, max(1, n.tags) * f, n.link_chars * f, n.link_tags * f, share)

    lowest = min(path, key=lambda n: scaled(n, core.chars))

    def reaches(*run) -> bool:
        inline = [y for y in run if isinstance(y, Node) and not y.skip]
        chars = sum(_length(y) if isinstance(y, str) else y.chars for y in run)
        tags = inline[0].tags if len(run) == len(inline) == 1 else sum(y.tags + 1 for y in inline if y.tag != "br")
        links = sum(y.link_chars for y in inline), sum(y.link_tags for y in inline)
        return chars > 0 and _density(chars, max(1, tags), *links, share) >= scaled(lowest, chars) * (1 - 1e-9)

    return reaches


def _trim(path: list[Node], reaches) -> None:
    """Leave out the containers below the threshold beside a path that leads upwards."""
    for child, n in zip(path, path[1:]):
        for c in n.children:
            if c is not child and c.tag in CONTAINERS and not reaches(c):
                c.skip = True


def _branches(above: list[Node], path: set[int], reaches, holders: set[int]) -> None:
    """Leave out what lies below the threshold in the nodes ``above``, and so on in branches that hold an article."""
    todo, held = [(n, False) for n in above], path | holders
    for n, low in todo:
        parts, run = [], []
        for x in [*n.parts, None]:
            if isinstance(x, str) or x is not None and x.tag not in BLOCK and id(x) not in held:
                run.append(x)
                continue
            if not low and reaches(*run):
                parts += run
            run = []
            if x is None:
                break
            parts.append(x)
            if id(x) in path or x.skip or not x.chars:
                continue
            if reaches(x):
                best = max((y for y in _order(x) if y.chars and not y.skip), key=lambda y: y.total)
                up = [best, *_above(best)]
                _trim(up[:up.index(x) + 1], reaches)
            elif id(x) in holders and x.tag not in ("article", "main"):
                todo.append((x, True))
            else:
                x.skip = True
        n.parts = parts


def _above(node: Node) -> list[Node]:
    found = []
    while node.parent is not None:
        node = node.parent
        found.append(node)
    return found


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, white space as one space, without empty ones."""
    found: list[list[str]] = [[]]
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            found[-1].append(x)
        elif x is None:
            found.append([])
        elif not x.skip:
            cut = x.tag in BLOCK
            todo.extend([None] * cut + x.parts[::-1] + [None] * cut)
            if x.tag == "br":
                found[-1].append(" ")
    return [t for t in (_SPACE.sub(" ", "".join(b)).strip() for b in found) if t]


def main_text(page: str) -> str:
    if not page or not page.strip():
        return ""
    root = parse(page)
    return "\n".join(blocks(root)) if article(root) else ""


def _start():
    def step(page: str) -> tuple:
        text = main_text(page)
        return text, len(text)

    return step


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row for each page: the columns ``keep``, text and n_chars."""
    require(pages, html_column, *keep)
    call = text_udf(_start, "text string, n_chars long")
    return pages.select(F.struct(*keep).alias("k"), call(F.col(html_column)).alias("r")).select("k.*", "r.*")
