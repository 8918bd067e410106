"""Main text of web pages by scoring the tree of elements.

A paragraph passes points for its length and commas to its ancestors, the nearest ones getting most. An element's points
are discounted by its link density. The best container and those of its siblings that look like text are kept.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, SparkSession

from crawlframe.llm.common import map_rows, table

# Element names by their role in HTML.
SKIPPED = frozenset(("script style noscript template svg math iframe object embed canvas audio video head form button "
                     "select option textarea input nav footer aside dialog menu").split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
                   "summary table tbody td tfoot th thead tr ul").split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body legend summary".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "tbody": ("tr", "td", "th", "tbody", "thead"), "option": ("option",)}
#: Elements in which a search for an element to close ends.
FENCE = frozenset("ul ol dl table article section div main body html aside nav header footer form blockquote".split())

#: Words in class, id or role that mark what is not the article.
CLUTTER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banners?|sponsor(?:ed|s)?|promos?|promotions?|"
    r"comments?|commentlist|disqus|respon[ds]|replies|discussion|reviews?|nav|navbar|navigation|menus?|breadcrumbs?|"
    r"sidebars?|side|aside|rail|widgets?|footer|foot|header|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alerts?|"
    r"popups?|modals?|overlays?|newsletter|subscri(?:be|ption)|signup|login|paywall|share|sharing|social|related|"
    r"recommended|recommendations|pagination|pager|tags|toc|search|hidden|copyright|legal|disclaimer|contentinfo|"
    r"complementary)(?=$|[\s_-]|\d)", re.I)
#: Of those, the ones for what readers wrote, which may well be longer than the article.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respon[ds]|replies|discussion|reviews?)(?=$|[\s_-]|\d)", re.I)
#: Names that overrule the above on the elements that hold the article, unless one name says both ("comment-body").
CONTENT = re.compile(r"(?:^|[\s_-])(?:articles?|article[_-]?body|post|post[_-]?(?:body|content)|entry|entry[_-]?content|content|main|story|body|text)(?=$|[\s_-]|\d)", re.I)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<self>/?)>", re.S)
LOOSE = re.compile(r"<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)(?P<self>)(?:>|\Z)", re.S)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
BLANKS = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "children", "skip", "soft", "marked", "points", "chars", "linked", "order")

    def __init__(self, name: str, parent: Node | None, skip: bool, marked: bool, order: int):
        self.name, self.parent, self.skip, self.marked, self.order = name, parent, skip, marked, order
        self.soft = 0  # skipped by its name only: 1, or 2 where readers write
        self.children: list[Node | str] = []
        self.points = 0.0
        self.chars = self.linked = 0


def judge_attributes(name: str, attrs: str) -> tuple[bool, int, bool]:
    """Whether the element is hidden, whether its names speak for clutter (2: for readers' texts), and whether for content."""
    if not attrs or attrs.isspace():
        return False, 0, False
    names, gone = "", False
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            names += " " + value
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            gone = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            gone = True
    wanted = bool(CONTENT.search(names))
    clutter = bool(CLUTTER.search(names)) and name not in ("body", "html", "article", "main")
    if clutter and wanted:
        clutter = not any(CONTENT.search(x) and not CLUTTER.search(x) for x in names.split())
    return gone, (2 if READERS.search(names) else 1) if clutter else 0, wanted


def parse(page: str) -> Node:
    """Tree of elements and undecoded texts; unclosed elements end with their parents, truncated pages at their end."""
    root = here = Node("html", None, False, False, 0)
    at, order, n = 0, 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            here.children.append(page[at:])
            break
        if lt > at:
            here.children.append(page[at:lt])
        m = TOKEN.match(page, lt)
        if m is None:
            nxt = page[lt + 1:lt + 2]
            m = LOOSE.match(page, lt) if nxt.isalpha() or nxt == "/" else None
            if m is None:
                here.children.append("<")
                at = lt + 1
                continue
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            node = here
            while node is not None and node.name != name and not (name not in FENCE and node.name in FENCE):
                node = node.parent
            if node is not None and node.name == name and node.parent is not None:
                here = node.parent
            elif name == "p":
                order += 1
                here.children.append(Node("p", here, False, False, order))
            continue
        if name == "html":
            continue
        if name in CLOSES_P:
            node = here
            while node is not None and node.name != "p" and node.name not in FENCE and node.name not in ("td", "th", "li"):
                node = node.parent
            if node is not None and node.name == "p":
                here = node.parent
        if name in CLOSED_BY:
            node = here
            while node is not None and node.name not in FENCE:
                if node.name in CLOSED_BY[name]:
                    here = node.parent
                node = node.parent
        gone, clutter, marked = judge_attributes(name, m["attrs"])
        order += 1
        if name in VOID or m["self"] and name not in BLOCK and name not in RAW:
            here.children.append(Node(name, here, name in SKIPPED, False, order))
            continue
        hard = name in SKIPPED and name != "form" or gone or name in RAW
        soft = clutter or int(name == "form" or name == "header" and not inside(here, ("article", "main")))
        child = Node(name, here, hard or soft > 0, marked, order)
        child.soft = 0 if hard else soft
        here.children.append(child)
        if name in RAW:
            end = re.compile(f"</{name}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        here = child
    reprieve(root)
    return root


def reprieve(root: Node) -> None:
    """Elements that are skipped for their names, and forms, stay if they hold the article: an article or main element when
    there is none elsewhere, or most of the page's paragraph text."""
    nodes: list[tuple[Node, int, bool, bool]] = []  # with the place of the parent, whether in a paragraph, whether skipped
    stack: list[tuple[Node, int, bool, bool]] = [(root, -1, False, False)]
    soft = elsewhere = False
    while stack:
        node, up, para, skipped = stack.pop()
        if node.skip and not node.soft:
            continue
        para, skipped, soft = para or node.name in ("p", "pre", "blockquote"), skipped or node.skip, soft or node.soft > 0
        elsewhere = elsewhere or not skipped and node.name in ("article", "main")
        at = len(nodes)
        nodes.append((node, up, para, skipped))
        stack += [(x, at, para, skipped) for x in node.children if not isinstance(x, str)]
    if not soft:
        return
    for wide in (False, True):  # all text if there are no paragraphs
        chars, holds = [0] * len(nodes), [False] * len(nodes)
        for at in range(len(nodes) - 1, -1, -1):
            node, up, para, _ = nodes[at]
            if para or wide:
                chars[at] += sum(len(x.strip()) for x in node.children if isinstance(x, str))
            holds[at] = holds[at] or node.name in ("article", "main")
            if up >= 0:
                chars[up] += chars[at]
                holds[up] = holds[up] or holds[at]
        if chars[0]:
            break
    for (node, *_), n, held in zip(nodes, chars, holds, strict=True):
        if node.soft and (held and not elsewhere and node.soft == 1 or n > (9 if node.soft == 2 or elsewhere else 1) * (chars[0] - n)):
            node.skip = False


def inside(node: Node | None, names: tuple[str, ...]) -> bool:
    while node is not None:
        if node.name in names:
            return True
        node = node.parent
    return False


def blocks_of(root: Node) -> list[tuple[Node, str]]:
    """Text blocks outside of clutter in page order with the block element that holds each; scores chars and links."""
    out: list[tuple[Node, str]] = []
    held: list[str] = []
    holder = [root]

    def flush() -> None:
        text = BLANKS.sub(" ", html.unescape("".join(held)).replace("\0", "")).strip()
        held.clear()
        if text:
            out.append((holder[0], text))

    stack: list[tuple[Node, int]] = [(root, 0)]
    links = 0
    while stack:
        node, i = stack.pop()
        if i == 0:
            if node.skip:
                if node.name in BLOCK:
                    flush()
                continue
            if node.name in BLOCK:
                flush()
                holder[0] = node
            elif node.name == "br":
                held.append(" ")
            if node.name == "a":
                links += 1
        if i < len(node.children):
            stack.append((node, i + 1))
            child = node.children[i]
            if isinstance(child, str):
                held.append(child)
                size = len(child.strip())
                if size:
                    up: Node | None = node
                    while up is not None:
                        up.chars += size
                        up.linked += size if links else 0
                        up = up.parent
            else:
                stack.append((child, 0))
            continue
        if node.name == "a":
            links -= 1
        if node.name in BLOCK:
            flush()
            holder[0] = block_parent(node)
    flush()
    return out


def block_parent(node: Node) -> Node:
    up = node.parent
    while up is not None and up.parent is not None and up.name not in BLOCK:
        up = up.parent
    return up if up is not None else node


PARAGRAPHS = frozenset("p pre blockquote li td dd h1 h2 h3 h4 h5 h6 figcaption dt".split())


def extract(page: str | None) -> str:
    """Main text: blocks joined by line feeds, each with single spaces. Null, empty and textless pages give ''."""
    if not page:
        return ""
    root = parse(page)
    blocks = blocks_of(root)
    if not blocks:
        return ""
    scored: dict[int, Node] = {}
    for node, text in blocks:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        if len(text) < 25 and node.name not in ("p", "pre"):
            points *= 0.2
        up, level = (node.parent if node.name in PARAGRAPHS else node), 0
        while up is not None and level < 5:
            if up.name in BLOCK or up.parent is None:
                if id(up) not in scored:
                    scored[id(up)] = up
                    up.points += {"article": 25, "main": 15}.get(up.name, 0) + (10 if up.marked else 0)
                up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                level += 1
            up = up.parent
    density = lambda x: x.linked / x.chars if x.chars else 0.0
    value = lambda x: x.points * (1 - density(x))
    best = max(scored.values(), key=lambda x: (value(x), -x.order))
    for up in ancestors(best):
        if up.name == "article" and value(up) > 0.3 * value(best):
            best = up
            break
    kept = {id(best)}
    if best.parent is not None:
        least = max(10.0, 0.2 * value(best))
        for x in best.parent.children:
            if isinstance(x, str) or x is best or x.skip:
                continue
            if id(x) in scored and value(x) >= least and density(x) < 0.5:
                kept.add(id(x))
            elif x.name in ("p", "h1", "h2", "h3", "blockquote", "pre") and x.chars and density(x) < 0.25 and best.name != "article":
                kept.add(id(x))
    out = []
    for node, text in blocks:
        up: Node | None = node
        while up is not None and id(up) not in kept:
            up = up.parent
        if up is not None:
            out.append(text)
    return "\n".join(out)


def ancestors(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


def extract_text(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` of every page. Repeated rows give one row each."""
    def work(rows: dict):
        texts = [extract(x) for x in rows["_html"]]
        return {k: rows[k] for k in keep} | {"text": texts, "n_chars": [len(t) for t in texts]}

    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", text string, n_chars long"
    return map_rows(pages.select(*keep, pages[html_column].alias("_html")), work, schema)


def op3_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, folder, "pages"))
