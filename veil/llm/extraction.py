"""Main text of web pages by tree scoring.

The page becomes a light tree. Subtrees that are boilerplate by tag, role or class are set aside. Each
paragraph passes points for its length and commas to its ancestors, fewer with distance; a container's points
are discounted by the share of its text that is links. The container with most points marks the place; all that
isn't set aside in its article or main element is kept, of any length. Where there is none, all is kept in the lowest
ancestor that holds its siblings and the page's h1, except blocks beside it that are mostly links. Blocks are joined
in page order.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, texts_of, tidied

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't markup; it ends at their own end tag only.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template object".split())
#: A header of an article or main element is kept: it holds the heading and the lead.
DROPPED = RAW | frozenset("head nav footer aside form button select option datalist dialog menu input canvas audio video map desc defs metadata annotation annotation-xml".split())
BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd figcaption h1 h2 h3 h4 h5 h6 div section article main body".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words in a class or id of what isn't the article.
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored comment comments reply replies disqus discussion sidebar aside rail nav navbar navigation menu breadcrumb breadcrumbs "
    "footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended widget widgets toolbar pagination pager login search hidden skip".split()
)
#: Words that say that another class word is about the surroundings, as in `with-sidebar`.
ABOUT = frozenset("with has no without".split())
LIKELY = frozenset("article content main post entry story body text page blog".split())
#: Words that say nothing beside an unlikely one, as in `ad-box`.
NEUTRAL = LIKELY | frozenset("box bar wrapper wrap container block area section list inner outer left right top bottom item link links panel label line row".split())
#: What an element of these tags holds is judged by its class only if the class says nothing else.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption span b i em strong a q cite code mark small sub sup u label".split())
PENALTY = 25.0
KEPT_TAGS = frozenset("html body article main".split())
#: A start tag of the first ends an open element of the second, up to a scope element.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPE = frozenset("ul ol dl table article section div body main html blockquote td th".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: A quote opens a string only right after =; an unquoted value goes up to white space or >.
_REST = re.compile(r"""(?>(?:[^>=]+|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)*)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""", re.I)
_WORDS = re.compile(r"[^\W_]+")


class Node:
    __slots__ = ("tag", "parent", "dropped", "bonus", "named", "inside", "chars", "linked", "points", "children")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, bonus: float, named: bool = False):
        self.tag, self.parent, self.dropped, self.bonus, self.named = tag, parent, dropped, bonus, named
        self.inside = named or parent is not None and parent.inside  # an article or main element
        self.chars = self.linked = 0
        self.points = 0.0
        self.children: list[Node | str] = []
        if parent is not None:
            parent.children.append(self)


def _judged(tag: str, attributes: str, parent: Node) -> tuple[bool, float, bool]:
    """Whether the element is boilerplate, points for its tag and class, and whether it is an article or main by tag or role."""
    named = tag in ("article", "main")
    bonus = 25.0 * named
    if tag in DROPPED or tag == "header" and not parent.inside:
        return True, bonus, named
    unlikely = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            unlikely |= value.strip() in DROPPED_ROLES
            bonus += 25.0 * (value.strip() in ("main", "article"))
            named |= value.strip() in ("main", "article")
        elif name in ("class", "id"):
            for item in value.split():
                found = _WORDS.findall(item)
                words = set(found)
                if words & UNLIKELY and not words & ABOUT:
                    # `post-comments` are comments; a `notice-board-story` is a story, if of less weight.
                    if words <= UNLIKELY | NEUTRAL if tag in TEXT else found[-1] not in LIKELY or words <= UNLIKELY | NEUTRAL:
                        unlikely = True
                    else:
                        bonus -= PENALTY
                elif words & LIKELY:
                    bonus += 10.0
        elif name == "style":
            unlikely |= "display:none" in value.replace(" ", "")
        else:
            unlikely |= name == "hidden" or value == "true"
    # An article within another is judged like any block: reader comments may be articles of their own.
    return unlikely and (tag not in KEPT_TAGS or tag == "article" and parent.inside), bonus, named


def parse(html: str) -> tuple[Node, list[Node]]:
    """The page's tree, and its nodes in page order."""
    root = Node("html", None, False, 0.0)
    nodes, top, at, size = [root], root, 0, len(html)
    stack = [root]
    opened: Counter[str] = Counter()  # of the stack's tags, but for the root: no search goes up it in vain

    def close(to: int) -> None:
        while len(stack) > to:
            opened[stack.pop().tag] -= 1

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            top.children.append(html[at:lt])
        if lt == size:
            break
        m = _NAME.match(html, lt)
        if m is None:
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            elif html.startswith(("<!", "<?", "</"), lt):
                end = html.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                top.children.append("<")
                at = lt + 1
            continue
        rest = _REST.match(html, m.end())
        if rest is None:
            end = html.find(">", m.end())
            if end < 0:
                break  # the page ends inside a tag
            attributes, at = html[m.end() : end], end + 1
        else:
            attributes, at = rest[0][:-1], rest.end()
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                while stack[-1].tag != tag:
                    close(len(stack) - 1)
                close(len(stack) - 1)
                top = stack[-1]
            continue
        if tag == "html" or tag == "body" and opened["body"]:
            continue
        if tag in BLOCK and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPE or stack[i].tag in DROPPED:
                    break
        if tag in ENDS and any(opened[x] for x in ENDS[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ENDS[tag]:
                    close(i)
                    if tag in ("li", "dt", "dd", "td", "th"):
                        break
                elif stack[i].tag in SCOPE:
                    break
        if tag == "body":
            close(1)  # an unclosed head ends here
        top = stack[-1]
        dropped, bonus, named = _judged(tag, attributes, top)
        node = Node(tag, top, dropped or top.dropped, bonus, named)
        nodes.append(node)
        if tag in VOID or attributes.endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            if end is None:
                break
            last = html.find(">", end.start())
            at = size if last < 0 else last + 1
            continue
        stack.append(node)
        opened[tag] += 1
        top = node
    return root, nodes


def _without_page_headers(nodes: list[Node]) -> None:
    """Set aside the headers of a main element that stand outside its articles: they are the page's."""
    if not any(node.tag == "article" for node in nodes):
        return
    within: dict[int, bool] = {}
    for node in nodes:
        above = node.parent is not None and within[id(node.parent)]
        within[id(node)] = above or node.tag == "article"
        node.dropped |= node.parent is not None and node.parent.dropped or node.tag == "header" and not above


def _score(nodes: list[Node]) -> Node | None:
    """Points of all nodes, and the best container."""
    for node in reversed(nodes):
        if node.dropped:
            continue
        own = 0
        commas = 0
        for child in node.children:
            if isinstance(child, str):
                own += len(" ".join(child.split()))
                commas += child.count(",")
            elif not child.dropped:
                node.chars += child.chars
                node.linked += child.linked
                if child.tag not in BLOCK:
                    own += child.chars - child.linked
        node.chars += sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.linked = node.chars
        if own and node.tag in PARAGRAPH:
            points = min(1.0, own / 25) + commas + min(own / 100, 3.0)
            above = node if node.tag in ("div", "section", "article", "main", "body") else node.parent
            share = 1.0
            for level in range(5):
                if above is None:
                    break
                above.points += points * share
                share = 0.5 if level == 0 else share / 1.5
                above = above.parent
    best, most = None, 0.0
    for node in nodes:
        if node.dropped or not node.chars or node.tag not in BLOCK or node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "tr", "td", "th", "html"):
            continue
        node.points = (node.points + node.bonus) * (1 - node.linked / node.chars)
        if best is None or node.points > most:
            best, most = node, node.points
    return best


def _kept(nodes: list[Node], best: Node) -> list[Node]:
    """The subtrees that make up the main text, in page order; blocks of links beside the best container are set aside."""
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    titled: set[int] = set()
    for node in nodes:
        if node.tag == "h1" and not node.dropped and node.chars:
            above: Node | None = node
            while above is not None and id(above) not in titled:
                titled.add(id(above))
                above = above.parent
    named = [i for i, node in enumerate(path) if node.named]
    if not named:
        at = 0 if best.tag == "body" else 1
        at = next((i for i in range(at, len(path)) if id(path[i]) in titled), at)
        for node in path[:at]:
            for beside in node.parent.children:
                if isinstance(beside, Node) and beside is not node and beside.tag in BLOCK and beside.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and 2 * beside.linked > beside.chars:
                    beside.dropped = True
        return [path[at]]
    region = path[named[-1]]
    chosen = {id(region)}
    level = max(10.0, 0.2 * best.points)
    for sibling in region.parent.children if region.parent is not None and region.tag != "body" else []:
        if isinstance(sibling, str) or sibling.dropped:
            continue
        density = sibling.linked / sibling.chars if sibling.chars else 0.0
        if sibling.points >= level or sibling.tag == "p" and sibling.chars > 80 and density < 0.25:
            chosen.add(id(sibling))
    if id(region) not in titled:  # its heading may stand before it
        chosen.update(id(x) for above in path[named[-1] + 1 :] for x in above.children if isinstance(x, Node) and x.tag == "h1" and not x.dropped)
    return [node for node in nodes if id(node) in chosen]


def _blocks(node: Node, blocks: list[str], parts: list[str]) -> None:
    """The node's blocks in page order; iterative, since pages may nest deeply."""
    work: list[tuple[Node | str, bool]] = [(node, False)]
    while work:
        item, closing = work.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        if item.tag in BLOCK:
            _flush(blocks, parts)
        if closing:
            continue
        if item.tag == "br":
            parts.append(" ")
        if item.dropped:
            continue
        if item.tag in BLOCK:
            work.append((item, True))
        work.extend((child, False) for child in reversed(item.children))


def _flush(blocks: list[str], parts: list[str]) -> None:
    text = " ".join(references.unescape("".join(parts)).split())
    parts.clear()
    if text:
        blocks.append(text)


def main_text(html: str | None) -> str:
    """The page's main text; blocks are joined by one newline. Null, empty and text-free pages give ''."""
    if not html:
        return ""
    root, nodes = parse(html)
    _without_page_headers(nodes)
    best = _score(nodes)
    if best is None:
        blocks: list[str] = []
        parts: list[str] = []
        _blocks(root, blocks, parts)
        _flush(blocks, parts)
        return "\n".join(blocks)
    blocks, parts = [], []
    for node in _kept(nodes, best):
        _blocks(node, blocks, parts)
        _flush(blocks, parts)
    return "\n".join(blocks)


def extract(df: DataFrame, html: str = "html", max_slice_bytes: int = 4 << 20) -> DataFrame:
    """df's rows with text and n_chars (code points) added; columns of these names are replaced.

    Null and empty html give an empty text. Pages of any length are parsed whole. Repeated rows are kept; an
    empty table gives an empty result.
    """
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c not in ("text", "n_chars")]
    rows = df.select(*[F.col(f"`{c}`") for c in kept])
    carried = [c for c in kept if c != html]
    schema = rows.select(*[F.col(f"`{c}`") for c in carried]).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html, max_slice_bytes):
            found = [main_text(x) for x in texts_of(batch, html)]
            columns = [batch.column(c) for c in carried] + [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carried, "text", "n_chars"])

    return rows.mapInArrow(tidied(run), schema)
