"""Main text of web pages by tree scoring (operator 3).

A page becomes a small tree of elements; text is gathered into blocks, each
with the element it stands in.  Parts that are never main text (scripts, forms,
navigation, adverts, comments, ... by element or by whole names in class, id and
role) are left out; a name that only contains such a word lowers its element's
points.  Where a part left out by its name holds most of the page's paragraph
points, it stays, unless it is of a kind that readers or advertisers write; where
nothing else is left, all parts left out by name are scored.  Every paragraph passes points for its length and commas to
its ancestors, full to the nearest, less to those above; a container's points
are discounted by its link density.  The best container is kept whole, with
those siblings that score well or hold real paragraphs; where it lies in an
``article`` or ``main`` element, that element is the container, and where
elements above hold like paragraphs of their own (text nested ever deeper), it
is widened to the highest of them.  The work is linear in the page, however
deep it nests.

Defined results: a null or empty page, or one without text, gives the empty
text; text of any length is kept whole; unclosed and wrongly nested markup is
read as browsers do in the usual cases (a block ends an open paragraph, an end
tag closes what is open inside it, a stray end tag is ignored).
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Chunks, rows_of

TAG = re.compile(r"""<(?:
    (?P<comment>!--) | (?P<other>[!?][^>]*+>) |
    (?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)> )""", re.X)
# one attribute: its name, and its value if it has one; findall goes on behind the value
ATTR = re.compile(r"""([^\s/>][^\s/>=]*+) (?:\s*+=\s*+ ("[^"]*+" | '[^']*+' | [^\s>]++))?""", re.X)

# Element names of the HTML standard, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg math xmp".split())
DROP = frozenset("nav footer aside form button select option label fieldset dialog menu object audio video canvas "
                 "head header map".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre "
                  "section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"html", "head", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "li", "dd", "dt"}
CLOSED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"},
             "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol table article section div body html blockquote main dl".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd div section article main body".split())
# words of class, id and role that name page furniture
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar masthead "
    "header footer sidebar aside complementary contentinfo widget widgets rail "
    "comment comments commentlist disqus respond reply replies discussion reviews "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "share sharing social related recommended recirculation outbrain taboola search".split())
# those that name a place on the page: main text may stand there
PLACES = frozenset("header footer masthead banner sidebar aside rail widget widgets toolbar modal overlay popup search "
                   "complementary contentinfo".split())
# those that an article element is left out for: single entries of a discussion
ENTRIES = frozenset("comment comments commentlist reply replies respond disqus".split())
# words that beside one of FURNITURE in a name say no more than where it stands
STRUCTURE = frozenset(
    "list lists box block slot slots container wrapper wrap holder section area bar button buttons btn link links item items "
    "posts left right top bottom site page global primary secondary inner outer unit units module panel icon icons group row "
    "zone region desktop mobile sticky fixed".split())
# last words that make a whole name furniture, as in post-comments or left-sidebar
SUFFIXES = frozenset(
    "comments commentlist replies respond related recommended newsletter breadcrumb breadcrumbs pagination navigation nav "
    "navbar menu sidebar footer ads advert advertisement share sharing widget widgets popup modal overlay consent".split())
# first words of names that tell of a state or a subject, as in has-comments or category-reviews
STATES = frozenset("has with without no not is hide show category tag cat term topic format status".split())
MAIN_NAMES = frozenset("content article main entry story post".split())
LOWERED = 0.7                                             # share of its points for an element with a furniture word in a name
NONE, LOWER, PLACE, OUT = range(4)                        # what the names of an element say
MIN_PARAGRAPH = 25
SIBLING_SHARE = 0.2                                       # of the best container's points, for what is kept beside it
GAP = 3                                                   # levels without text of their own inside a chain


class _Node:
    __slots__ = ("name", "parent", "drop", "named", "points", "own", "size", "links", "depth", "block", "kept")

    def __init__(self, name, parent, drop, named=NONE):
        self.name, self.parent, self.drop, self.named = name, parent, drop, named
        self.points, self.own, self.size, self.links, self.kept = 0.0, 0.0, 0, 0, False
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if parent is None or name in BLOCK else parent.block      # nearest that owns text


def _furniture(name: str, attrs: str, inside_main: bool) -> tuple[bool, int]:
    """(is an element furniture by its name or hidden, what its class, id and role say)."""
    if name in DROP and not (name == "header" and inside_main):
        return True, NONE
    if not attrs or name in ("html", "body", "main"):
        return False, NONE
    hidden, names = False, []
    seen = set()
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in seen:                                    # as in browsers, the first of a name counts
            continue
        seen.add(key)
        if key == "hidden" or key == "aria-hidden" and value == "true":
            hidden = True
        elif key == "style":
            hidden = hidden or "display:none" in value.replace(" ", "")
        elif key in ("class", "id", "role"):
            names += value.split()
    return hidden, _named(names, name == "article")


def _named(names: list[str], article: bool) -> int:
    """The most that one of an element's names says; main names beside it weaken a place."""
    found = max(map(_token, names), default=NONE)
    if found == PLACE and not MAIN_NAMES.isdisjoint(names):
        return LOWER
    if article and found >= PLACE and ENTRIES.isdisjoint(names):
        return LOWER
    return found


def _token(token: str) -> int:
    """What one whole name says."""
    parts = [x for x in re.split(r"[^a-z]+", token) if len(x) > 1]
    words = [x for x in parts if x in FURNITURE]
    if not words or parts[0] in STATES:
        return NONE
    if parts[-1] in SUFFIXES or all(x in FURNITURE or x in STRUCTURE for x in parts):
        return PLACE if PLACES.issuperset(words) else OUT
    return LOWER


def blocks_of(page: str, stays=frozenset()) -> tuple[list[tuple[str, _Node, int]], list[_Node], int]:
    """((text, element, characters inside links) of each block in page order, all elements,
    characters left out for the names of elements).

    ``stays``: numbers of elements that their names do not leave out; None for all.
    """
    root = _Node("#root", None, False)
    stack, nodes, blocks = [root], [root], []
    opened = Counter()                                    # names in the stack
    last_end = page.rfind(">")
    parts: list[str] = []
    link_parts: list[str] = []
    links = 0                                             # open <a> elements
    lost = 0

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                linked = len(" ".join("".join(link_parts).split())) if link_parts else 0
                blocks.append((text, stack[-1].block, min(linked, len(text))))
        parts.clear()
        link_parts.clear()

    def pop_to(i):
        nonlocal links
        gone = Counter(n.name for n in stack[i:])
        links -= gone["a"]
        opened.subtract(gone)
        del stack[i:]

    def close(names, scope):
        """Close the innermost open element of ``names`` that ``scope`` does not hide."""
        if not any(opened[name] for name in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                pop_to(i)
                return
            if stack[i].name in scope:
                return

    def add_text(text):
        nonlocal lost
        if stack[-1].drop or not text:
            lost += len(text) if stack[-1].drop == OUT else 0
            return
        if "&" in text:
            text = html.unescape(text)
        parts.append(text)
        if links:
            link_parts.append(text)

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0 or lt > last_end:                       # no tag ends from here on
            add_text(page[at:])
            break
        add_text(page[at:lt])
        m = TAG.match(page, lt)
        if not m:
            add_text("<")
            at = lt + 1
            continue
        at = m.end()
        if m["comment"]:
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            if page.startswith(("<!-->", "<!--->"), lt):
                at = page.index(">", lt) + 1
            continue
        if m["other"]:
            continue
        name = m["name"].lower()
        if m["close"]:
            if name in BLOCK:
                flush()
            if not opened[name]:
                if name in ("br", "p"):
                    parts.append(" ")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    pop_to(i)
                    break
                if name not in BLOCK and stack[i].name in BLOCK:
                    break                                  # an inline end tag does not close a block
            continue
        attrs = m["attrs"]
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            if not attrs.endswith("/") or name not in ("svg", "math"):
                at = end if stop is None else (page.find(">", stop.start()) + 1 or end)
            continue
        if name == "br" or name == "wbr":
            if name == "br":
                add_text(" ")
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P:
                close({"p"}, SCOPE - {"p"})
            if name in CLOSED_BY:
                close(CLOSED_BY[name], {"ul", "ol", "dl", "table"})
        if name in VOID:
            continue
        top = stack[-1]
        inside = name == "header" and opened["article"] + opened["main"] > 0
        drop, named = _furniture(name, attrs, inside)
        out = named >= PLACE and stays is not None and len(nodes) not in stays
        # 1: left out with certainty, OUT: by names, which a later look may overrule
        node = _Node(name, top, 1 if drop or top.drop == 1 else OUT if out else top.drop, named)
        nodes.append(node)
        stack.append(node)
        opened[name] += 1
        links += name == "a"
    flush()
    return blocks, nodes, lost


def _points(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3)


def _paragraph(owner: _Node, text: str) -> bool:
    return owner.name in PARAGRAPHS and len(text) >= MIN_PARAGRAPH


def _kept_parts(page: str) -> tuple[list[tuple[str, _Node, int]], list[_Node]]:
    """Blocks and elements of a page without its furniture, as far as that leaves the main text."""
    blocks, nodes, lost = blocks_of(page)
    if 2 * lost <= sum(len(text) for text, _, _ in blocks):
        return blocks, nodes
    every, all_nodes, _ = blocks_of(page, None)
    if not blocks:
        return every, all_nodes
    total, inside = 0.0, {}
    for text, owner, linked in every:
        if _paragraph(owner, text):
            points = _points(text) * (1 - linked / len(text))
            total += points
            inside[id(owner)] = inside.get(id(owner), 0.0) + points
    for node in reversed(all_nodes[1:]):                   # children stand behind their parents
        if id(node) in inside:
            inside[id(node.parent)] = inside.get(id(node.parent), 0.0) + inside[id(node)]
    stays = frozenset(i for i, n in enumerate(all_nodes) if n.named == PLACE and 2 * inside.get(id(n), 0.0) > total)
    return blocks_of(page, stays)[:2] if stays else (blocks, nodes)


def _score(blocks, nodes) -> None:
    """Sizes, link sizes, own points (of paragraphs directly inside) and points of all elements."""
    for text, owner, linked in blocks:
        owner.size += len(text)
        owner.links += linked
        if _paragraph(owner, text):
            points = _points(text)
            node, share = owner if owner.name in ("div", "section", "article", "main", "body") else owner.parent, 1.0
            if node:
                node.own += points
            while node and share > 0.1:
                node.points += points * share
                node, share = node.parent, share / 2
    for node in reversed(nodes[1:]):                       # children stand behind their parents
        node.parent.size += node.size
        node.parent.links += node.links
    for node in nodes:
        weight = (1 - node.links / node.size if node.size else 0) * (LOWERED if node.named else 1)
        node.points *= weight
        node.own *= weight


def _widened(best: _Node) -> _Node:
    """The highest element above that holds paragraphs of its own like those of ``best``.

    Text that nests ever deeper, some on each level, belongs together; so levels
    are climbed while, within ``GAP`` of them, own points reach a fifth of
    those of ``best``.
    """
    found, node, gap = best, best.parent, 0
    while node and gap < GAP:
        if node.own >= SIBLING_SHARE * best.points:
            found, gap = node, -1
        node, gap = node.parent, gap + 1
    return found


def main_text(page: str | None) -> str:
    """Main text of a page: blocks in page order, joined by one line break."""
    if not page:
        return ""
    blocks, nodes = _kept_parts(page)
    if not blocks:
        return ""
    _score(blocks, nodes)
    best = max(nodes, key=lambda n: (n.points, n.depth))
    if best.points <= 0:                                   # no real paragraph: the largest article or main, else all
        named = [n for n in nodes if n.name in ("article", "main") and n.size]
        best = max(named, key=lambda n: n.size) if named else nodes[0]
    node = best
    while node and node.name not in ("article", "main"):
        node = node.parent
    if node:
        kept = {id(node)}
        best = node
    else:
        need = max(3.0, SIBLING_SHARE * best.points)
        best = _widened(best) if best.points > 0 else best
        kept = {id(best)}
        for n in nodes:
            if n.parent is best.parent and n is not best and n.size:
                density = n.links / n.size
                if n.points >= need or (n.name in ("p", "h1", "h2", "h3", "pre", "blockquote", "ul", "ol", "table")
                                        and density < 0.25):
                    kept.add(id(n))
        if best.parent is not None and len(kept) > 1:      # loose text between kept siblings belongs to them
            kept.add(id(best.parent)) if best.parent.name == "#root" else None
    for n in nodes:                                        # parents stand before their children
        n.kept = id(n) in kept or (n.parent is not None and n.parent.kept)
    return "\n".join(text for text, owner, _ in blocks if owner.kept)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` + text, n_chars (code points) for every whole page; one pass, no shuffle."""
    from pyspark.sql.pandas.types import to_arrow_type
    src = pages.select(*keep, html_col)
    fields = [src.schema[k] for k in keep]
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
                       + [("text", pa.string()), ("n_chars", pa.int64())])
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["text string", "n_chars bigint"])

    def run(batches):
        out = Chunks(schema)
        for batch in batches:
            for *kept, page in rows_of(batch, *keep, html_col):
                text = main_text(page)
                yield from out.add((*kept, text, len(text)), 64 + 2 * len(text))
        yield from out.rest()

    return src.mapInArrow(run, ddl)
