"""Main text of web pages by tree scoring.

A page is read into a light tree. Blocks of text pass points for their length and commas to their ancestors, halved at
every step; a container's points are discounted by its link density. The best container and those of its siblings that
are like it are kept, without the boilerplate elements inside them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, small_batches

# Fixed values of HTML: elements by their kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe noembed noframes xmp".split())
RCDATA = set("title textarea".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
DROPPED = set("head nav footer aside script style noscript template iframe title textarea select option button input dialog menu object embed svg canvas audio video map search datalist noembed noframes xmp".split())
#: ARIA roles of what is no main text.
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar menuitem navigation search searchbox status tablist toolbar tooltip".split())
CONTROLS = set("input select textarea button".split())
CONTAINERS = set("article main section div td body blockquote center".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
LISTS, DENSE = set("ul ol dl".split()), set("ul ol dl div table section".split())
TABLED = set("table tbody thead tfoot tr td th caption li dt dd".split())
#: What a start tag closes if it is open in the same container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("ul ol dl table tr article section div main body td th blockquote aside nav".split())
#: Words of class and id names that mark boilerplate if the whole name is of such words and of those that names have besides,
BOILERPLATE = set("ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs topbar masthead footer sidebar sidebars widget widgets recommended recommendations sharing toolbar pagination pager comment comments commentlist disqus reply replies respond notice notices disclaimer".split())
BESIDES = set("privacy reader readers user users email mail main primary secondary first last mobile desktop fixed sticky floating inline slot unit placeholder space holder panel column group item items content body title label heading meta author avatar name date count thread children child view open close toggle wp js mod module component blog web app google dfp header head row grid".split())
#: those that do with fewer words besides,
LOOSE = set("header foot side rail aside related more share reactions tags tag skip legal social alert copyright".split())
FILLER = set("box boxes list lists link links bar block wrap wrapper container button buttons icon icons section area inner outer site page top bottom left right global read posts post articles stories form text".split())
#: and those that do in any name outside of an article.
STRONG = set("advertisement advertising breadcrumb breadcrumbs consent cookie cookies disqus gdpr masthead navbar newsletter pagination popup sidebar sidebars topbar".split())
#: Elements that are boilerplate unless they hold an article or most of the page; a fieldset only if it has controls.
USUALLY = {"header", "form", "fieldset"}
#: How sure an element's class, id or kind is of boilerplate.
NONE, HINT, STRONG_HINT, NAMED = range(4)

#: What may end a tag, and the name of one. One attribute: its name, and its value if it has one.
STOP = re.compile(r"[>\"']")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s\"'>/=]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?|\"[^\"]*\"|'[^']*'")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "parts", "drop", "named", "chars", "links", "score")

    def __init__(self, tag: str, parent: Node | None, drop: bool, named: int = NONE):
        self.tag, self.parent, self.drop, self.named = tag, parent, drop, named  # named: how sure class, id, role or kind are
        self.parts: list = []  # texts and nodes in page order
        self.chars = self.links = self.score = 0.0


def marks(value: str) -> int:
    """How sure the names of a class or id are of boilerplate."""
    sure = NONE
    for name in value.split():
        words = [w.lower() for w in WORD.findall(name)]
        bad = not BOILERPLATE.isdisjoint(words)
        if bad and all(w in BOILERPLATE or w in LOOSE or w in FILLER or w in BESIDES or len(w) == 1 for w in words):
            return NAMED
        if not LOOSE.isdisjoint(words) and all(w in LOOSE or w in FILLER for w in words):
            return NAMED
        sure = max(sure, (STRONG_HINT if not STRONG.isdisjoint(words) else HINT) if bad else NONE)
    return sure


def boilerplate(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether an element is boilerplate by its tag or being hidden, and how sure its kind, role, class or id are of it."""
    if tag in DROPPED:
        return True, NONE
    named, seen = NAMED if tag in USUALLY else NONE, set()
    if not attrs.strip():
        return False, named
    whole = tag in ("body", "html", "article", "main")
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if not name or name in seen:  # the first of a name counts
            continue
        seen.add(name)
        low = value.strip().lower()
        if name == "hidden" or (name == "style" and "display:none" in "".join(low.split())):
            return True, NONE
        if (name == "aria-hidden" and low == "true") or (name == "role" and not ROLES.isdisjoint(low.split()[:1]) and not whole):
            named = NAMED
        elif name in ("class", "id") and not whole:
            named = max(named, marks(value))
    return False, named


def tokens(page: str) -> Iterator[tuple[str, bool, str, int]]:
    """What a page has one after another: ("", False, text, end), and tags as (name, closing, attributes, end); comments are
    left out, and so is a tag that the page ends in. One pass: a quote or bracket that nothing closes is looked for once.
    A caller may send the place from which to go on."""
    at, n = 0, len(page)
    last = {c: page.rfind(c) for c in ">\"'"}
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            yield "", False, page[at:begin], begin
        at = begin
        if at >= n:
            return
        after = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        closing = after == "/"
        name = NAME.match(page, at + 1 + closing)
        if name is None and after not in ("!", "?", "/"):
            yield "", False, "<", at + 1
            at += 1
            continue
        if at > last[">"]:
            return
        here = name.end() if name else at + 1
        stop = here
        while True:
            m = STOP.search(page, stop)
            if m is None:
                return
            stop = m.end()
            if m[0] == ">":
                break
            if name is not None and not closing and stop <= last[m[0]]:
                stop = page.find(m[0], stop) + 1
        at = stop
        if name is not None:
            found = yield name[0].lower(), closing, page[here : stop - 1], stop
            if found is not None:
                at = found
                yield "", False, "", at


class Open:
    """The open elements: a stack, and what is open of each name since the last block (inline) and within the last scope."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.blocks: Counter = Counter()
        self.inline: list[Counter] = [Counter()]
        self.scoped: list[tuple[Node, Counter]] = [(root, Counter())]

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        if node.tag in BLOCK:
            self.blocks[node.tag] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][node.tag] += 1
        if node.tag in SCOPE:
            self.scoped.append((node, Counter()))
        else:
            self.scoped[-1][1][node.tag] += 1

    def pop(self) -> Node:
        node = self.nodes.pop()
        if node.tag in SCOPE:
            self.scoped.pop()
        else:
            self.scoped[-1][1][node.tag] -= 1
        if node.tag in BLOCK:
            self.blocks[node.tag] -= 1
            self.inline.pop()
        else:
            self.inline[-1][node.tag] -= 1
        return node

    def close(self, name: str) -> None:
        """An end tag: closes up to the last open element of its name; an inline one does not cross a block."""
        if (self.blocks if name in BLOCK else self.inline[-1])[name] > 0:
            while self.pop().tag != name:
                pass

    def ends(self, names: set[str]) -> None:
        """Closes what a start tag ends: up to the last open element of these names within the scope, and more that follow."""
        top, within = self.scoped[-1]
        if any(within[x] > 0 for x in names):
            while self.pop().tag not in names:
                pass
        elif top.tag in names:
            while self.nodes[-1] is not top:
                self.pop()
        while self.nodes[-1].tag in names and len(self.nodes) > 1:
            self.pop()


def tree(page: str) -> Node:
    """The page's elements and texts, with the usual repairs of unclosed elements, in time linear in its length."""
    root = Node("html", None, False)
    now = Open(root)
    walk = tokens(page)
    for name, closing, body, end in walk:
        here = now.nodes[-1]
        if not name:
            if body:
                here.parts.append(body)
            continue
        if closing:
            if name == "br":
                here.parts.append(" ")
            now.close(name)
            continue
        if name == "br":
            here.parts.append("\x00br")
            continue
        if name in VOID:
            if name in ("hr", "input"):
                here.parts.append(Node(name, here, name == "input"))
            continue
        if name in ("html", "body"):
            if name == "body":
                while len(now.nodes) > 1:
                    now.pop()
                root.parts.append(new := Node("body", root, False))
                now.push(new)
            continue
        if name in BLOCK:
            now.ends({"p"})
        if name in CLOSES:
            now.ends(CLOSES[name])
        here = now.nodes[-1]
        new = Node(name, here, *boilerplate(name, body))
        here.parts.append(new)
        if name in RAW or name in RCDATA:
            done = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, end)
            stop = page.find(">", done.end()) if done else -1
            walk.send(stop + 1 if stop >= 0 else len(page))
        elif not body.endswith("/") or name in BLOCK:
            now.push(new)
    return root


def drop_named(root: Node) -> bool:
    """Drops elements that a class, an id, a role or their kind marks, unless they hold an article or main (those within an
    article, as comments are, don't count), or more than half of the page's unlinked text. A name that only hints at
    boilerplate drops what is mostly links, but no part of a table and no list within an article. The header of an article
    or main stays if it has a heading, without what is mostly links in it. Whether any was dropped."""
    stack: list[tuple[Node, bool, bool, bool]] = [(root, False, False, False)]
    plain: dict[Node, int] = {}
    all_: dict[Node, int] = {}
    titled: set[Node] = set()
    holds: set[Node] = set()
    controls: set[Node] = set()
    marked: list[tuple[Node, bool]] = []
    while stack:
        here, in_link, inner, seen = stack.pop()
        if here.drop:
            continue
        if not seen:
            in_link = in_link or here.tag == "a"
            stack.append((here, in_link, inner, True))
            stack.extend((x, in_link, inner or here.tag in ("article", "main"), False) for x in here.parts if not isinstance(x, str))
            continue
        size = every = 0
        for x in here.parts:
            if isinstance(x, str):
                every += len(x.strip())
                size += 0 if in_link else len(x.strip())
                continue
            if x.tag in CONTROLS or x in controls:
                controls.add(here)
            if not x.drop:
                size, every = size + plain[x], every + all_[x]
                if not inner and (x in holds or x.tag in ("article", "main")):
                    holds.add(here)
                if x in titled or x.tag in HEADINGS:
                    titled.add(here)
        plain[here], all_[here] = size, every
        if here.tag == "header" and inner and here in titled:
            for x in here.parts:
                if not isinstance(x, str) and not x.drop and x not in titled and x.tag not in HEADINGS and 2 * plain[x] <= all_[x]:
                    x.drop = True
        elif here.named and (here.tag != "fieldset" or here in controls):
            marked.append((here, inner))
    found = False
    for x, inner in marked:
        if x in holds or 2 * plain[x] > plain[root]:
            continue
        linked = x.tag not in TABLED and 2 * plain[x] < all_[x] and not (inner and x.tag in LISTS)
        if x.named == NAMED or (x.named == STRONG_HINT and not inner) or linked:
            x.drop = found = True
    return found


def weigh(node: Node, linked: bool, found: list[Node]) -> None:
    """Characters and linked characters of every node, points of every container; without recursion."""
    stack: list[tuple[Node, bool, bool]] = [(node, linked, False)]
    while stack:
        here, in_link, seen = stack.pop()
        if here.drop:
            continue
        if not seen:
            in_link = in_link or here.tag == "a"
            stack.append((here, in_link, True))
            stack.extend((x, in_link, False) for x in here.parts if not isinstance(x, str))
            continue
        commas = 0
        for x in here.parts:
            if isinstance(x, str):
                if size := len(x.strip()):
                    here.chars += size
                    here.links += size * in_link
                    commas += x.count(",")
            elif not x.drop:
                here.chars += x.chars
                here.links += x.links
        if here.tag in ("p", "pre", "li", "dd", "td", "blockquote", "div", "section", "article", "main") or here.tag in HEADINGS:
            own = sum(len(x.strip()) if isinstance(x, str) else x.chars * (x.tag not in BLOCK) for x in here.parts)
            if own:
                points, up, share = 1 + commas + min(own / 100, 3), (here if here.tag in CONTAINERS else here.parent), 1.0
                while up is not None and share > 0.1:
                    up.score += points * share
                    up, share = up.parent, share / 2
        if here.tag in CONTAINERS or here.tag == "html":
            found.append(here)


def density(node: Node) -> float:
    return node.links / node.chars if node.chars else 0.0


BONUS = {"article": 25.0, "main": 15.0, "section": 2.0, "div": 2.0, "body": 0.0, "html": -5.0}


def best(root: Node) -> list[Node]:
    """The best container and the siblings to keep, in page order."""
    found: list[Node] = []
    weigh(root, False, found)
    rated = [((x.score + BONUS.get(x.tag, 0.0)) * (1 - density(x)), -i, x) for i, x in enumerate(found) if x.chars]
    if not rated:
        return []
    top, _, node = max(rated, key=lambda r: r[:2])
    up = node
    while up is not None:  # an article holds its parts together
        if up.tag in ("article", "main"):
            node = up
            break
        up = up.parent
    if node.parent is None or node.tag in ("body", "article", "main") and not any(not isinstance(x, str) and x is not node and x.tag == "article" for x in node.parent.parts):
        return [node]
    keep = []
    for x in node.parent.parts:
        if isinstance(x, str) or x.drop or not x.chars:
            continue
        like = x.tag in CONTAINERS and x.tag == node.tag and (x.score + BONUS.get(x.tag, 0.0)) * (1 - density(x)) >= max(4.0, 0.2 * top)
        if x is node or like or (x.tag == "p" and density(x) < 0.25) or (x.tag in HEADINGS and density(x) < 0.25):
            keep.append(x)
    return keep


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the nodes' blocks in page order: references decoded, white space made one space, empty ones left out.
    Lists, tables and sections that are mostly links are menus where they stand before or after all else of a container
    that is no article; after a heading at the end, and between other text, they are text."""
    out: list[tuple[str, bool, bool]] = []  # text, mostly links, heading
    line: list[str] = []

    def flush(dense: bool, heading: bool) -> None:
        if line:
            if text := " ".join(html.unescape("".join(line)).split()):
                out.append((text, dense, heading))
            line.clear()

    for top in nodes:
        up = top
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        stack: list = [(top, False, False)]
        while stack:
            x, closing, dense = stack.pop()
            if closing:
                flush(dense, x.tag in HEADINGS)
            elif isinstance(x, str):
                line.append(" " if x == "\x00br" else x)
            elif not x.drop:
                inside = dense or (up is None and x is not top and x.tag in DENSE and density(x) > 0.6)
                if x.tag in BLOCK:
                    flush(dense, False)
                    stack.append((x, True, inside))
                stack.extend((y, False, inside) for y in reversed(x.parts))
        flush(False, False)
    begin, end = 0, len(out)
    while begin < end and out[begin][1]:
        begin += 1
    last = end
    while last > begin and out[last - 1][1]:
        last -= 1
    if last > begin and not out[last - 1][2]:
        end = last
    return [text for text, _, _ in out[begin:end]]


def main_text(page: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not page:
        return ""
    page = page.replace("\x00", "�")
    if "<" not in page:
        return " ".join(html.unescape(page).split())
    root = tree(page)
    dropped = drop_named(root)
    text = "\n".join(blocks(best(root)))
    return text if text or not dropped else "\n".join(blocks(best(tree(page))))  # again without the rules of class and id


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Key, url, text and n_chars (code points of text) of each row's whole page.

    Null and empty pages have an empty text; null or repeated keys stay, a row each; an empty table gives no rows; a page
    without markup is one block; other columns are not read. Nothing is cut, however long. br is white space.
    """
    small_batches(pages.sparkSession)
    fields = pages.select(key, url).schema
    kinds = f"key {fields[0].dataType.simpleString()}, url {fields[1].dataType.simpleString()}"

    def run(batches):
        for whole in batches:
            for batch in by_bytes(whole, "page", 1 << 22):
                text = pa.array([main_text(x) for x in batch.column("page").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), text], ["key", "url", "text"])

    out = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).cast("string").alias("page")).mapInArrow(run, f"{kinds}, text string")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
