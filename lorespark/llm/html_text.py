"""Main text of web pages by tree scoring.

A page becomes a tree (unclosed and stray tags are mended as browsers do for the common cases). Menus, page headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments are told by tag and role and take no part. A word of a class or id alone never decides, since wrappers carry such words too (a layout "has-sidebar", a post
"comments-open"): words that tell a state are no evidence, and a block that is suspect by another is junk only where what is left of the page, or of the suspect block around it, reads as text, or a better
suspect does. Some words name parts of articles as well (DOUBTFUL: a section "discussion", a paragraph "tags"), and some servers wrap a whole page in one form; such blocks, the former inside an
article only, are judged by what they hold. Every paragraph passes points, one plus one a comma
plus up to three for length, to its ancestors: all to the parent, half to the next, a third of the rest's share above, up to the LEVELS-th. A
container's points are discounted by its link density; the best one (of equal ones the first), its article where it stands in one, and the siblings that score near it or
read like paragraphs make the text. Blocks are joined in page order; nothing else is dropped or cut.

Parsing is linear in the page: open elements are found by tag in a table of their places on the stack, and what a failed search has shown to be missing is not searched again.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed tag and word lists. LEVELS is a parameter: how many ancestors a paragraph's points reach.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
JUNK_TAGS = frozenset("head nav footer aside button select input label fieldset dialog menu object embed applet canvas audio video map datalist".split()) | RAW
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist form".split())
JUNK_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login paywall sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs crumbs header masthead topbar footer bottombar comment comments commentlist disqus "
    "respond share sharing social recommended recommendations toolbar pagination pager skip skiplink tagcloud".split()
)
#: Suspects of reader comments, which read as text; words that make the rest of a class or id a state and no name; what the text beside suspects must hold to do without them (characters
#: outside links, marks of sentences, share of the largest suspect), and the share of that text with which a suspect is the text.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
STATE_WORDS = frozenset("no not has have with without open opened closed enabled disabled allowed free hoc layout layouts template theme support supports".split())
REST_CHARS, REST_MARKS, REST_SHARE, WHOLE_SHARE, LINE_CHARS = 60, 2, 0.15, 0.8, 25
#: Words that also name parts of articles, and what such a block must hold to stay: characters outside links, marks of sentences, and the largest share of links.
DOUBTFUL = frozenset("replies reply discussion related rail widget widgets tags".split())
DOUBT_CHARS, DOUBT_MARKS, DOUBT_LINKED = 80, 2, 0.25
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEEP_TAGS = frozenset("html body article main h1 h2 h3 h4 h5 h6 p".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
ENDS_P = BLOCK - frozenset("body html head caption td th tr tbody thead tfoot option optgroup legend".split())
BARRIER = frozenset("table td th caption button object html body".split())
TAG_POINTS = {"div": 5, "article": 8, "main": 8, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "address": -3, "th": -5}
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body figcaption".split())
LEVELS = 6

_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_MARK = re.compile(r"[.!?。！？]")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "up", "kids", "junk", "doubt", "chars", "linked", "commas", "own_chars", "own_commas", "score", "in_link")

    def __init__(self, tag: str, up: Node | None, junk: bool):
        self.tag, self.up, self.kids, self.junk, self.doubt = tag, up, [], junk, CLEAN
        self.chars = self.linked = self.commas = self.own_chars = self.own_commas = 0
        self.score, self.in_link = 0.0, tag == "a" or (up is not None and up.in_link)


#: What a tag's attributes say of it: nothing, that what it holds decides, that it is suspect, that it is suspect of reader comments, that it is junk.
CLEAN, DOUBT, SUSPECT, COMMENTS, JUNK = range(5)


def _judge(tag: str, attrs: str, inside_article: bool) -> int:
    if tag in JUNK_TAGS or (tag == "header" and not inside_article):
        return JUNK
    out = DOUBT if tag == "form" else CLEAN
    if tag in KEEP_TAGS and tag not in ("p", "article") or "=" not in attrs:
        return out
    for m in _ATTR.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.strip().lower() in JUNK_ROLES:
                return JUNK
            continue
        for name in value.split():
            words = {w.lower() for w in _WORDS.findall(name)}
            if words & STATE_WORDS:
                continue
            if words & COMMENT_WORDS and (not inside_article or words & JUNK_WORDS):
                out = max(out, COMMENTS)
            elif tag != "article" and (words & JUNK_WORDS or words & DOUBTFUL and not inside_article):
                out = max(out, SUSPECT)
            elif words & DOUBTFUL:
                out = max(out, DOUBT)
    return out


class _Finder:
    """``find`` of fixed strings at ascending places: the next hit is kept, and one that is missing is searched once."""

    def __init__(self, source: str):
        self.source, self.next, self.strict = source, {}, True

    def find(self, what: str, at: int) -> int:
        hit = self.next.get(what, 0)
        if hit < 0 or hit >= at:
            if what in self.next:
                return hit
        hit = self.next[what] = self.source.find(what, at)
        return hit

    def tag_end(self, at: int) -> int:
        """Where the tag whose name ends at ``at`` closes: its first ``>`` outside quotes, else the first one, else -1.

        A scan that runs off the page inside a quote has read it to its end: quotes are not trusted behind that.
        """
        if self.find(">", at) < 0:
            return -1
        pos = at
        while self.strict:
            m = _STOP.search(self.source, pos)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            close = self.source.find(m[0], m.end())
            if close < 0:
                break
            pos = close + 1
        self.strict = False
        return self.find(">", at)


def parse(source: str) -> list[Node]:
    """All nodes of the page in document order; the first is the root."""
    root = Node("#root", None, False)
    nodes, stack, low, n, at = [root], [root], None, len(source), 0
    places: dict[str, list[int]] = {}  # open elements of a tag, by their place on the stack
    barriers: list[int] = [0]
    finder, once = _Finder(source), set()

    def text(raw: str) -> None:
        if not stack[-1].junk:
            stack[-1].kids.append(html.unescape(raw) if "&" in raw else raw)

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    def close_to(place: int) -> None:
        while len(stack) > place:
            x = stack.pop()
            places[x.tag].pop()
            if x.tag in BARRIER:
                barriers.pop()

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            text(source[at:])
            break
        if lt > at:
            text(source[at:lt])
        if source.startswith("<!--", lt):
            end = finder.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), lt):
            end = finder.find(">", lt)
            if end >= 0:
                at = end + 1
                continue
        m = _NAME.match(source, lt + 1)
        gt = finder.tag_end(m.end()) if m else -1
        if gt < 0:
            text("<")
            at = lt + 1
            continue
        at, tag, attrs = gt + 1, m[0].lstrip("/").lower(), source[m.end() : gt]
        if m[0][0] == "/":
            place = last(tag)
            if place and (tag in BARRIER or tag == "table" or place > barriers[-1]):
                close_to(place)
            elif tag in ("p", "br"):
                stack[-1].kids.append(Node("br" if tag == "br" else "p", stack[-1], stack[-1].junk))
            continue
        if tag in ENDS_P and last("p") > barriers[-1]:
            close_to(last("p"))
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            while (place := max(map(last, ends))) > max(map(last, stop)):
                close_to(place)
        if tag in ("html", "body"):
            if tag in once:
                continue
            once.add(tag)
            if tag == "body" and stack[-1].tag == "head":
                close_to(len(stack) - 1)
        up = stack[-1]
        doubt = _judge(tag, attrs, last("article") > 0 or last("main") > 0)
        node = Node(tag, up, up.junk or doubt == JUNK)
        node.doubt = doubt
        up.kids.append(node)
        nodes.append(node)
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "math"):
            continue
        if tag in RAW:
            low = source.lower() if low is None else low
            if len(low) != n:  # lower-casing changed lengths: search without it
                end = re.compile(re.escape(f"</{tag}"), re.I).search(source, at)
                stop_at = end.start() if end else n
            else:
                stop_at = low.find(f"</{tag}", at)
                stop_at = n if stop_at < 0 else stop_at
            gt = finder.find(">", stop_at)
            at = n if gt < 0 else gt + 1
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in BARRIER:
            barriers.append(len(stack))
        stack.append(node)
    _settle(nodes)
    return nodes


class _Held:
    """What a block holds: characters, those in links, marks of sentences, whether an article or a main part of its own, or a headline."""

    __slots__ = ("size", "linked", "marks", "body", "title")

    def __init__(self):
        self.size = self.linked = self.marks = 0
        self.body = self.title = False

    def add(self, other: _Held) -> None:
        self.size, self.linked, self.marks = self.size + other.size, self.linked + other.linked, self.marks + other.marks
        self.body |= other.body
        self.title |= other.title

    @property
    def plain(self) -> int:
        return self.size - self.linked

    def reads(self) -> bool:
        return self.plain >= DOUBT_CHARS and self.marks >= DOUBT_MARKS and self.linked <= DOUBT_LINKED * self.size


def _suspects(nodes: list[Node], held: dict[int, _Held]) -> None:
    """Of the suspects in one block (the page, or a suspect that stays) those are junk beside which the block's other text reads as text or has a sentence or line in an article or main part, but for one that
    holds an article of its own or nearly all text; where no other text does, the largest stays, and what is at least half as large; comments only where no other suspect reads as text."""
    inside: dict[int, list[Node]] = {id(nodes[0]): []}
    around: dict[int, tuple[int, bool]] = {id(nodes[0]): (id(nodes[0]), False)}  # the block, and whether in an article there
    said: set[int] = set()  # blocks with a sentence in an article that is no suspect's
    for x in nodes[1:]:
        outer, body = around[id(x.up)]
        if x.doubt in (SUSPECT, COMMENTS) and not x.junk:
            inside[outer].append(x)
            inside[id(x)] = []
            outer, body = id(x), False
        body = (body or x.tag in ("article", "main")) and x.tag not in HEADINGS
        around[id(x)] = outer, body
        if body and not x.junk and any(isinstance(t, str) and (len(t.strip()) >= LINE_CHARS or _MARK.search(t)) for t in x.kids):
            said.add(outer)
    for block, found in inside.items():
        if not found:
            continue
        rest = held[block].plain - sum(held[id(x)].plain for x in found)
        marks = held[block].marks - sum(held[id(x)].marks for x in found)
        most = max(held[id(x)].plain for x in found)
        done = block in said or rest >= REST_CHARS and marks >= REST_MARKS and rest >= REST_SHARE * most
        named = [x for x in found if x.doubt == SUSPECT and held[id(x)].reads()]
        best = max((held[id(x)].plain for x in (named or found)), default=0)
        for x in found:
            h = held[id(x)]
            if x.doubt == SUSPECT and (h.body and h.plain >= DOUBT_CHARS or h.reads() and h.plain >= WHOLE_SHARE * held[block].plain):
                continue
            x.junk = done or not h.reads() or 2 * h.plain < best or x.doubt == COMMENTS and bool(named)


def _settle(nodes: list[Node]) -> None:
    """Suspects are held against the rest of the page; doubtful blocks stay if they read as text (a form also if it holds an article, a main part or half of the page). What is junk is so with all it holds."""
    if not any(x.doubt and not x.junk for x in nodes):
        return
    held = {id(x): _Held() for x in nodes}
    for x in reversed(nodes):
        if x.junk:
            continue
        h = held[id(x)]
        for t in x.kids:
            if isinstance(t, str):
                c = len(t.strip())
                h.size += c
                h.linked += c if x.in_link else 0
                h.marks += len(_MARK.findall(t))
        h.body |= x.tag in ("article", "main") and x.doubt < SUSPECT
        h.title |= x.tag == "h1"
        if x.up is not None:
            held[id(x.up)].add(h)
    for x in nodes:  # a heading's block inside an article
        if x.doubt == SUSPECT and held[id(x)].title and any(y.tag in ("article", "main") for y in _above(x)):
            x.doubt = CLEAN
    _suspects(nodes, held)
    whole = held[id(nodes[0])].size
    for x in nodes:
        if x.up is not None and x.up.junk:
            x.junk = True
        elif x.doubt == DOUBT and not x.junk:
            h = held[id(x)]
            x.junk = not h.body and 2 * h.size < whole if x.tag == "form" else not h.reads()


def _above(x: Node):
    while x.up is not None:
        x = x.up
        yield x


def _score(nodes: list[Node]) -> None:
    for x in nodes:
        if not x.junk:
            for k in x.kids:
                if isinstance(k, str):
                    size = len(k.strip())
                    x.chars += size
                    x.commas += k.count(",") + k.count("、") + k.count("，")
                    x.linked += size if x.in_link else 0
        x.own_chars, x.own_commas = x.chars, x.commas
    for x in reversed(nodes):  # inline children count as text of their block
        if x.chars and x.up is not None and not x.junk:
            x.up.chars += x.chars
            x.up.linked += x.linked
            x.up.commas += x.commas
            if x.tag not in BLOCK:
                x.up.own_chars += x.own_chars
                x.up.own_commas += x.own_commas
    for x in nodes:
        size = x.own_chars
        if not size or x.junk or x.tag not in PARAGRAPHS:
            continue
        points = (1 + x.own_commas + min(size / 100, 3)) * (1 if size >= 25 else 0.2) * (1 - (x.linked / x.chars if x.chars else 0))
        up = x if x.tag not in ("p", "li", "dd", "figcaption") else x.up
        level = 0
        while up is not None and level < LEVELS:
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.up, level + 1
    for x in nodes:
        if x.score:
            x.score = (x.score + TAG_POINTS.get(x.tag, 0)) * (1 - (x.linked / x.chars if x.chars else 0))


def _reads_well(x: Node) -> bool:
    density = x.linked / x.chars if x.chars else 1
    return x.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "figure") and (density < 0.25 if x.chars > 80 else x.linked == 0 and x.chars > 0)


def _blocks(top: list[Node]) -> list[str]:
    out, cur = [], []

    def flush() -> None:
        if cur:
            t = " ".join("".join(cur).split())
            cur.clear()
            if t:
                out.append(t)

    stack: list = list(reversed(top))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            cur.append(x)
        elif x is None:
            flush()
        elif x.junk:
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            cur.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(x.kids))
    flush()
    return out


def main_text(source: str | None) -> str:
    """The article's text; empty if the page is null, empty or has none."""
    if not source:
        return ""
    nodes = parse(source)
    _score(nodes)
    live = [x for x in nodes if not x.junk and x.score > 0 and x.tag not in ("#root", "html")]
    best = max(live, key=lambda x: x.score, default=None)
    if best is None:
        return " ".join(_blocks([nodes[0]]))
    up = best
    while up is not None:  # an article is one container, however many parts it has
        if up.tag in ("article", "main"):
            best = up
        up = up.up
    while best.up is not None and best.up.tag not in ("#root", "html", "body") and best.up.score >= 0.75 * best.score:
        best = best.up
    least = max(1.0, 0.2 * best.score)
    top = [best]
    if best.up is not None and best.tag != "body":
        top = [k for k in best.up.kids if not isinstance(k, str) and (k is best or not k.junk and (k.score >= least or _reads_well(k)))]
    return " ".join(t for k in top for t in _blocks([k]))


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``pages`` (html and any further columns) with html replaced by text and n_chars (code points).

    keep: the columns to carry (all but html, text and n_chars by default). Null and empty pages have empty text; pages of any length are read whole, in linear time; of
    equal containers the first is taken; repeated rows keep a row each; an empty table stays empty.
    """
    names = [c for c in (keep if keep is not None else pages.columns) if c not in ("html", "text", "n_chars")]
    schema = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in names) + "text string, n_chars bigint"

    def run(batches):
        for batch in batches:
            source = batch.column("__html")
            _, off = C.utf8(source)
            for i, j in C.slices(off, 4 << 20):
                text = [main_text(h) for h in source[i:j].to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[i:j] for c in names], pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*names, F.col("html").cast("string").alias("__html")).mapInArrow(run, schema)
