"""Main text of web pages by inferred wrappers (operator 5).

A page is a stream of tokens: tags that open and close blocks, and text. For
every host a wrapper is inferred, a union-free regular expression over such
streams: streams of one host are aligned one after another, and a mismatch
makes a token or group optional, a repetition makes it a repeated group, and
texts that differ make a text slot. Each part of the wrapper counts the different
pages it was met on (equal streams are one page), its text, the part of that in links, and whether the text was
the same on every page.

The wrapper then tells which parts are the article. Parts marked as such are
it, the widest ones, all of them; on hosts without marks it is what varies from page to
page: parts that are fixed on all pages (the template) or mostly links go, and
from the top down, as long as one box holds most of the text slots, boxes beside it that
hold neither a heading nor much text go too. Within a marked article, boxes that are fixed
go. Menus, headers, footers, sidebars, notices, adverts, forms and comments
are told by their tags and roles; names in class and id are a prior only: a box
is not left out for its name if it holds the marked article or nearly all text, nor
is a paragraph, heading or item whose text varies. Every page is
read along its host's wrapper; a page that has no such part, or that is left
without text where no part is marked, is its own wrapper.

Alignment is bounded: where a block has more than WIDE parts, names that were met on
few pages are generalised to their tag and the listed words, and neighbours
of one kind fold into a repeated group, so that a wrapper does not grow with the pages.

Streams are aligned within each batch first, so that a host reaches the next
step as one wrapper a batch, however many pages it has. Pages then meet their
wrapper once a host, or once a stretch of a large host, as the first row of a sorted run.
Null or empty html gives an empty text; pages
without a host share one wrapper. Broken markup is read as far as it goes:
missing end tags close with their parents, and a tag that never ends is text.
Repeated rows are pages of their own; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nutrilake.session import materialize

#: Tags by kind (fixed values).
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "xmp", "noembed", "noframes")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
FLOW = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "thead", "tbody",
        "tfoot", "tr", "td", "th", "caption", "figure", "figcaption", "address", "details", "summary", "center")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Tags that hold a piece of text; the other blocks are boxes.
PIECES = (*HEADINGS, "p", "li", "dt", "dd", "blockquote", "pre", "td", "th", "caption", "figcaption", "summary", "address")
BOXES = ("html", "head", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "fieldset", "menu",
         "dialog", "hgroup", "select", "button", "object", "video", "audio", "canvas", "map", "label", "legend", "option", "search")
OUTSIDE = ("head", "nav", "footer", "aside", "form", "fieldset", "menu", "dialog", "select", "button", "object", "video", "audio", "canvas",
           "label", "legend", "option", "search", "header")
ROLES_OUTSIDE = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar", "hidden")
#: Words in class or id that often name what is not the article, and what is: a prior, not a verdict.
NAMES_OUTSIDE = ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "ad",
                 "ads", "adv", "advert", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie",
                 "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login",
                 "search", "share", "sharing", "social", "related", "recommended", "comment", "comments", "reply", "replies", "respond",
                 "disqus", "widget", "pagination", "pager", "toolbar", "hidden", "copyright", "legal")
NAMES_INSIDE = ("article", "main", "content", "post", "entry", "story", "body", "text")
#: Deeper blocks are read as text of the block they are in, unless they are the article or outside it.
DEEPEST = 64

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<=\s)(hidden)(?=[\s/>])""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[\t-\r ]+")


class Page(NamedTuple):
    """Blocks of a page as nodes (parent, key) in order, and its texts as (node, text, characters in links)."""

    nodes: list[tuple[int, str]]
    texts: list[tuple[int, str, int]]


def key_of(tag: str, attributes: str) -> str:
    """A block's name in wrappers: its tag and, if it has them, role (``hidden`` if it is not shown) and words of class and id without digits; headings without any are ``h``, other text blocks ``p``."""
    plain = "h" if tag in HEADINGS else "p" if tag in FLOW else tag
    if "=" not in attributes and "hidden" not in attributes:
        return plain
    role, names, unseen = "", [], False
    for name, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role":
            role = value.lower()
        elif name in ("class", "id"):
            names += [w.lower() for w in _WORD.findall(value)]
        elif tag not in ("html", "body") and (hidden or (name == "aria-hidden" and value.lower() == "true")
                                              or (name == "style" and "display:none" in value.replace(" ", "").lower())):
            unseen = True
    role = "hidden" if unseen else role
    return plain if not role and not names else f"{tag}|{role}|{' '.join(sorted(set(names)))}"


def parse(html: str) -> Page:
    nodes: list[tuple[int, str]] = [(-1, "page")]
    texts: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int]] = [("", 0)]  # (tag, node)
    piece: list[str] = []
    linked = in_link = 0
    deep: dict[int, int] = {}  # marks of the nodes below DEEPEST, 3 for outside

    def close_text() -> None:
        nonlocal linked
        if piece:
            text = _SPACE.sub(" ", entities.unescape("".join(piece))).strip(" ")
            if text:
                texts.append((stack[-1][1], text, min(linked, len(text))))
            piece.clear()
        linked = 0

    at = 0
    while True:
        m = _TAG.search(html, at)
        run = html[at: m.start() if m else len(html)]
        if run:
            piece.append(run)
            linked += len(run) * (in_link > 0)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        closing, tag = m[1] == "/", m[2].lower()
        if tag in RAW:
            if not closing and not m[3].endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
        elif tag == "a":
            in_link = max(0, in_link + (-1 if closing else 1))
        elif tag in ("br", "hr"):
            close_text()
        elif tag in FLOW or tag in BOXES:
            close_text()
            if closing:
                if any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
                    in_link = 0
            else:
                if stack[-1][0] == "p" or (tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == tag):
                    stack.pop()
                if len(stack) <= DEEPEST:
                    nodes.append((stack[-1][1], key_of(tag, m[3])))
                    stack.append((tag, len(nodes) - 1))
                elif (mark := 3 if outside(key := key_of(tag, m[3])) or named_outside(key) else inside(key)) > deep.get(stack[-1][1], 0):
                    # A mark within a stronger or equal one changes nothing, so that depth stays bounded.
                    nodes.append((stack[-1][1], key))
                    stack.append((tag, len(nodes) - 1))
                    deep[len(nodes) - 1] = mark
                else:
                    stack.append((tag, stack[-1][1]))
    close_text()
    # Boxes without a name are told apart by what stands in them.
    parts: dict[int, set[str]] = {}
    for parent, key in nodes[1:]:
        parts.setdefault(parent, set()).add(key.partition("|")[0])
    nodes = [(p, f"{key}>{','.join(sorted(parts[i]))}" if key in ("div", "section") and i in parts else key) for i, (p, key) in enumerate(nodes)]
    return Page(nodes, texts)


# A wrapper is [key, quantifier, pages, characters, characters in links, text hash or null, parts]; quantifiers: "", "?", "+", "*".
# Pages are the smallest hashes of up to MANY_PAGES different streams, so that copies of a page count once wherever they meet.
KEY, MANY, PAGES, CHARS, LINKED, SAME, PARTS = range(7)
#: Different pages from which on a text that is the same on all belongs to the template; with fewer, nothing is fixed.
MANY_PAGES = 3
#: Parts of a block from which on rare names are generalised.
WIDE = 48


def wrapper_of(page: Page) -> list:
    """A page as the wrapper of itself: repeated neighbours are folded into repeated groups."""
    stream = zlib.crc32(repr(page).encode("utf-8", "surrogatepass"))
    own = [[key, "", [stream], 0, 0, "", []] for _, key in page.nodes]
    for node, text, linked in page.texts:
        w = own[node]
        w[CHARS] += len(text)
        w[LINKED] += linked
        w[SAME] = f"{zlib.crc32(text.encode(), int(w[SAME] or '0', 16)):x}"
    for i in range(len(own) - 1, 0, -1):  # parts come after their blocks
        own[i][PARTS] = narrowed(folded(own[i][PARTS][::-1]))
        own[page.nodes[i][0]][PARTS].append(own[i])
    own[0][PARTS] = narrowed(folded(own[0][PARTS][::-1]))
    return own[0]


def either(a: str, b: str) -> str:
    """The quantifier that allows what both allow."""
    least, most = a in ("?", "*") or b in ("?", "*"), a in ("+", "*") or b in ("+", "*")
    return {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}[least, most]


def folded(parts: list[list]) -> list[list]:
    """Repetitions of one to four neighbouring parts as one repeated group each."""
    for size in range(1, 5):
        out: list[list] = []
        for part in parts:
            out.append(part)
            if len(out) >= 2 * size and all(x[KEY] == y[KEY] for x, y in zip(out[-size:], out[-2 * size: -size])):
                again = out[-size:]
                del out[-size:]
                for k in range(size):
                    out[-size + k] = joined(out[-size + k], again[k], one_page=True)
                    out[-size + k][MANY] = either(out[-size + k][MANY], "+")
        parts = out
    return parts


def joined(a: list, b: list, one_page: bool = False) -> list:
    """One wrapper for what two describe; ``one_page``: both stand on the same page."""
    pages = a[PAGES] if one_page or a[PAGES] == b[PAGES] else sorted({*a[PAGES], *b[PAGES]})[:MANY_PAGES]
    return [a[KEY], either(a[MANY], b[MANY]), pages, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED],
            a[SAME] if a[SAME] == b[SAME] and not one_page else None if a[SAME] != b[SAME] else a[SAME], aligned(a[PARTS], b[PARTS], one_page)]


@lru_cache(maxsize=1 << 16)
def general(key: str) -> str:
    """The key without the names that are in no list."""
    tag, _, rest = key.partition("|")
    role, _, names = rest.partition("|")
    return "|".join([tag.partition(">")[0], role, " ".join([*(w for w in names.split() if w in NAMES_INSIDE or w in NAMES_OUTSIDE), "*"])])


def narrowed(parts: list[list]) -> list[list]:
    """At most about WIDE parts: the keys met on one page only are generalised, then those on few pages, then all."""
    for pages in (1, MANY_PAGES - 1, MANY_PAGES):
        if len(parts) <= WIDE:
            break
        parts = folded([[general(p[KEY]), *p[MANY:]] if len(p[PAGES]) <= pages else p for p in parts])
    return parts


def known_keys(parts: list[list], others: list[list]) -> list[list]:
    """``parts`` with keys as general as ``others`` has them."""
    keys = {p[KEY] for p in others}
    if not any(k.endswith("*") for k in keys):
        return parts
    return folded([p if p[KEY] in keys or general(p[KEY]) not in keys else [general(p[KEY]), *p[MANY:]] for p in parts])


def aligned(a: list[list], b: list[list], one_page: bool) -> list[list]:
    """Two streams of parts as one: equal keys are joined in order (as many as possible), the others become optional."""
    if [x[KEY] for x in a] == [x[KEY] for x in b]:
        return [joined(x, y, one_page) for x, y in zip(a, b)]
    a, b = known_keys(a, b), known_keys(b, a)
    lo = next((i for i, (x, y) in enumerate(zip(a, b)) if x[KEY] != y[KEY]), min(len(a), len(b)))
    hi = next((i for i, (x, y) in enumerate(zip(a[lo:][::-1], b[lo:][::-1])) if x[KEY] != y[KEY]), min(len(a), len(b)) - lo)
    n, m = len(a) - hi, len(b) - hi
    # Both sides are narrow (``narrowed``), so that the table is small.
    best = [[0] * (m - lo + 1) for _ in range(n - lo + 1)]
    for i in range(n - 1, lo - 1, -1):
        for j in range(m - 1, lo - 1, -1):
            best[i - lo][j - lo] = best[i - lo + 1][j - lo + 1] + 1 if a[i][KEY] == b[j][KEY] else max(best[i - lo + 1][j - lo], best[i - lo][j - lo + 1])
    out, i, j = [joined(x, y, one_page) for x, y in zip(a[:lo], b[:lo])], lo, lo

    def optional(part: list) -> list:
        return [part[KEY], either(part[MANY], "?"), *part[PAGES:]]

    while i < n or j < m:
        if i < n and j < m and a[i][KEY] == b[j][KEY]:
            out.append(joined(a[i], b[j], one_page))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i - lo + 1][j - lo] >= best[i - lo][j - lo + 1]):
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return narrowed(folded(out + [joined(x, y, one_page) for x, y in zip(a[n:], b[m:])]))


@lru_cache(maxsize=1 << 16)
def outside(key: str) -> bool:
    """Does the tag or role say that this is not the article?"""
    tag, _, rest = key.partition("|")
    return tag.partition(">")[0] in OUTSIDE or rest.partition("|")[0] in ROLES_OUTSIDE


@lru_cache(maxsize=1 << 16)
def named_outside(key: str) -> bool:
    """Do the names sound as if this were not the article? An article's own names may be of both kinds."""
    tag, _, rest = key.partition("|")
    words = rest.partition("|")[2].split()
    return tag not in ("html", "body") and any(w in NAMES_OUTSIDE for w in words) and not (inside(key) == 2 and any(w in NAMES_INSIDE for w in words))


@lru_cache(maxsize=1 << 16)
def inside(key: str) -> int:
    """2 if the key marks an article, 1 if its name sounds like one."""
    tag, _, rest = key.partition("|")
    role, _, names = rest.partition("|")
    return 2 if tag in ("article", "main") or role in ("main", "article") else int(tag not in ("p", "html", "body") and any(w in NAMES_INSIDE for w in names.split()))


def around(key: str) -> bool:
    """May the block stand around the whole page, as a form or as what a script shows later?"""
    tag, _, rest = key.partition("|")
    return tag == "form" or rest.partition("|")[0] == "hidden"


class Spot:
    """All parts of a wrapper with one path of keys, and what becomes of their text."""

    __slots__ = ("key", "kids", "chars", "linked", "fixed", "whole", "free", "marked", "heading", "out", "article")

    def __init__(self, key: str):
        self.key, self.kids, self.chars, self.linked, self.fixed = key, {}, 0, 0, None
        self.whole = self.free = self.marked = 0
        self.heading = key == "h" or key.partition("|")[0] in HEADINGS
        self.out = self.article = False

    def take(self, part: list) -> None:
        self.chars += part[CHARS]
        self.linked += part[LINKED]
        if part[CHARS]:
            self.fixed = bool(len(part[PAGES]) >= MANY_PAGES and part[SAME]) and self.fixed is not False
        for p in part[PARTS]:
            if p[KEY] not in self.kids:
                self.kids[p[KEY]] = Spot(p[KEY])
            self.kids[p[KEY]].take(p)

    @property
    def box(self) -> bool:
        return self.key != "p" and self.key != "h" and self.key.partition("|")[0] not in PIECES

    def under(self, key: str) -> Spot | None:
        return self.kids.get(key) or self.kids.get(general(key))

    def weigh(self) -> None:
        """``whole``: text outside links that no tag leaves out; ``marked``: of it, in marked parts; ``free``: of that, what no name speaks against."""
        self.whole, self.marked, self.free = self.chars - self.linked, 0, 0
        for kid in self.kids.values():
            kid.weigh()
            self.heading = self.heading or kid.heading
            if not outside(kid.key) or around(kid.key):
                self.whole, self.marked, self.free = self.whole + kid.whole, self.marked + kid.marked, self.free + kid.free
        if inside(self.key) == 2:
            self.marked = self.free = self.whole
        if named_outside(self.key) or around(self.key):
            self.free = 0

    def judge(self, total: int, marked: int) -> None:
        """Sets ``out``. ``marked``: the text in marked parts if all of it is in boxes whose names speak against them, else 0."""
        holds = 2 * self.marked > marked > 0 or 10 * self.whole >= 8 * total > 0
        if around(self.key):
            self.out = not holds
        elif outside(self.key):
            self.out = True
        elif named_outside(self.key):
            # Below a box that holds the article, the same question is asked of its parts.
            self.out = not holds and (self.box or self.fixed is not False or 2 * self.linked > self.chars)
        for kid in self.kids.values():
            kid.judge(total, marked)

    def text(self) -> int:
        """Characters outside links that are not left out."""
        return 0 if self.out else self.chars - self.linked + sum(k.text() for k in self.kids.values())

    def all_fixed(self) -> bool:
        return self.fixed is not False and all(k.all_fixed() for k in self.kids.values())


def article_spots(wrapper: list, infer: bool = True) -> tuple[Spot, bool]:
    """The wrapper's parts, judged, and whether some were left out for not varying. ``infer`` off: by marks and names only."""
    root = Spot("page")
    root.take(wrapper)
    root.weigh()
    for kid in root.kids.values():
        kid.judge(root.whole, 0 if root.free else root.marked)
    marks: dict[int, list[Spot]] = {1: [], 2: []}

    def widest(spot: Spot, mark: int) -> None:
        if spot.out:
            return
        if inside(spot.key) == mark and spot.text() > 0:
            marks[mark].append(spot)
        else:
            for kid in spot.kids.values():
                widest(kid, mark)

    def each(spot: Spot):
        yield spot
        for kid in spot.kids.values():
            yield from each(kid)

    for mark, least in ((2, 0), (1, 0.3 * root.text())):
        widest(root, mark)
        # Names only sound like an article, so that the parts must hold a good part of the text together.
        if sum(s.text() for s in marks[mark]) > least:
            for spot in marks[mark]:
                spot.article = True
                fixed = [s for s in each(spot) if s is not spot and s.box and (s.chars or s.kids) and s.all_fixed() and any(x.chars for x in each(s))]
                for s in fixed if infer else ():
                    s.out = True
            return root, False
    root.article = True
    if not infer:
        return root, False
    dropped = False
    for spot in each(root):
        if spot is not root and spot.chars and (spot.fixed or 2 * spot.linked > spot.chars):
            spot.chars = spot.linked = 0
            spot.article, dropped = None, True  # its own text goes, not that of its parts
    # The slots: go down to the box that holds most of the text that varies, and leave out the boxes beside it.
    at, many = root, len(wrapper[PAGES]) >= MANY_PAGES
    while many and at.text():
        most = max(at.kids.values(), key=Spot.text, default=None)
        if most is None or 10 * most.text() < 8 * at.text():
            break
        for kid in at.kids.values():
            if kid is not most and kid.box and not kid.heading and not kid.out and kid.text():
                kid.out = dropped = True
        at = most
    return root, dropped


def main_text(page: Page, root: Spot) -> str | None:
    """The texts of the article's spots in page order, joined by spaces; None if the page has no such spot."""
    spots: list[Spot | None] = []
    shown: list[bool] = []  # in the article
    out: list[bool] = []
    seen = root.article is True
    for parent, key in page.nodes:
        if parent < 0:
            spots.append(root)
            shown.append(root.article is True)
            out.append(False)
            continue
        spot = spots[parent].under(key) if spots[parent] else None
        spots.append(spot)
        out.append(out[parent] or (spot.out if spot else outside(key) or named_outside(key)))
        shown.append(not out[-1] and (shown[parent] or bool(spot and spot.article)))
        seen = seen or shown[-1]
    return " ".join(text for node, text, _ in page.texts if shown[node] and not (spots[node] and spots[node].article is None)) if seen else None


def read_page(html: str, root: Spot, dropped: bool) -> str:
    page = parse(html)
    found = main_text(page, root)
    return found if found or (found is not None and not dropped) else main_text(page, article_spots(wrapper_of(page))[0]) or ""


def extract(html: str, wrapper: str, infer: bool = True) -> str:
    return read_page(html, *article_spots(json.loads(wrapper), infer))


def merged(wrappers: Iterable[list]) -> list | None:
    out = None
    for w in wrappers:
        out = w if out is None else joined(out, w)
    return out


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host``, ``wrapper`` (JSON) and ``n`` (its pages) from ``host`` and ``html``."""
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("n", pa.int64())])

    def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                if html.is_valid and (text := html.as_py()):
                    own = wrapper_of(parse(text))
                    found[host] = [joined(found[host][0], own), found[host][1] + 1] if host in found else [own, 1]
            yield pa.RecordBatch.from_pydict({"host": list(found), "wrapper": [json.dumps(w) for w, _ in found.values()], "n": [n for _, n in found.values()]}, schema)

    def by_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, wrapper, pages_here = None, None, 0
        for batch in batches:
            made: list[dict] = []
            for row in batch.to_pylist():
                if here is not None and row["host"] != here:
                    made.append({"host": here, "wrapper": json.dumps(wrapper), "n": pages_here})
                    wrapper, pages_here = None, 0
                here, wrapper = row["host"], merged(w for w in (wrapper, json.loads(row["wrapper"])) if w is not None)
                pages_here += row["n"]
            yield pa.RecordBatch.from_pylist(made, schema)
        if here is not None:
            yield pa.RecordBatch.from_pylist([{"host": here, "wrapper": json.dumps(wrapper), "n": pages_here}], schema)

    fields = "host string, wrapper string, n long"
    return pages.select("host", "html").mapInArrow(by_batch, fields).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(by_host, fields)


#: Pages of a host that meet its wrapper together; larger hosts are cut into stretches. Large hosts that are broadcast, at most.
STRETCH, FEW_HOSTS = 256, 100_000


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    hosted = pages.select("page_id", "url", host_of().alias("host"), "html")
    wrappers = materialize(infer_wrappers(hosted))
    kind = dict(hosted.dtypes)["page_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [zlib.compress(x.as_py().encode(), 1) if x.is_valid else b"" for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["page_id", "url", "host", "packed"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, judged = None, None
        for batch in batches:
            ids, urls, texts = [], [], []
            for at, (host, is_page, packed) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4))):
                content = zlib.decompress(packed.as_py()).decode() if packed.is_valid and len(packed.as_py()) else ""
                if not is_page:
                    here, judged = host, article_spots(json.loads(content))
                else:
                    ids.append(at)
                    texts.append(read_page(content, *judged) if content and host == here else "")
            kept = batch.take(pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    packed = hosted.mapInArrow(pack, f"page_id {kind}, url string, host string, packed binary")
    stretches = F.ceil(F.col("n") / STRETCH).cast("int")
    large = materialize(wrappers.where(F.col("n") > STRETCH).select("host", stretches.alias("_stretches")))
    # Large hosts are few; should they not be, the pages are joined with them by a shuffle.
    rows = packed.join(F.broadcast(large) if large.count() <= FEW_HOSTS else large, "host", "left") \
        .select("page_id", "url", "host", F.lit(True).alias("is_page"), "packed",
                F.pmod(F.xxhash64("page_id", "url"), F.coalesce("_stretches", F.lit(1))).cast("int").alias("stretch"))

    def pack_wrapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(w.as_py().encode(), 1) for w in batch.column(1)], pa.binary()), batch.column(2)],
                                             names=["host", "packed", "n"])

    heads = wrappers.mapInArrow(pack_wrapper, "host string, packed binary, n long") \
        .select(F.lit(None).cast(kind).alias("page_id"), F.lit(None).cast("string").alias("url"), "host", F.lit(False).alias("is_page"), "packed",
                F.explode(F.sequence(F.lit(0), stretches - 1)).alias("stretch"))
    met = rows.unionByName(heads).repartition("host", "stretch").sortWithinPartitions("host", "stretch", "is_page") \
        .select("page_id", "url", "host", "is_page", "packed")
    return met.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
