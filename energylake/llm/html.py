"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its path of tags from the root.  For every
path the text length and the punctuation of its blocks are summed up and divided by
their number; the two ratios are fused into one score, less for text inside links, and the
scores are smoothed along the page, so that a short heading between long
paragraphs scores with them.  The blocks of paths at or above the threshold are content.  Added are the
headings right before them and the other blocks of the main element, which is the innermost
element that holds nearly all their text, or the article element that holds most of it.  Parts that are never
content (menus, forms, scripts, comments and the like) are left out before.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: share of the mean path score from which a path is content
THRESHOLD = 0.5
#: weights of a block's neighbours, one and two blocks away
SMOOTHING = (0.6, 0.2)
#: share of the content paths' text that the main element holds at least
HELD = 0.9

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main "
    "menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead "
    "title tr ul".split()
)
#: elements that an opening tag ends, up to the element that bounds the search
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: elements in which a paragraph may stand open while others begin
KEEPS_PARAGRAPH = {"button", "caption", "td", "th", "table", "object", "marquee", "template"}
NEVER = RAW - {"title"} | set(
    "head nav footer aside template svg math button select option datalist dialog menu object "
    "canvas audio video map search".split()
)
#: last words of a class, id or role of parts that are no content
UNWANTED = set(
    "ad ads advert advertisement advertising adbox sponsor sponsored promo promotion banner sidebar "
    "side aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar "
    "discussion cookie cookies consent gdpr notice alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations widget pagination pager search contentinfo complementary".split()
)
#: words of parts in which readers speak, wherever they stand in a name
COMMENTS = set("comment comments commentlist respond reply replies disqus".split())
#: names that mark content: unwanted ones beside them are in doubt
WANTED = set("article content post entry story main body text page wrapper container".split())
#: first words of names that tell how the page is laid out
LAYOUT = {"has", "with", "no", "without", "is"}
#: elements whose id is looked at; those of text blocks and anchors come from their headings
CONTAINERS = set("div section ul ol dl table figure center details fieldset iframe".split())
PUNCTUATION = re.compile(r"[,.;:!?。，；：！？、]")

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|(?P<open>\Z))"""
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|(?P<open2>\Z))"
    r"|</[^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}
NAME_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


@dataclass(eq=False)
class Element:
    name: str
    parent: Element | None
    dropped: bool
    article: bool = False
    #: number of its tag path; element and path of text blocks go by the innermost block element
    path: int = 0
    #: elements around it
    depth: int = 0
    #: the innermost part around it whose text decides if it is content
    part: Part | None = None
    #: the outermost article element around it
    top_article: Element | None = None
    #: text of content paths inside
    mass: float = 0.0


@dataclass(eq=False)
class Part:
    """A part in doubt, and what its text amounts to."""

    name: str
    outer: Part | None
    #: whether no part around it, itself included, is in doubt by its name
    only_forms: bool
    chars: int = 0
    linked: int = 0
    prose: int = 0
    paragraphs: int = 0
    gone: bool = False


class Paths:
    """Tag paths from the root, each a number: one for every pair of a path and a tag below it."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, str], int] = {}
        self.steps: list[tuple[int, str]] = [(0, "")]

    def below(self, path: int, name: str) -> int:
        number = self.numbers.get((path, name))
        if number is None:
            number = self.numbers[path, name] = len(self.steps)
            self.steps.append((path, name))
        return number

    def text(self, path: int) -> str:
        names = []
        while path:
            path, name = self.steps[path]
            names.append(name)
        return "".join(f"/{name}" for name in reversed(names))


@dataclass
class Page:
    """Blocks in page order, elements in order of their opening tags, and paths."""

    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    parts: list[Part] = field(default_factory=list)
    paths: Paths = field(default_factory=Paths)


class Open:
    """The elements that are open, with the places of each name among them."""

    def __init__(self, root: Element) -> None:
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self.stack))
        if element.name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def cut(self, depth: int) -> list[Element]:
        """Close all from a depth on; those that were closed."""
        closed = self.stack[depth:]
        del self.stack[depth:]
        for element in closed:
            self.places[element.name].pop()
        while self.blocks[-1] >= depth:
            self.blocks.pop()
        return closed

    def last(self, name: str) -> int:
        """Place of the innermost open element of a name, 0 without one."""
        places = self.places.get(name)
        return places[-1] if places else 0

    def outermost(self, names: set[str], bounds: set[str]) -> int:
        """The outermost of `names` inside the innermost of `bounds`, 0 without one."""
        bound = max(map(self.last, bounds))
        found = []
        for name in names:
            places = self.places.get(name)
            if places and places[-1] > bound:
                found.append(places[bisect.bisect_right(places, bound)])
        return min(found, default=0)

    @property
    def holder(self) -> Element:
        """The innermost block element."""
        return self.stack[self.blocks[-1]]


@dataclass(eq=False)
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    score: float = 0.0


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}


def _unwanted(name: str, rest: str, inside_article: bool) -> float:
    """1 if an element and all in it are no content by its tag and attributes, 0 if nothing says
    so, and 0.5 if its text must decide."""
    if name in NEVER or name == "header" and not inside_article:
        return 1
    if name == "form":
        return 0.5
    if name in ("html", "body") or not rest.strip():
        return 0
    given = _attributes(rest)
    style = given.get("style", "").replace(" ", "").lower()
    if "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in style:
        return 1
    kept = name in ("article", "main")
    found, wanted = 0.0, kept
    for key in ("class", "role", "id"):
        if key == "id" and name not in CONTAINERS:
            continue
        for mark in given.get(key, "").split():
            words = [w.lower() for w in NAME_WORD.findall(mark)]
            if not words or words[0] in LAYOUT:
                continue
            # ids inside the content, or of sections, may be made from headings
            slug = key == "id" and (inside_article or name == "section")
            if COMMENTS.intersection(words) and not (slug and len(words) > 2):
                if not kept or len(words) == 1:
                    return 1
            elif words[-1] in UNWANTED:
                found = max(found, 0.5 if slug else 1)
            elif UNWANTED.intersection(words):
                found = max(found, 0.5)
            wanted |= len(words) == 1 and words[0] in WANTED
    if kept:
        return 0
    return min(found, 0.5) if wanted else found


def _decided(page: Page) -> list[Block]:
    """The page's blocks without those of doubtful parts that do not read like the rest of the page.

    A form stays if it holds most of the page's text.  Any other part stays if less than half of its text
    is linked and its blocks, headings left out, are at least half as long as those beyond doubt.
    """
    if not page.parts:
        return page.blocks
    sure = []
    for b in page.blocks:
        part, prose = b.element.part, b.element.name not in HEADINGS
        if part:
            part.chars += len(b.text)
            part.linked += min(b.linked, len(b.text))
            part.prose += len(b.text) * prose
            part.paragraphs += prose
        if prose and (part is None or part.only_forms):
            sure.append(len(b.text))
    # parts stand in the order of their tags, so inner ones come after outer ones
    for part in reversed(page.parts):
        if part.outer:
            part.outer.chars += part.chars
            part.outer.linked += part.linked
            part.outer.prose += part.prose
            part.outer.paragraphs += part.paragraphs
    whole = sum(len(b.text) for b in page.blocks)
    usual = sum(sure) / len(sure) if sure else 0.0
    for part in page.parts:
        if part.name == "form":
            keep = 2 * part.chars > whole
        else:
            keep = (
                2 * part.linked < part.chars
                and part.paragraphs > 0
                and part.prose / part.paragraphs >= THRESHOLD * usual
            )
        part.gone = not keep or bool(part.outer and part.outer.gone)
    return [b for b in page.blocks if not (b.element.part and b.element.part.gone)]


def read_page(source: str) -> Page:
    """Blocks of text in page order, without those that are never content."""
    root = Element("#root", None, False)
    page = Page(elements=[root])
    opened = Open(root)
    current: Block | None = None
    links = 0

    def add(text: str) -> None:
        nonlocal current
        if opened.stack[-1].dropped or not text:
            return
        text = entities.unescape(text)
        if current is None:
            if text.isspace():
                return
            current = Block(opened.holder)
            page.blocks.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text)

    def pop_to(depth: int) -> None:
        nonlocal current, links
        for element in opened.cut(depth):
            links -= element.name == "a"
            if element.name in BLOCK:
                current = None

    def close(names: set[str], bounds: set[str]) -> None:
        """End the innermost-first run of `names`, not beyond an element of `bounds`."""
        outermost = opened.outermost(names, bounds)
        if outermost:
            pop_to(outermost)

    at = 0
    while True:
        found = TAG.search(source, at)
        add(source[at : found.start() if found else len(source)])
        if not found:
            break
        at = found.end()
        name = found["name"] or found["name2"]
        if not name or found["open"] is not None or found["open2"] is not None:
            continue
        name = name.lower()
        rest = found["rest"] or found["rest2"] or ""
        if found["end"] or found["end2"]:
            if opened.last(name):
                pop_to(opened.last(name))
            continue
        if name == "br":
            add(" ")
            continue
        if name in BLOCK:
            close({"p"}, KEEPS_PARAGRAPH)
            current = None
        if name in CLOSES:
            close(*CLOSES[name])
        if name in VOID:
            continue
        if name in RAW:
            end = RAW_END[name].search(source, at)
            at = end.end() if end else len(source)
            continue
        parent = opened.stack[-1]
        inside = parent.article or name in ("article", "main")
        unwanted = _unwanted(name, rest, inside)
        control = name in ("label", "legend") and opened.last("form") > 0
        element = Element(
            name, parent, parent.dropped or unwanted == 1 or control, inside,
            page.paths.below(parent.path, name) if name in BLOCK else parent.path,
            parent.depth + 1, parent.part, parent.top_article,
        )
        if unwanted == 0.5:
            outer = parent.part
            element.part = Part(name, outer, name == "form" and (outer is None or outer.only_forms))
            page.parts.append(element.part)
        if name == "article" and element.top_article is None:
            element.top_article = element
        page.elements.append(element)
        opened.push(element)
        links += name == "a"
    for block in page.blocks:
        block.text = " ".join("".join(block.parts).split())
    page.blocks = [b for b in page.blocks if b.text]
    page.blocks = _decided(page)
    return page


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """Smoothed and fused ratio of every path."""
    sums: dict[int, np.ndarray] = {}
    for b in blocks:
        row = (1, len(b.text), len(PUNCTUATION.findall(b.text)), min(b.linked, len(b.text)))
        sums[b.element.path] = sums.get(b.element.path, np.zeros(4)) + row
    fused = {
        path: (chars / n * (1 + marks) / n) ** 0.5 * (1 - linked / chars)
        for path, (n, chars, marks, linked) in sums.items()
    }
    own = np.array([fused[b.element.path] for b in blocks])
    padded = np.pad(own, len(SMOOTHING), mode="edge")
    weights = np.array([*reversed(SMOOTHING), 1.0, *SMOOTHING])
    smooth = np.convolve(padded, weights / weights.sum(), mode="valid")
    total: dict[int, list[float]] = {}
    for b, s in zip(blocks, smooth, strict=True):
        total.setdefault(b.element.path, []).append(float(s))
    return {path: sum(v) / len(v) for path, v in total.items()}


def _content(blocks: list[Block]) -> list[Block]:
    """Blocks of the paths whose score reaches the threshold; there is at least one block."""
    scores = path_scores(blocks)
    mean = sum(scores[b.element.path] for b in blocks) / len(blocks)
    for b in blocks:
        b.score = scores[b.element.path]
    return [b for b in blocks if b.score >= THRESHOLD * mean]


def _main_element(content: list[Block], elements: list[Element]) -> Element:
    """The element that is the main content."""
    for b in content:
        b.element.mass += len(b.text) * b.score
    # elements stand in the order of their tags, so inner ones come after outer ones
    for e in reversed(elements):
        if e.parent:
            e.parent.mass += e.mass
    whole = elements[0].mass
    named = [e for e in elements if e.mass and e.name in ("article", "main")]
    if named:
        # the innermost of those that hold most
        most = max(e.mass for e in named)
        if most >= 0.5 * whole:
            return max((e for e in named if e.mass >= 0.8 * most), key=lambda e: e.depth)
    element = max((e for e in elements if e.mass >= HELD * whole), key=lambda e: e.depth)
    # a single paragraph is not yet the whole article
    while element.parent and element.name not in ("div", "section", "td", "body", "html", "#root", "main", "article"):
        element = element.parent
    return element


def extract(page: str | None) -> str:
    """Main text: blocks in page order, one per line."""
    read = read_page(page or "")
    blocks = read.blocks
    if not blocks:
        return ""
    content = _content(blocks)
    main = _main_element(content, read.elements)
    named = main.name in ("article", "main")
    inside = {id(main)}
    for e in read.elements:
        if id(e.parent) in inside:
            inside.add(id(e))
    held = {id(b): id(b.element) in inside for b in blocks}
    # other articles with the same paths as the main one: the threshold holds for their text ratio
    sizes: dict[int, list[int]] = {}
    for b in content:
        other = None if held[id(b)] else b.element.top_article
        sizes.setdefault(id(other) if other else 0, []).append(len(b.text))
    own = [len(b.text) for b in content if held[id(b)]]
    usual = sum(own) / len(own)
    teasers = {k for k, v in sizes.items() if k and sum(v) / len(v) < THRESHOLD * usual}
    chosen = {
        id(b) for b in content if held[id(b)] or id(b.element.top_article) not in teasers
    }
    for b in blocks:
        # in an element that is no article, blocks below the threshold may be lists of links
        if held[id(b)] and (named or 2 * b.linked <= len(b.text)):
            chosen.add(id(b))
    after = False
    for b in reversed(blocks):
        if b.element.name in HEADINGS and after and id(b.element.top_article) not in teasers:
            chosen.add(id(b))
        after = id(b) in chosen
    return "\n".join(b.text for b in blocks if id(b) in chosen)


def extract_pages(
    pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")
) -> DataFrame:
    """Columns `keep`, text and n_chars of every row.

    Every page is extracted by itself.  A null or empty page, or one without text, has an empty text; rows with null or
    repeated ids are kept as they are; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py()) for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string())],
                [f"k{i}" for i in range(len(keep))] + ["text"],
            )

    rows = pages.select(
        F.col(html_col).alias("html"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    )
    kinds = [f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = map_arrow(rows, run, ", ".join([*kinds, "text string"]))
    return out.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "text",
        F.length("text").cast("long").alias("n_chars"),
    )
