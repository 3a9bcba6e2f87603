"""Main text of web pages from flat text blocks and a decision tree.

Markup is read once from front to back and flattened into text blocks.  A block has its
word count, its link density and the same two of the blocks before and behind it;
whether it stands in a content element, in a boilerplate element or in a heading, as far
as markup says so; and whether there is a block on either side.  A decision tree fitted
to a table of labelled blocks (LAYOUTS) says which blocks are main text.

The fitted tree (shown by `describe(train())`) first asks whether markup says boilerplate.
In content elements it then asks for link density: of linked blocks there it keeps those
that stand between texts.  Without such markup word counts and link densities of the block
and its neighbours decide alone.

An advert or a comment on an inline element leaves its paragraph and is a block of its
own.  A link ends with the block that it began in.  A form around an article or main
element is the page's and not boilerplate.

Defined cases: null or blank html gives empty text; markup that never closes is read as
far as it goes; unknown tags are inline; repeated rows are each extracted; columns beyond
page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import tree

# HTML elements by their role in the flow
BREAKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = set("script style title noscript template svg iframe textarea select object canvas button audio video math datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# a start tag ends an open element of these, unless an element of the second set stands between
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"menu"})}
CONTENT_TAGS = {"article", "main"}
BOILER_TAGS = set("nav aside footer form menu dialog".split())
# Words of class names and ids
CONTENT_NAMES = set("article content post entry story main text articlebody body".split())
BOILER_NAMES = set("ad ads advert advertisement adverts banner sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments respond reply disqus cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup share sharing social related recommended widget login search pagination toolbar complementary contentinfo alert skip copyright legal".split())
HEADER_NAMES = {"header", "masthead"}
# Words that say where an element is or what shape it has, and nothing of what it holds
PLACE_NAMES = set("area aside bar block body bottom box btn button buttons cell col cols column container content feed fixed float form global grid group head holder icon icons inner item items left level line link links list lists lower main margin menu mini mobile module nav outer page panel placeholder posts primary rail region right row secondary section sidebar site slot slots stack sticky strip tab tabs text thread title top unit upper view widget wide wrap wrapper zone".split())
_SIZE = re.compile(r"\d+(?:x\d+)?")
DENIED = {"no", "has", "with", "without", "hide", "non"}  # `no-sidebar` is a name of the page, not of a side bar

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "in_content", "in_boilerplate", "heading", "first", "last")
# The labelled table: a line is a page's blocks in order.  A block is its label (+ main text, - not), what
# markup says of its place (c content, b boilerplate, . nothing) and of it (h heading), its words, and its
# linked words if any.
LAYOUTS = """
-b2/2 -b1/1 -b3/3 -b8 +ch7 +c12 +c60 +c35 +c110/2 +c1 +c80 -b12
-b1/1 -b1/1 -b1/1 -b6 +ch4 +c4 -b9
-b4/4 -bh2 -b25 +ch9 +c45/4 +ch3 +c30 +c6 +c2 +c90 -b20 -b70 -b40
-b3/3 +ch8 +c50 +c7/7 +c64 +c3/3 -b2/2
+ch5 +c40 +c80 -b2/2 -b2/2 -b1/1
-.1/1 -.2/2 -.1/1 +ch6 +c70 +c80 -.2/2 -.3/3 -.2/2
+ch6 +c33 +c14/14 +c52 -c2/2 -c3/3 -c2/2 -c4/4
-c1/1 -c2/2 -c2/2 +ch9 +c85 +c20/9 +c47 -c3/3 -c4/4
+c5 +c9 +c70 -b11 +c66 -b30/4 +c18 -b15 -b50 -b22
+c60 -b14 +c8 +c5 -b120 -b6 -b95
+ch3 +c2 +c3 +c1 +c4 -b2
+c1
+c3/3
+ch10/10 +c55 +c70 -b1/1
+c20 +c9/4 +c6/6 +c9/3 +c41
-b3 -bh5 -b60 -b30/20 -b2/2
-b7 -b140 -b2/2 -b35
-.1/1 -.2/2 -.1/1 -.2/2 +.h7 +.65 +.110/3 +.48 -.2/2 -.3/3 -.6
-.2/2 -.2/2 +.h5 +.22 +.70 +.9 +.55 +.h4 +.31 -.7/6 -.9
-.3 -.1/1 -.1/1 +.h8 +.40 +.5 +.44 +.38 -.5/5
-.1/1 -.1/1 -.1/1 +.12 +.90 +.35/2 -.4/4 -.2/2
+.h6 +.80 +.75 -.1/1 -.1/1 -.2/2
+.h9 +.30 +.95 -.5
+.52 +.61 +.18 +.47 -.8/5
-.12/10 -.2/2 +.h6 +.33 +.41 +.27 -.14/12
+.1
+.5
+.60
+.h4 +.50
-.3/3
-.2/2 -.2/2 -.h2 -.2/2 -.3/3 -.h1 -.2/2
-.4 -.2/2 -.3/3 -.4 -.2/2
-.2/2 -.6 -.3/3 +.h5 +.72 +.16 +.58 -.3/3 -.8 -.4/4
-.h3 -.1/1 -.2/2 +.h8 +.44 +.15 +.36 -.30/27 -.18/16
-.1/1 -.1/1 -.2/2 -.8 +.h9 +.30 +.58 +.21 -.9
-.2/2 -.3/3 -.11 +.h4 +.14 +.33 -.2/2 -.3/3 -.4
-.1/1 -.7 +.h7 +.100 +.80 -.11
-.1/1 -.1/1 -.5 +.h12 +.17 +.9 +.62 +.13 -.10
-.2/2 +.h3 +.40 -.1/1 -.2
-.2/2 +.h6 +.20 +.25 -.1/1 -.6
+ch5 +c8/8 +c30 +c45/45 +c52 +c2/2 +c28
+ch7 +c33/33 +c12 +c16/15 +c41 +c5/5 +c57 -b2/2
+ch4 +c75 +c3/3 +c110 +c9/9 +c200
+c40 +c6/6 -b9
+ch6 +c22 +c11/11
+ch9 +c30 -c1/1 -c1/1 -c2/2 -b3/3
+ch9 +c56 -c4/4 -c4/4 -c3/3 +c48 +c60
+ch2 +c2 +c1 -b1/1
+ch5 +c4 +c3 -b2/2 -b3/3
+ch3 +c6 -.2/2 -.1/1
"""


@dataclass
class Block:
    text: str
    words: int
    linked: int
    content: bool
    boilerplate: bool
    heading: bool
    form: bool = False


def _names_boilerplate(parts: list[str]) -> bool:
    """Whether the words of a class or id name boilerplate: the last one does (`reader-comments`), or an earlier one
    does and what follows only says where and how (`cookie-bar-inner`).  `share-price` and `login-form-guide` do not."""
    for i in range(len(parts) - 1, -1, -1):
        if parts[i] in BOILER_NAMES:
            return True
        if parts[i] not in PLACE_NAMES and parts[i] not in HEADER_NAMES and not _SIZE.fullmatch(parts[i]):
            return False
    return False


def _marks(name: str, attributes: str, inside_content: bool) -> tuple[bool, bool]:
    """Whether an element begins content or boilerplate; no name makes an article or main element boilerplate."""
    content, boiler = name in CONTENT_TAGS, name in BOILER_TAGS
    if name == "header":
        boiler = not inside_content
    if not attributes:
        return content, boiler
    if _HIDDEN.search(attributes):
        boiler = True
    if "=" in attributes:
        for found in _NAMED.findall(attributes):
            for whole in "".join(found).lower().split():
                parts = re.split(r"[-_]+", whole)
                if parts[0] in DENIED or name in ("html", "body"):
                    continue
                own = bool(CONTENT_NAMES.intersection(parts))
                content |= own
                if name in CONTENT_TAGS:
                    continue
                boiler |= _names_boilerplate(parts)
                # the header of a page is boilerplate, that of an article is not
                boiler |= not inside_content and not own and not HEADER_NAMES.isdisjoint(parts)
    return content, boiler


class _Open:
    """An open element and what its text is."""

    __slots__ = ("boiler", "content", "form", "name")

    def __init__(self, name: str, content: bool, boiler: bool, form: bool) -> None:
        self.name, self.content, self.boiler, self.form = name, content, boiler, form


class _Reader:
    """Text blocks of the markup read so far."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack = [_Open("", False, False, False)]
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self.link = 0  # depth of the stack where the open link began, 0 without one
        self.aside: list[tuple[str, int, list[str], list[str], int]] = []  # marked inline elements: name, same inside, what they interrupt

    def add(self, text: str) -> None:
        if text:
            self.pieces.append(text)
            if self.link:
                self.linked.append(text)

    def emit(self, boiler: bool, form: bool = False) -> None:
        words = entities.unescape("".join(self.pieces)).split()
        if words:
            top = self.stack[-1]
            linked = len(entities.unescape("".join(self.linked)).split()) if self.linked else 0
            self.out.append(Block(" ".join(words), len(words), min(len(words), linked), top.content, boiler, top.name in HEADINGS, form))

    def close(self) -> None:
        """A block ends."""
        while self.aside:
            self.resume()
        if self.pieces:
            self.emit(self.stack[-1].boiler, self.stack[-1].form)
            self.pieces, self.linked = [], []

    def interrupt(self, name: str) -> None:
        """A marked inline element begins: its text is a boilerplate block of its own."""
        self.aside.append((name, 0, self.pieces, self.linked, self.link))
        self.pieces, self.linked = [], []

    def resume(self) -> None:
        self.emit(True)
        _, _, self.pieces, self.linked, self.link = self.aside.pop()
        self.link = 0 if self.link >= len(self.stack) + 1 else self.link

    def shrink(self, to: int) -> None:
        del self.stack[to:]
        if self.link > to:
            self.link = 0

    def start(self, name: str, attributes: str) -> None:
        """A block element begins."""
        self.close()
        if self.stack[-1].name == "p":
            self.shrink(len(self.stack) - 1)
        ends, walls = ENDS.get(name, ((), ()))
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in walls or not ends:
                break
            if self.stack[i].name in ends:
                self.shrink(i)
                break
        if attributes.endswith("/") or name == "hr":
            return
        top = self.stack[-1]
        begins, boils = _marks(name, attributes, top.content)
        form = name == "form" and not top.boiler
        self.stack.append(_Open(name, top.content or begins, top.boiler or (boils and not form), name not in CONTENT_TAGS and (top.form or form)))

    def end(self, name: str) -> None:
        """A block element ends."""
        self.close()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == name:
                self.shrink(i)
                break


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    read = _Reader()
    skip, skip_depth, at = "", 0, 0
    for m in _TOKEN.finditer(page):
        if not skip:
            read.add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, end, attributes = m[2].lower(), m[1] == "/", m[3]
        if skip:
            if name == skip:
                skip_depth += -1 if end else (0 if skip in ("script", "style", "title", "textarea") else 1)
                if skip_depth <= 0:
                    skip = ""
        elif name in SKIPPED:
            if not end and not attributes.endswith("/"):
                skip, skip_depth = name, 1
            read.add(" ")
        elif name in BREAKS:
            read.end(name) if end else read.start(name, attributes)
        elif name == "br":
            read.add(" ")
        elif name in VOID:
            continue
        else:
            if read.aside and name == read.aside[-1][0]:
                mark = read.aside[-1]
                if not end:
                    read.aside[-1] = (mark[0], mark[1] + 1, *mark[2:])
                elif mark[1]:
                    read.aside[-1] = (mark[0], mark[1] - 1, *mark[2:])
                else:
                    read.resume()
                    read.add(" ")
            elif not end and "=" in attributes and not attributes.endswith("/") and _marks(name, attributes, True)[1] or not end and attributes and _HIDDEN.search(attributes):
                read.add(" ")
                read.interrupt(name)
            if name == "a":
                read.link = 0 if end else len(read.stack)
    if not skip:
        read.add(page[at:])
    read.close()
    # a form is boilerplate, unless it is wrapped around the page
    words = lambda some: sum(b.words for b in read.out if some(b))
    if 2 * words(lambda b: b.form and not b.boilerplate) < words(lambda b: not b.boilerplate):
        for b in read.out:
            b.boilerplate |= b.form
    return read.out


def features(found: list[Block]) -> np.ndarray:
    own = np.array([[b.words, b.linked / b.words] for b in found]).reshape(-1, 2)
    none = np.zeros((1, 2))
    flags = np.array([[b.content, b.boilerplate, b.heading] for b in found], float).reshape(-1, 3)
    edge = np.zeros((len(found), 2))
    edge[:1, 0] = edge[-1:, 1] = 1
    return np.hstack([own, np.vstack([none, own])[: len(own)], np.vstack([own, none])[1:], flags, edge])


def labelled_table(layouts: str = LAYOUTS) -> np.ndarray:
    """FEATURES and label of each block of the layouts."""
    out = []
    for line in layouts.strip().splitlines():
        marks = [re.fullmatch(r"([+-])([cb.])(h?)(\d+)(?:/(\d+))?", x) for x in line.split()]
        found = [Block("", int(m[4]), int(m[5] or 0), m[2] == "c", m[2] == "b", bool(m[3])) for m in marks]
        out.append(np.hstack([features(found), [[m[1] == "+"] for m in marks]]))
    return np.vstack(out).astype(float)


def train(table: np.ndarray | None = None) -> tree.Node:
    table = labelled_table() if table is None else table
    return tree.fit(table[:, :-1], table[:, -1], depth=9)


def describe(node: tree.Node, depth: int = 0) -> str:
    """The tree as text."""
    pad = "  " * depth
    if node.feature < 0:
        return f"{pad}{node.share:.2f}\n"
    return f"{pad}{FEATURES[node.feature]} <= {node.bar:g}\n" + describe(node.low, depth + 1) + describe(node.high, depth + 1)


def main_text(page: str | None, model: tree.Node) -> tuple[str, int, int]:
    """Main text, number of blocks, and number of blocks kept."""
    found = blocks(page or "")
    if not found:
        return "", 0, 0
    keep = tree.predict(model, features(found)) >= 0.5
    texts = [b.text for b, k in zip(found, keep, strict=True) if k]
    return "\n\n".join(texts), len(found), len(texts)


def extract(pages: DataFrame, model: tree.Node | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) of every page."""
    model = train() if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [main_text(x.as_py(), model) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array([g[0] for g in got], pa.string()), *[pa.array([f(g) for g in got], pa.int64()) for f in (lambda g: len(g[0]), lambda g: g[1], lambda g: g[2])]],
                    names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
                )

    rows = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
