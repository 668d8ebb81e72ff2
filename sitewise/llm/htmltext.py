"""One page as a sequence of elements and text blocks, tolerant of what is unclosed or cut off."""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# fixed values: elements by what they do to text
RAW = frozenset("script style noscript template iframe svg math object textarea title select canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption "
    "address details summary header footer nav aside form fieldset center dialog menu button".split()
)
BOILER = frozenset("head nav footer aside form fieldset dialog menu button header".split())
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"html", "head", "body"}
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# fixed values: parts of class names, ids and roles of what is not the article
BOILER_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside cookie cookies consent gdpr notice banner ad ads adv advert adverts "
    "advertisement sponsor sponsored promo promotion popup modal newsletter subscribe signup social share sharing related recommended recommendations "
    "comment comments reply replies respond discussion disqus login search pagination pager toolbar widget contentinfo complementary dialog alert header".split()
)


#: Parts that make a name speak of the page around an element, not of the element.
ABOUT = frozenset("has no not with without".split())


@dataclass
class Block:
    """A text block: its text, its element (-1 outside all), whether it is boilerplate, whether it is in an article.

    ``hard`` is boilerplate by a tag other than a form, or hidden; ``mark`` is the innermost element around it that is boilerplate by a name or as a
    form, -1 without one; ``around`` that of its outermost article, None where no article is around it.
    """

    text: str
    element: int
    boiler: bool
    article: bool
    hard: bool = False
    mark: int = -1
    around: int | None = None


@dataclass
class Page:
    """Elements in page order, and the blocks with the number of elements opened before each.

    Every element has its tag, a key that tells it and the names of all elements around it, the element around it, the next marked element around it or -1, and
    whether it is in an article or one itself: nothing grows with the depth.
    """

    tags: list[str]
    names: list[str]
    keys: list[str]
    parents: list[int]
    marked: dict[int, int]
    articles: list[bool]
    blocks: list[tuple[int, Block]]

    def key(self, element: int) -> str:
        return self.keys[element] if element >= 0 else ""

    def tag(self, block: Block) -> str:
        return self.tags[block.element] if block.element >= 0 else ""

    def path(self, element: int, depth: int = 8) -> str:
        """The names of an element and those next around it, to look at."""
        parts: list[str] = []
        while element >= 0 and len(parts) < depth:
            parts.append(self.names[element])
            element = self.parents[element]
        return "".join(f">{p}" for p in reversed(parts))

    def marks(self, mark: int) -> list[int]:
        """A marked element and the marked ones around it."""
        out = []
        while mark >= 0:
            out.append(mark)
            mark = self.marked[mark]
        return out


def _names(attributes: str) -> tuple[list[str], list[str], bool]:
    """Parts of class, id and role, those of them that say what the element is, and is it hidden."""
    names, telling, hidden = [], [], False
    if not attributes.strip():
        return names, telling, hidden
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id", "role"):
            for name in value.split():
                parts = [n for n in re.split(r"[_-]+", name) if n]
                names += parts
                telling += parts if ABOUT.isdisjoint(parts) else []
        hidden = hidden or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", ""))
    return names, telling, hidden


def read_page(source: str, lifted: frozenset[int] = frozenset()) -> Page:
    """All elements and blocks of a page; white space in a block is one space, empty blocks are none.

    The elements numbered in ``lifted`` are not boilerplate by a name or as a form.
    """
    page = Page([], [], [], [], {}, [], [])
    # tag, and the block's element, boiler, article, hard, mark and around
    stack: list[tuple[str, int, bool, bool, bool, int, int | None]] = [("", -1, False, False, False, -1, None)]
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                page.blocks.append((len(page.tags), Block(text, *stack[-1][1:])))

    def close(tags) -> None:
        while len(stack) > 1 and stack[-1][0] in tags:
            stack.pop()

    at = 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:  # a bracket that opens nothing
            pieces.append(source[at])
            at += 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?")):
                pieces.append(html.unescape(m[0]))
            continue
        tag, ending = tag.lower(), m[1] == "/"
        if tag in RAW:
            if not ending and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if tag == "br" or tag == "hr":
            if tag == "hr":
                flush()
            pieces.append(" ")
            continue
        if tag not in BLOCK:
            continue
        flush()
        if ending:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag), 0)
            if depth:
                del stack[depth:]
            continue
        if tag in CLOSES_P:
            close({"p"})
        close(SIBLING.get(tag, ()))
        names, telling, hidden = _names(m[3])
        _, parent, boiler, article, hard, mark, around = stack[-1]
        number = len(page.tags)
        kept = article and (tag == "header" or "header" in names)  # an article's own heading
        hard = hard or hidden or (tag in BOILER and tag != "form" and not kept)
        named = tag not in ("html", "body") and any(n in BOILER_NAMES and not (n == "header" and article) for n in telling)
        if (named or (tag == "form" and not kept)) and number not in lifted:
            page.marked[number] = mark
            mark = number
        boiler = hard or mark >= 0
        if tag in MAIN and around is None and not hard:
            around = mark
        name = tag + "".join(f".{n}" for n in names[:4])
        page.tags.append(tag)
        page.names.append(name)
        page.keys.append(hashlib.blake2b(f"{page.key(parent)}>{name}".encode(), digest_size=12).hexdigest())
        page.parents.append(parent)
        page.articles.append(tag in MAIN or (parent >= 0 and page.articles[parent]))
        stack.append((tag, number, boiler, article or (tag in MAIN and not stack[-1][2]), hard, mark, around))
    flush()
    return page
