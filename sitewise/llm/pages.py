"""Main text of web pages, from the template that pages of one host share.

A token is an element with the names of those around it, or a whole text block in its place.  Its occurrence vector says how often it
is on each page of the host; tokens of equal vectors are an equivalence class.  Vectors are compared by 128-bit sums over pages, which
tasks add up in part, so a host of any size is only ever a table of tokens.  Classes of several tokens on a few pages or on half of the
host's are the templates of its layouts; a page meets those whose tokens it holds.  They are valid where their tokens keep one order;
nested in each other they are the page's template, and what lies between its tokens are slots.  Pages of equal html are one page.  A class on few
pages may also be a text that was copied, so it must have text that varies between its tokens and a token outside the article.
The article is taken from the slots inside the page's article, or where it has none, inside the element whose slots hold
most of the text that varies.  Menus, headers, footers, asides, forms, notices, adverts and comments are left out wherever they are, but an element
that is one by its class, id or role only, or a form, is read where it holds the page's article or nearly all text that varies.  A page
alone on its host has no template and is read by its own elements.  An article's title and the first paragraph under a shared title stay.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitewise.llm.bytetext import mix64
from sitewise.llm.common import in_small_batches, keyed_join
from sitewise.llm.htmltext import HEADINGS, Block, Page, read_page
from sitewise.session import durable

#: Tokens of a class at least, and pages it is on, fewer if they are ``FREQUENT`` of the host's; pages that are not few.
LARGE, SUPPORT, FREQUENT, MANY = 2, 3, 0.5, 10
_U = np.uint64
_SALTS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
TOKENS = "host string, page bigint, copies bigint, token bigint, path string, v1 bigint, v2 bigint, place double"


def _hashes(names: list[str]) -> np.ndarray:
    """64-bit hash of each string."""
    return np.frombuffer(b"".join(hashlib.blake2b(n.encode(), digest_size=8).digest() for n in names), _U)


def block_key(page: Page, block: Block) -> str:
    return f"{page.key(block.element)}\n{block.text}"


def page_tokens(page: Page) -> dict[str, list]:
    """Token -> [times, is it an element, path to look at, is it in an article]."""
    out: dict[str, list] = {}
    where = 0

    def seen(key: str, element: int, whole: bool) -> None:
        if key not in out:
            out[key] = [0, whole, page.path(element), element >= 0 and page.articles[element]]
        out[key][0] += 1

    for at, block in [*page.blocks, (len(page.tags), None)]:
        for element in range(where, at):
            seen(page.keys[element], element, True)
        where = at
        if block:
            seen(block_key(page, block), block.element, False)
    return out


def _tokens(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row without a token for each page, and its tokens with the page's share of their vectors."""
    for batch in stream:
        key = batch.column("page").to_numpy().view(_U)
        rows = (batch.column(c).to_pylist() for c in ("host", "page", "copies", "html"))
        columns: list[list] = [[] for _ in range(8)]
        for i, (host, page, copies, source) in enumerate(zip(*rows, strict=True)):
            found = page_tokens(read_page(source))
            names = list(found)
            times = np.array([found[n][0] for n in names], _U)
            for c, value in enumerate((host, page, copies)):
                columns[c] += [value] * (1 + len(names))
            columns[3] += [None, *_hashes(names).view(np.int64).tolist()]
            columns[4] += [None, *(found[n][2] if found[n][1] else None for n in names)]
            for k, salt in enumerate(_SALTS):
                columns[5 + k] += [0, *(mix64(key[i : i + 1] ^ salt) * times).view(np.int64).tolist()]
            columns[7] += [float(k) for k in range(-1, len(names))]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
        yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in TOKENS.split(", ")])


def _wrapped(name: str):
    """Sum modulo 2^64, from sums of either half of the bits."""
    low, high = F.sum(F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(name, 32))
    carried = F.shiftrightunsigned(low, 32) + high
    return F.shiftleft(carried, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF))).alias(name)


def found_tokens(pages: DataFrame) -> DataFrame:
    """Written tokens of the different pages of rows (host, page, html); rows of one host and page have equal html."""
    different = pages.groupBy("host", "page").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("copies"))
    return durable(different.mapInArrow(_tokens, TOKENS), "page-tokens")


def template_tokens(found: DataFrame) -> DataFrame:
    """Written rows (host, pages, token, class, size, on, place, path) of written tokens: the classes of all layouts of a host."""
    counts = durable(found.filter("token is null").groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter("pages > 1"), "page-hosts")
    tokens = found.filter("token is not null").groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("on"), _wrapped("v1"), _wrapped("v2"), F.avg("place").alias("place"), F.max("path").alias("path")
    )
    shared = durable(tokens.filter("on > 1"), "page-shared")
    frequent = keyed_join(shared, counts, ["host"], "pages").filter((F.col("on") >= SUPPORT) | (F.col("on") >= FREQUENT * F.col("pages")))
    # all tokens of a class are on one page, so it is no larger than a page
    members = F.sort_array(F.collect_list(F.struct("place", "token", "path")))
    classes = frequent.groupBy("host", "pages", "on", "v1", "v2").agg(members.alias("members")).withColumn("size", F.size("members")).filter(F.col("size") >= LARGE)
    flat = classes.select("host", "pages", F.xxhash64("v1", "v2").alias("class"), "size", "on", F.explode("members").alias("m"))
    return durable(flat.select("host", "pages", "m.token", "class", "size", "on", "m.place", "m.path"), "page-classes")


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, template) of rows (host, page, html), to look at: a host's template tokens as (token, class, place, path), by place."""
    parts = F.sort_array(F.collect_list(F.struct("place", "token", "class", "path")))
    return template_tokens(found_tokens(pages)).groupBy("host", "pages").agg(parts.alias("template"))


def page_templates(found: DataFrame) -> DataFrame:
    """Written rows (page, copies, template) of all pages: the template tokens on each of them, by place."""
    met = keyed_join(found.filter("token is not null").select("host", "page", "token"), template_tokens(found), ["host", "token"], "on")
    parts = F.sort_array(F.collect_list(F.struct("place", "token", "class", "size", (F.col("on") < F.least(F.lit(MANY), F.ceil(FREQUENT * F.col("pages")))).alias("few"))))
    lists = met.groupBy("page").agg(parts.alias("template"))
    return durable(found.filter("token is null").select("page", "copies").join(lists, "page", "left"), "page-templates")


class Template:
    """Template tokens that may be on a page."""

    def __init__(self, rows: list[dict] | None) -> None:
        self.kind = {r["token"]: r["class"] for r in rows or ()}
        self.order = {r["token"]: k for k, r in enumerate(rows or ())}
        self.size = {r["class"]: r["size"] for r in rows or ()}
        self.few = {r["class"] for r in rows or () if r["few"]}

    def valid(self, tokens: list[int]) -> set[int]:
        """Tokens of the page's valid classes: all members are on the page, in the template's order, and no two classes cross.

        Of classes that cross, neither within one slot of the other, the larger stays.
        """
        first: dict[int, int] = {}
        for place, token in enumerate(tokens):
            if token in self.kind:
                first.setdefault(token, place)
        by_class: dict[int, list[int]] = {}
        for token in sorted(first, key=self.order.__getitem__):
            by_class.setdefault(self.kind[token], []).append(token)
        whole = {c: own for c, own in by_class.items() if len(own) == self.size[c] and all(first[a] < first[b] for a, b in zip(own, own[1:], strict=False))}
        left = {c: len(own) for c, own in whole.items()}
        opened: list[int] = []
        for token in sorted((t for own in whole.values() for t in own), key=first.__getitem__):
            c = self.kind[token]
            if c not in whole:
                continue
            if left[c] == len(whole[c]):
                opened.append(c)
            while c in whole and opened[-1] != c:  # what was opened later is closed, or crosses this one
                inner = opened[-1]
                if left[inner] == 0 or (self.size[inner], inner) < (self.size[c], c):
                    opened.pop()
                    if left[inner]:
                        del whole[inner]
                else:
                    opened.remove(c)
                    del whole[c]
            left[c] -= 1
        return {t for own in whole.values() for t in own}

    def constant(self, found: dict[str, list]) -> set[str]:
        """Names of the page's tokens (``page_tokens``) that are its template."""
        names = list(found)
        tokens = _hashes(names).view(np.int64).tolist()
        fixed = self.valid(tokens)
        # per class: the first and last place of its members, and is one of them outside the article
        spans: dict[int, list] = {}
        varying = []
        for place, (name, token) in enumerate(zip(names, tokens, strict=True)):
            _, element, _, article = found[name]
            if token in fixed:
                span = spans.setdefault(self.kind[token], [place, place, False])
                span[1], span[2] = place, span[2] or not article
            elif not element:
                varying.append(place)
        copied = {c for c, (i, j, outside) in spans.items() if c in self.few and not (outside and bisect_left(varying, i) < bisect_left(varying, j))}
        return {n for n, t in zip(names, tokens, strict=True) if t in fixed and self.kind[t] not in copied}


def wrappers(page: Page, slots: list[Block], template: bool) -> frozenset[int]:
    """Numbers of the elements that have the name of boilerplate, or are a form, but hold the page's text, for a page without an article outside them.

    They are those around the article with half of the text that varies, or without one those that hold nine tenths of it.  A page without a template
    must have two paragraphs there, as all of its text may be a menu or notice.
    """
    total = sum(len(b.text) for b in slots)
    around, held, paragraphs = Counter(), Counter(), Counter()
    for b in slots:
        if b.around is not None and b.around >= 0:
            around[b.around] += len(b.text)
        if b.mark >= 0:
            held[b.mark] += len(b.text)
            paragraphs[b.mark] += page.tag(b) == "p"
    depth: dict[int, int] = {}
    for mark, outer in page.marked.items():  # from the outside in
        depth[mark] = depth.get(outer, 0) + 1
    for mark in sorted(around, key=lambda m: (depth[m], -around[m])):
        if 2 * around[mark] >= total:
            return frozenset(page.marks(mark))
    for mark in reversed(page.marked):  # from the inside out
        outer = page.marked[mark]
        if outer >= 0 and held[mark]:
            held[outer] += held[mark]
            paragraphs[outer] += paragraphs[mark]
    return frozenset(m for m, n in held.items() if n and 10 * n >= 9 * total and (template or paragraphs[m] > 1))


def lead(tags: list[str], fixed: list[bool]) -> range:
    """Which blocks of an article are its title and first paragraph and speak for themselves, be they part of the template or not.

    A title that other pages have too says that the article, not the page's frame, is shared, so what leads it in is its own; a repeating first
    paragraph under a title that varies is of the frame.  An article without a heading has its first paragraph only.
    """
    title = next((i for i, tag in enumerate(tags) if tag in HEADINGS), None)
    if title is not None and not fixed[title]:
        return range(0)
    first = next((i for i, tag in enumerate(tags) if tag == "p" and i > (-1 if title is None else title)), None)
    if title is None:
        return range(first, first + 1) if first is not None else range(0)
    return range(title, title + 1 if first is None else first + 1)


def holder(page: Page, slots: list[Block]) -> str | None:
    """Key of the deepest kind of element that holds nine tenths of the blocks' text around their own elements, None without one."""
    held: Counter[str] = Counter()
    depth, outer, own = {"": 0}, {}, {}
    for key, parent in zip(page.keys, page.parents, strict=True):
        outer[key] = page.key(parent)
        depth[key] = depth[outer[key]] + 1
    for b in slots:
        if b.element >= 0:
            own[page.keys[b.element]] = own.get(page.keys[b.element], 0) + len(b.text)
    for key in sorted(outer, key=depth.__getitem__, reverse=True):
        if outer[key]:
            held[outer[key]] += held[key] + own.get(key, 0)
    total = sum(len(b.text) for b in slots)
    return max((k for k, n in held.items() if n and 10 * n >= 9 * total), key=depth.__getitem__, default=None)


def main_text(source: str, rows: list[dict] | None) -> str:
    """Blocks of the article that are not part of the template, but for its lead, two line breaks between them; all of them where none is left."""
    page = read_page(source)
    constant = Template(rows).constant(page_tokens(page)) if rows else set()
    varies = [b for _, b in page.blocks if not b.hard and block_key(page, b) not in constant]
    if not any(b.article and not b.boiler for _, b in page.blocks):
        lifted = wrappers(page, varies or [b for _, b in page.blocks if not b.hard], bool(rows and varies))
        page = read_page(source, lifted) if lifted else page
    own = [b for _, b in page.blocks if not b.boiler]
    if any(b.article for b in own):
        own = [b for b in own if b.article]
        fixed = [block_key(page, b) in constant for b in own]
        opening = lead([page.tag(b) for b in own], fixed)
        return "\n\n".join(b.text for b in [b for i, b in enumerate(own) if not fixed[i] or i in opening] or own)
    # no article: in the element with most of the text that varies
    slots = [b for b in own if block_key(page, b) not in constant]
    deepest = holder(page, slots)
    inside = [False] * len(page.tags)
    for i, parent in enumerate(page.parents):
        inside[i] = page.keys[i] == deepest or (parent >= 0 and inside[parent])
    return "\n\n".join(b.text for b in slots if deepest is None or (b.element >= 0 and inside[b.element]))


def _extract(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        texts = [main_text(source, rows) for source, rows in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    White space within a block is one space, blocks are joined by two line breaks, character references are decoded.  A null or empty
    html, or one without an article, has an empty text; a null url belongs to a host of its own name; rows that repeat a page
    count as one and have equal texts; an empty table gives none.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    rows = in_small_batches(pages).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("host", host).withColumn("page", F.xxhash64("host", "html"))
    known = page_templates(found_tokens(keyed.select("host", "page", "html")))
    met = keyed_join(keyed.select("page_id", "url", "html", "page"), known, ["page"], "copies")
    found = met.select("page_id", "url", "html", "template").mapInArrow(_extract, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
