"""Marked-up documents to a table of events in reading order.

A document is walked once by a small tree helper in mapInPandas; all that follows is on the table
events(doc keys, ev, kind, value) with kinds book, chapter, verse, omitted, section, line, paragraph, text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Elements without content, elements that are blocks of text, kinds of notes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li blockquote td th dt dd section article aside header footer figure figcaption pre".split())
NOTES = frozenset("footnote footnotes endnote endnotes rearnote rearnotes noteref note".split())
INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))
LABEL = r"\d{1,3}[a-z]{0,2}(?:\s*[-–]\s*\d{1,3}[a-z]{0,2})?"


@dataclass
class Selectors:
    """What marks what: lists of tag, .class or tag.class; patterns for the numbers in them."""

    book: str = "h1"
    chapter: str = "h2, .capitulo, .chapter"
    verse: str = "sup, .v, .verse"
    section: str = "h3, h4"
    line: str = ".poesia, .line"
    stanza: str = ""
    remove: str = "aside"
    chapter_number: str = r"(?i)(?:cap[ií]tulo|chapter|salmo|psalm)?\s*(\d{1,3})\s*$"
    note_mark: str = r"^[\[(]?(?:\*|†|[a-z]|\d{1,3})[\])]?$"
    short_line: int = 0


@dataclass
class Node:
    tag: str
    classes: frozenset = frozenset()
    types: frozenset = frozenset()
    children: list = field(default_factory=list)
    # Made once the tree is complete, from the leaves up.
    length: int = 0
    blocks: bool = False

    def strings(self) -> Iterator[str]:
        open_ = [iter(self.children)]
        while open_:
            for c in open_[-1]:
                if not isinstance(c, str):
                    open_.append(iter(c.children))
                    break
                yield c
            else:
                open_.pop()

    def text(self) -> str:
        return "".join(self.strings())

    def has_block(self) -> bool:
        return self.blocks

    def signature(self) -> str:
        return ".".join([self.tag, *sorted(self.classes)])


class Tree(HTMLParser):
    """A tree from XHTML or from pages whose elements aren't all closed. <a/> is closed, as in XML."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def _node(self, tag: str, attrs) -> Node:
        a = dict(attrs)
        node = Node(tag, frozenset((a.get("class") or "").split()), frozenset((a.get("epub:type") or "").split()))
        self.open[-1].children.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and self.open[-1].tag == "p":
            self.open.pop()  # a block ends a paragraph that is open
        node = self._node(tag, attrs)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self._node(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def elements(self) -> list[Node]:
        """All nodes in order, with length and blocks made from the leaves up."""
        out, todo = [], [self.root]
        while todo:
            n = todo.pop()
            out.append(n)
            todo += [c for c in reversed(n.children) if not isinstance(c, str)]
        for n in reversed(out):
            n.length = sum(len(c) if isinstance(c, str) else c.length for c in n.children)
            n.blocks = any(not isinstance(c, str) and (c.tag in BLOCKS or c.blocks) for c in n.children)
        return out


def parsed(html: str | None) -> tuple[Node, list[Node]]:
    """The root of a document and all its nodes in order."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root, tree.elements()


def matcher(selectors: str):
    """Whether a node is one of tag, .class or tag.class, separated by commas."""
    wanted = []
    for s in filter(None, map(str.strip, selectors.split(","))):
        if not re.fullmatch(r"[\w-]*(?:\.[\w-]+)*", s):
            raise ValueError(f"selector {s!r}: only tag, .class and tag.class are known")
        tag, *classes = s.split(".")
        wanted.append((tag.lower(), frozenset(classes)))
    return lambda n: any((not t or n.tag == t) and c <= n.classes for t, c in wanted)


def decoded(content: bytes) -> str:
    """By byte order mark, else by the declared encoding, else UTF-8 with replacements."""
    if content.startswith(b"\xef\xbb\xbf"):
        return content[3:].decode("utf-8", "replace")
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    said = re.search(rb"""(?:encoding|charset)=["']?([\w.-]+)""", content[:200])
    try:
        return content.decode(said[1].decode() if said else "utf-8", "replace")
    except LookupError:
        return content.decode("utf-8", "replace")


def tidy(text: str) -> str:
    return re.sub(r"\s+", " ", text.translate(INVISIBLE)).strip()


class Walk:
    """The events of one tree. What a node is is decided by the first rule that holds."""

    def __init__(self, s: Selectors):
        self.s = s
        self.is_ = {k: matcher(getattr(s, k)) for k in ("book", "chapter", "verse", "section", "line", "stanza", "remove")}
        self.number, self.mark = re.compile(s.chapter_number), re.compile(s.note_mark)
        self.after_short = False

    def kept(self, n: Node) -> bool:
        if n.tag in ("script", "style", "head") or self.is_["remove"](n) or n.types & NOTES:
            return False
        if n.tag not in ("sup", "a") or self.is_["verse"](n):
            return True
        said = tidy(n.text())
        return not (said and self.mark.match(said))

    def events(self, n: Node) -> Iterator[tuple[str, str]]:
        for c in n.children:
            if isinstance(c, str):
                if c.translate(INVISIBLE).strip():
                    yield "text", re.sub(r"\s+", " ", c.translate(INVISIBLE))
                elif c:
                    yield "space", " "
            elif self.kept(c):
                yield from self.node(c)

    def node(self, n: Node) -> Iterator[tuple[str, str]]:
        leaf = n.tag in BLOCKS and not n.has_block()
        # Of what is neither a mark nor a block of text the text isn't asked.
        said = tidy(n.text()) if leaf or any(self.is_[k](n) for k in ("book", "chapter", "verse", "section")) else ""
        if self.is_["book"](n):
            if said:
                yield "book", said
            return
        if self.is_["chapter"](n) and (found := self.number.search(said)):
            yield "chapter", next(g for g in found.groups() if g)
            return
        if self.is_["verse"](n):
            if found := re.fullmatch(rf"\[\s*({LABEL})\s*\]\s*({LABEL})?", said):
                yield "omitted", re.sub(r"\s+", "", found[1]).replace("–", "-")
                if found[2]:
                    yield "verse", re.sub(r"\s+", "", found[2]).replace("–", "-")
                return
            if re.fullmatch(LABEL, said):
                yield "verse", re.sub(r"\s+", "", said).replace("–", "-")
                return
            if n.tag == "sup":
                return
        if self.is_["section"](n):
            if said:
                yield "section", said
            return
        if leaf and re.fullmatch(r"[IVXLC]+\.?", said):
            yield "section", said
            return
        if n.tag == "br":
            yield "line", ""
            return
        if self.is_["stanza"](n):
            yield "paragraph", ""
        if self.is_["line"](n):
            yield "line", ""
        elif n.tag in BLOCKS:
            short = bool(self.s.short_line) and leaf and 0 < len(said) <= self.s.short_line
            yield ("line" if short and self.after_short else "paragraph"), ""
            self.after_short = short
        yield from self.events(n)
        if n.tag in BLOCKS and not self.is_["line"](n):
            yield "end", ""


def events_of(html: str | None, s: Selectors) -> list[tuple[str, str]]:
    return list(Walk(s).events(parsed(html)[0]))


#: Rows that go out at once.
ROWS = 50_000


def _frames(made, columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of lists, one for each document, as frames of about ROWS rows."""
    out: list[tuple] = []
    for rows in made:
        out += rows
        if len(out) >= ROWS:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out, columns=columns)


def _content(html) -> str | None:
    return decoded(bytes(html)) if isinstance(html, (bytes, bytearray)) else html


def events(docs: DataFrame, keys: list[str], html: str, selectors: Selectors = Selectors()) -> DataFrame:
    """(keys, ev, kind, value): the events of each document. Documents without any text give none."""
    schema = ", ".join([*[f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys], "ev int, kind string, value string"])

    def run(frames):
        for frame in frames:
            rows = zip(*[frame[k] for k in keys], frame[html])
            yield from _frames(([(*row[:-1], i, k, v) for i, (k, v) in enumerate(events_of(_content(row[-1]), selectors)) if k != "end"] for row in rows), [*keys, "ev", "kind", "value"])

    return docs.select(*keys, html).mapInPandas(run, schema)


#: What a configuration of a trial sets: its name and selectors of this kind; the others are those of a base.
CONFIGS = "array<struct<config:string,chapter:string,verse:string,stanza:string,short_line:int>>"


def events_of_configs(docs: DataFrame, keys: list[str], html: str, configs: str = "configs", base: Selectors = Selectors()) -> DataFrame:
    """(keys, config, ev, kind, value): the events of each document by each of its configurations (a column of CONFIGS), from one parse."""
    schema = ", ".join([*[f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys], "config string, ev int, kind string, value string"])

    def run(frames):
        known: dict[tuple, Selectors] = {}

        def of(row):
            root, out = parsed(_content(row[-2]))[0], []
            for c in row[-1] if row[-1] is not None else []:
                own = (c["chapter"], c["verse"], c["stanza"], int(c["short_line"] or 0))
                if own not in known:
                    known[own] = replace(base, **dict(zip(("chapter", "verse", "stanza", "short_line"), own)))
                out += [(*row[:-2], c["config"], i, k, v) for i, (k, v) in enumerate(Walk(known[own]).events(root)) if k != "end"]
            return out

        for frame in frames:
            yield from _frames((of(row) for row in zip(*[frame[k] for k in keys], frame[html], frame[configs])), [*keys, "config", "ev", "kind", "value"])

    return docs.select(*keys, html, configs).mapInPandas(run, schema)


# Leaf blocks that are looked at, headings, and how a chapter mark with a word or an abbreviation before its number looks.
LEAVES = frozenset("p div li blockquote dd td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PREFIXED = re.compile(r"^\s*(?:(?:cap[ií]tulo|salmos?)\s+|(?:[1-3]\s*)?[^\W\d_]{1,4}\.?\s+)(\d{1,3})\s*$", re.IGNORECASE)
MARK_CHARS = 40
PROFILE = "kind string, signature string, pos int, value int, starts boolean, ends boolean, classes array<string>, sample string"


def profile_of(html: str | None, s: Selectors) -> list[tuple]:
    """Rows of PROFILE: number and heading marks of all elements, leaf blocks of the cleaned document, and its size in elements."""
    root, nodes = parsed(html)
    walk, out = Walk(s), []
    for pos, n in enumerate(nodes[1:]):
        # Text that is long without its white space is no mark.
        said = tidy(n.text()) if n.length < 10 * MARK_CHARS else None
        if said and re.fullmatch(r"\d{1,3}", said):
            out.append(("number", n.signature(), pos, int(said), None, None, None, said))
        elif said is not None and len(said) < MARK_CHARS:
            found = PREFIXED.match(said)
            number = found[1] if found else None
            if number is None and (n.tag in HEADINGS or n.tag in ("p", "div")) and (found := walk.number.search(said)):
                number = next(g for g in found.groups() if g)
            if number is not None:
                out.append(("heading", n.signature(), pos, int(number), None, None, None, said))
    todo, clean = [root], []
    while todo:
        n = todo.pop()
        clean.append(n)
        todo += [c for c in reversed(n.children) if not isinstance(c, str) and walk.kept(c)]
    for pos, n in enumerate(clean[1:]):
        if n.tag in LEAVES and not n.has_block() and (said := tidy(n.text())):
            first = next((x for x in map(tidy, n.strings()) if x), "")
            starts, ends = re.fullmatch(r"\d{1,3}[a-z]?", first) is not None, re.search(r"[.!?…][\"'»”’)\]]*$", said) is not None
            out.append(("block", n.signature(), pos, len(said), starts, ends, sorted(n.classes), said[:MARK_CHARS]))
    out.append(("size", "", 0, len(nodes), None, None, None, ""))
    return out


def profile(docs: DataFrame, keys: list[str], html: str, selectors: Selectors = Selectors()) -> DataFrame:
    """(keys, PROFILE): what each document has of marks and blocks. A null document has its size alone."""
    schema = ", ".join([*[f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys], PROFILE])

    def run(frames):
        columns = [*keys, "kind", "signature", "pos", "value", "starts", "ends", "classes", "sample"]
        for frame in frames:
            rows = zip(*[frame[k] for k in keys], frame[html])
            for made in _frames(([(*row[:-1], *own) for own in profile_of(_content(row[-1]), selectors)] for row in rows), columns):
                yield made.astype({"starts": "boolean", "ends": "boolean"})

    return docs.select(*keys, html).mapInPandas(run, schema)
