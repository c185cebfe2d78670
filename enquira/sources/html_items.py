"""Items from pages by selectors: a small tree of a page's elements, and tables of items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
_STEP = re.compile(r"^([\w-]+|\*)?((?:#[\w-]+|\.[\w-]+|\[[\w-]+(?:=[^\]]*)?\])*)$")
_PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:=([^\]]*))?\]")
_SUFFIX = re.compile(r"^(.*?)::(text|html|all|attr\(([^)]+)\))$")


class Element:
    def __init__(self, tag: str, attrs: dict, opening: str, parent: Element | None):
        self.tag, self.attrs, self.opening, self.parent = tag, attrs, opening, parent
        self.children: list[Element | str] = []

    def below(self) -> Iterator[Element]:
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.below()

    def text(self) -> str | None:
        def pieces(e):
            for c in e.children:
                if isinstance(c, Element):
                    if c.tag not in ("script", "style"):
                        yield from pieces(c)
                else:
                    yield c

        return re.sub(r"\s+", " ", " ".join(p.strip() for p in pieces(self) if p.strip())).strip() or None

    def html(self) -> str:
        inside = "".join(c.html() if isinstance(c, Element) else c for c in self.children)
        return self.opening + ("" if self.tag in VOID else f"{inside}</{self.tag}>")


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, "", None)

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.get_starttag_text() or "", self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        e = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:  # an end without a start is passed over
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Element:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _steps(selector: str) -> list[tuple[bool, str, list]]:
    """(directly below, tag, conditions) of a selector's steps."""
    out, direct = [], False
    for word in selector.replace(">", " > ").split():
        if word == ">":
            direct = True
            continue
        m = _STEP.match(word)
        if not m:
            raise ValueError(f"selector not supported: {selector}")
        conditions = []
        for by_id, by_class, attr, value in _PART.findall(m.group(2)):
            if by_id:
                conditions.append(("id", by_id))
            elif by_class:
                conditions.append(("class", by_class))
            else:
                conditions.append((f"[{attr}", value.strip("\"'")))
        out.append((direct, m.group(1) or "*", conditions))
        direct = False
    return out


def _fits(e: Element, tag: str, conditions: list) -> bool:
    if tag not in ("*", e.tag):
        return False
    for kind, value in conditions:
        if kind == "id" and e.attrs.get("id") != value:
            return False
        if kind == "class" and value not in e.attrs.get("class", "").split():
            return False
        if kind[0] == "[" and (kind[1:] not in e.attrs or value and e.attrs[kind[1:]] != value):
            return False
    return True


def select(root: Element, selector: str) -> list[Element]:
    """Elements below ``root`` in the order of the page: tag, .class, #id, [attr], [attr=v],
    descendants, > children and alternatives between commas."""
    chains = [_steps(s) for s in selector.split(",") if s.strip()]

    def matches(e: Element, chain: list) -> bool:
        direct, tag, conditions = chain[-1]
        if not _fits(e, tag, conditions):
            return False
        up = e.parent
        while len(chain) > 1 and up is not None:
            if matches(up, chain[:-1]):
                return True
            if direct:
                return False
            up = up.parent
        return len(chain) == 1

    return [e for e in root.below() if any(matches(e, c) for c in chains)]


def _value(block: Element, selector: str):
    m = _SUFFIX.match(selector)
    found = select(block, m.group(1) if m else selector)
    if not found:
        return None
    e = found[0]
    kind = m.group(2) if m else ""
    if kind.startswith("attr"):
        return e.attrs.get(m.group(3), "").strip() or None
    if kind == "html":
        return e.html()
    if kind == "text":
        return e.text()
    if e.tag in ("a", "link") and "href" in e.attrs:
        return e.attrs["href"].strip() or None
    return e.attrs.get("src", "").strip() or None if e.tag == "img" else e.text()


def field_value(block: Element, selector: str):
    """The first alternative with a value; with ``::all`` the list of all texts."""
    if selector.strip().endswith("::all"):
        return [e.text() for e in select(block, selector.strip()[: -len("::all")])]
    return next((v for s in selector.split(",") if (v := _value(block, s.strip()))), None)


def page_items(pages: DataFrame, container: str, fields: dict[str, str]) -> DataFrame:
    """(page_id, pos, the fields, error): one row per container of every page.

    Links are resolved against the page; a container with neither title nor url is an item in
    error ("blank item"), a page that cannot be parsed gives one row with its error.  Fields with ``::all``
    are arrays.
    """
    names = list(fields)
    kinds = {n: "array<string>" if s.strip().endswith("::all") else "string" for n, s in fields.items()}

    def run(batches):
        for pdf in batches:
            rows = []
            for page, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                try:
                    for pos, block in enumerate(select(parse(html or ""), container)):
                        item = {n: field_value(block, s) for n, s in fields.items()}
                        if item.get("url"):
                            item["url"] = urljoin(url or "", item["url"])
                        blank = not item.get("title") and not item.get("url")
                        rows.append((page, pos, *(item[n] for n in names), "blank item" if blank else None))
                except Exception as e:  # a page that breaks the parser is reported, not fatal
                    rows.append((page, None, *(None for _ in names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["page_id", "pos", *names, "error"]).astype({"pos": "Int32"})

    schema = "page_id long, pos int, " + ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", error string"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, schema)


def item_errors(items: DataFrame) -> DataFrame:
    return items.where("error is not null").groupBy("page_id", "error").agg(F.count("*").alias("n"))
