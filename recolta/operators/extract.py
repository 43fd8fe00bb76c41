"""Field extraction from HTML by selector lists, in Arrow-batched Python workers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PART = re.compile(r"(?P<tag>^[a-zA-Z][\w-]*|^\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$]?=)[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]")


class Node:
    """An element with its attributes, children and text."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.parts: list[str | Node] = []

    def text(self) -> str:
        out, stack = [], [iter(self.parts)]
        while stack:
            part = next(stack[-1], None)
            if part is None:
                stack.pop()
            elif isinstance(part, str):
                out.append(part)
            else:
                stack.append(iter(part.parts))
        return " ".join(" ".join(out).split())


class Page(HTMLParser):
    """A page's tree and its elements in document order."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.nodes: list[Node] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node), self.at.parts.append(node), self.nodes.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node), self.at.parts.append(node), self.nodes.append(node)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def _compiled(selector: str) -> list[list[list[dict]]]:
    steps = lambda one: [[m.groupdict() for m in _PART.finditer(p)] for p in one.split()]
    return [steps(s.strip()) for s in selector.split(",") if s.strip()]


def _fits(node: Node, step: list[dict]) -> bool:
    for c in step:
        if c["tag"] and c["tag"] != "*" and c["tag"].lower() != node.tag:
            return False
        if c["id"] and node.attrs.get("id") != c["id"] or c["cls"] and c["cls"] not in node.attrs.get("class", "").split():
            return False
        if c["attr"]:
            v = node.attrs.get(c["attr"])
            want = c["val"] or ""
            test = {"=": lambda: v == want, "*=": lambda: want in v, "^=": lambda: v.startswith(want), "$=": lambda: v.endswith(want)}
            if v is None or c["op"] and not test[c["op"]]():
                return False
    return bool(step)


def select(page: Page, selector: str) -> list[Node]:
    """Elements that fit a selector list: tag, #id, .class, [attr], =, *=, ^=, $= and descendants."""
    options = _compiled(selector)

    def ok(node: Node, steps: list[list[dict]]) -> bool:
        if not _fits(node, steps[-1]):
            return False
        rest, up = steps[:-1], node.parent
        while rest and up is not None:
            if _fits(up, rest[-1]):
                rest = rest[:-1]
            up = up.parent
        return not rest

    return [n for n in page.nodes if any(ok(n, s) for s in options)]


def absolute(value: str, base: str) -> str:
    """An absolute http address, '' for other schemes."""
    if value.startswith(("http://", "https://")):
        return value
    if value.startswith("//"):
        return "https:" + value
    return base.rstrip("/") + value if value.startswith("/") else ""


def extract_page(html: str | None, config: dict, base: str = "", most_media: int = 8) -> dict:
    """text, author, handle, canonical_url, media and the flags of what is missing."""
    page = Page(html or "")
    fallback = config.get("fallback_selectors", {})

    def first(selectors: list[str], read) -> str:
        return next((v for s in selectors for n in select(page, s) if (v := read(n))), "")

    def url_of(n: Node) -> str:
        return next((u for k in ("href", "content", "src", "data-src", "poster") if (u := absolute(n.attrs.get(k, ""), base))), "")

    read_text = lambda n: n.text() or n.attrs.get("content", "").strip()
    get = lambda name, fb, read: first(config.get(name, []), read) or first(fallback.get(fb, []), read)
    out = {
        "text_content": get("text_selectors", "text", read_text), "author_name": get("author_selectors", "author_name", read_text),
        "author_handle": get("author_handle_selectors", "author_handle", read_text), "canonical_url": get("canonical_url_selectors", "canonical_url", url_of),
    }
    media: list[str] = []
    for selectors in (config.get("media_selectors", []), fallback.get("media", [])):
        if not media:
            media = list(dict.fromkeys(u for s in selectors for n in select(page, s) if (u := url_of(n))))[:most_media]
    missing = [("text_content", "missing_text"), ("author_name", "missing_author"), ("canonical_url", "missing_canonical_url")]
    return out | {"media_urls": media, "quality_flags": [f for k, f in missing if not out[k]] + ["missing_media"] * (not media)}


def extract(df: DataFrame, key: str, html: str, config: dict, base: str = "") -> DataFrame:
    """The extracted fields of every page; null pages lack all."""
    kind = dict(df.dtypes)[key]
    schema = f"{key} {kind}, text_content string, author_name string, author_handle string, canonical_url string, media_urls array<string>, quality_flags array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = pd.DataFrame([extract_page(h if isinstance(h, str) else None, config, base) for h in b["_h"]], columns=["text_content", "author_name", "author_handle", "canonical_url", "media_urls", "quality_flags"])
            rows.insert(0, key, b[key].to_numpy())
            yield rows

    return df.select(key, F.col(html).alias("_h")).mapInPandas(run, schema)


def compare_with_expected(found: DataFrame, expected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, mismatches, passed) of extracted against expected fields."""
    e = expected.select(key, *[F.col(f).alias(f"_e_{f}") for f in fields])
    wrong = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_e_{f}")), F.lit(f)) for f in fields]))
    return found.join(e, key).select(key, wrong.alias("mismatches")).withColumn("passed", F.size("mismatches") == 0)
