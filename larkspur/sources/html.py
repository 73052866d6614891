"""Pages to title, sections, links and metadata, in Arrow batches with the standard library's parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = (
    "title string, sections array<struct<heading:string,text:string>>, body string, out_links array<string>, "
    "language string, author string, published_at string, updated_at string"
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_UNSEEN = frozenset(["script", "style", "noscript", "template"])


class _Reader(HTMLParser):
    """Collects text by container (article, main, body) in one pass; the best container present wins afterwards."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.meta: dict[str, str] = {}
        self.lang = self.title = self.h1 = ""
        self.blocks: dict[str, list[tuple[str, str]]] = {"article": [], "main": [], "body": []}
        self.links: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self.met = {"article": False, "main": False, "body": True}
        self.open: str | None = None
        self.text: list[str] = []
        self.unseen = 0

    def _inside(self) -> list[str]:
        return ["body", *[c for c in ("article", "main") if c in self.stack]]

    def _flush(self) -> None:
        if self.open:
            words = re.sub(r"\s+", " ", "".join(self.text)).strip()
            if words:
                if self.open == "title":
                    self.title = self.title or words
                else:
                    if self.open == "h1":
                        self.h1 = self.h1 or words
                    for c in self._inside():
                        self.blocks[c].append((self.open, words))
        self.open, self.text = None, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.lang = a.get("lang", "")
        elif tag == "meta":
            key = (a.get("property") or a.get("name") or "").lower()
            if key and key not in self.meta:
                self.meta[key] = a.get("content", "").strip()
        elif tag == "a" and a.get("href"):
            for c in self._inside():
                self.links[c].append(a["href"])
        if tag in _VOID:
            if tag == "br" and self.open:
                self.text.append(" ")
            return
        if tag in _UNSEEN:
            self.unseen += 1
        if tag in ("h1", "h2", "h3", "p", "li", "title"):
            self._flush()
            self.open = tag
        if tag in ("article", "main"):
            self._flush()
            self.met[tag] = True
        self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        if tag in _UNSEEN:
            self.unseen -= 1
        if tag == self.open or tag in ("article", "main", "body"):
            self._flush()
        while self.stack and self.stack.pop() != tag:
            pass

    def handle_data(self, data: str) -> None:
        if self.open and not self.unseen:
            self.text.append(data)


def extract(html: str | None) -> dict:
    """Title (og:title, title, first h1), sections opened by h1-h3 and filled by p and li, links and metadata of the
    article, else the main part, else the body."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    r._flush()
    where = next(c for c in ("article", "main", "body") if r.met[c])
    sections: list[dict] = []
    heading, parts = "main", []
    for kind, words in [*r.blocks[where], ("h1", "")]:
        if kind in ("h1", "h2", "h3"):
            if parts:
                sections.append({"heading": heading, "text": " ".join(parts)})
            heading, parts = words, []
        else:
            parts.append(words)
    body = "\n".join(s["text"] if s["heading"] == "main" else f"{s['heading']}\n{s['text']}" for s in sections)
    m = r.meta.get
    return {
        "title": m("og:title") or r.title or r.h1 or None, "sections": sections, "body": body, "out_links": r.links[where],
        "language": (r.lang.split("-")[0].lower() or None), "author": m("author") or None,
        "published_at": m("article:published_time") or None, "updated_at": m("article:modified_time") or None,
    }


def extract_pages(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and what :func:`extract` finds in each page."""
    keep = keep if keep is not None else [c for c in pages.columns if c != html]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([extract(x) for x in b[html]], columns=[f.split(" ")[0] for f in ("title", "sections", "body", "out_links", "language", "author", "published_at", "updated_at")])
            yield pd.concat([b[keep].reset_index(drop=True), found], axis=1)

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, html).mapInPandas(run, f"{kinds}, {SCHEMA}" if kinds else SCHEMA)
