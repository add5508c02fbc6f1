"""Entries of feeds and sitemaps by an event-driven XML parser, with namespaces and index files."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# fixed values: namespaces whose elements count, and the prefix they are known by here
NAMESPACES = {
    "": "", "http://www.w3.org/2005/Atom": "", "http://purl.org/rss/1.0/": "", "http://www.sitemaps.org/schemas/sitemap/0.9": "",
    "http://www.google.com/schemas/sitemap-news/0.9": "news:", "http://purl.org/dc/elements/1.1/": "dc:",
}
#: Elements that hold one entry, by kind of document.
BLOCKS = {"feed": frozenset(("item", "entry")), "sitemap": frozenset(("url",)), "index": frozenset(("sitemap",))}
# fixed values: where title, address and date stand, the first that is there counts
FIELDS = {
    "feed": (("title",), ("link",), ("pubdate", "published", "updated", "dc:date")),
    "sitemap": (("news:title",), ("loc",), ("news:publication_date", "lastmod")),
    "index": ((), ("loc",), ("lastmod",)),
}


class _Entries:
    """Collects entries from parser events; holds one entry at a time."""

    def __init__(self, kind: str, namespaces: bool):
        self.blocks, self.fields, self.namespaces = BLOCKS[kind], FIELDS[kind], namespaces
        self.rows: list[tuple[str | None, str | None, str | None]] = []
        self.found: dict[str, str] | None = None
        self.path: list[str] = []
        self.text: list[str] = []

    def name(self, raw: str) -> str:
        if not self.namespaces:
            return raw.lower()
        space, _, local = raw.rpartition(" ")
        return (NAMESPACES.get(space, "other:") + local).lower()

    def start(self, raw: str, attributes: dict[str, str]) -> None:
        name = self.name(raw)
        self.path.append(name)
        self.text = []
        if self.found is None:
            if name in self.blocks:
                self.found = {}
        elif name == "link" and attributes.get("href") and attributes.get("rel", "alternate") == "alternate":
            self.found.setdefault("link", attributes["href"].strip())

    def data(self, text: str) -> None:
        if self.found is not None:
            self.text.append(text)

    def end(self, raw: str) -> None:
        name = self.path.pop()
        if self.found is None:
            return
        if name in self.blocks:
            self.rows.append(tuple(next((self.found[f] for f in names if f in self.found), None) for names in self.fields))
            self.found = None
        elif "".join(self.text).strip():
            self.found.setdefault(name, "".join(self.text).strip())
        self.text = []


def _refuse(*_) -> None:
    raise ValueError("entity declarations are not read")


def xml_entries(document: str | None, kind: str) -> list[tuple[str | None, str | None, str | None]]:
    """(title, url, published) of every entry of a document, in order; of a broken document, the entries before the break.

    Prefixes that a document does not declare are taken as they are written. Documents that declare entities give nothing.
    """
    for namespaces in (True, False):
        entries = _Entries(kind, namespaces)
        parser = expat.ParserCreate("utf-8", " ") if namespaces else expat.ParserCreate("utf-8")
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = entries.start, entries.end, entries.data
        parser.EntityDeclHandler = _refuse
        parser.buffer_text = True
        try:
            parser.Parse((document or "").strip().encode("utf-8", "replace"), True)
        except ValueError:
            return []
        except expat.ExpatError as e:
            if namespaces and e.code == expat.errors.codes[expat.errors.XML_ERROR_UNBOUND_PREFIX]:
                continue
        return entries.rows
    return []


def feed_rows(docs: DataFrame, kind: str, key: str = "page_id", text: str = "html") -> DataFrame:
    """(key, position, title, url, published) of the entries of feeds ("feed"), sitemaps ("sitemap") or lists of sitemaps ("index", whose urls are read next)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [xml_entries(x, kind) for x in part.column(1).to_pylist()]
                rows = pa.array([i for i, e in enumerate(found) for _ in e], pa.int64())
                flat = [x for e in found for x in e]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), pa.array([n for e in found for n in range(len(e))], pa.int64()), *(pa.array([x[c] for x in flat], pa.string()) for c in range(3))],
                    [key, "position", "title", "url", "published"])

    return docs.select(key, F.col(text)).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, position long, title string, url string, published string")
