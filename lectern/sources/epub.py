"""EPUB archives from rows of their entries: metadata, cover, protection and chapters.

Entries come from ``archives.zip_entries`` or ``archives.entries``. The few entries that
describe a book are brought together by archive; its pages are met by name and walked one
by one, wherever they are, so that a large archive is the work of several tasks. An archive
that cannot be read, or one of whose pages cannot, is a book with an error and no chapters.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.chapters import spine_chapters
from lectern.operators.timing import title_or
from lectern.sources.archives import failed
from lectern.sources.batches import batched, rows_of
from lectern.sources.markup import BLOCK, BLOCK_ARROW, HEADINGS, body_text, told, walked
from lectern.storage import written

#: Algorithms that only hide fonts, and the places of what describes an archive.
FONT_ONLY = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#rc")
CONTAINER, ENCRYPTION = "META-INF/container.xml", "META-INF/encryption.xml"
PAGES = ("application/xhtml+xml", "text/html")

_PAGE = "array<struct<pos:int,item_id:string,href:string,place:string>>"
_PACKAGE = f"path string, title string, author string, language string, protected boolean, error string, cover_place string, cover_name string, pages {_PAGE}"
_ITEM = f"path string, pos int, item_id string, href string, error string, pieces array<string>, prose array<string>, blocks array<{BLOCK}>"
_PAGE_ARROW = pa.struct([("pos", pa.int32()), ("item_id", pa.string()), ("href", pa.string()), ("place", pa.string())])
_PACKAGE_ARROW = pa.schema([*[(k, pa.string()) for k in ("path", "title", "author", "language")], ("protected", pa.bool_()), *[(k, pa.string()) for k in ("error", "cover_place", "cover_name")], ("pages", pa.list_(_PAGE_ARROW))])
_ITEM_ARROW = pa.schema([("path", pa.string()), ("pos", pa.int32()), *[(k, pa.string()) for k in ("item_id", "href", "error")], ("pieces", pa.list_(pa.string())), ("prose", pa.list_(pa.string())), ("blocks", pa.list_(BLOCK_ARROW))])


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def package(files: dict[str, bytes]) -> dict:
    """What the descriptions of an archive (by name) say; an error where they cannot be read."""
    empty = {"title": None, "author": None, "language": None, "protected": False, "error": None, "cover_place": None, "cover_name": None, "pages": []}
    try:
        root = next(e.get("full-path") for e in ElementTree.fromstring(files[CONTAINER]).iter() if _local(e) == "rootfile")
        book = ElementTree.fromstring(files[root])
        place = lambda href: posixpath.normpath(posixpath.join(posixpath.dirname(root), href))
        said = {k: next((e.text for e in book.iter() if _local(e) == k and e.text), None) for k in ("title", "creator", "language")}
        manifest = {e.get("id"): (unquote(e.get("href")), e.get("media-type") or "", e.get("properties") or "") for e in book.iter() if _local(e) == "item"}
        listed = [(e.get("idref"), *manifest[e.get("idref")]) for e in book.iter() if _local(e) == "itemref" and e.get("idref") in manifest]
        pages = [{"pos": k, "item_id": i, "href": href, "place": place(href)} for k, (i, href, kind, _) in enumerate(listed) if kind in PAGES]
        images = [(href, properties) for href, kind, properties in manifest.values() if kind.startswith("image/")]
        cover = next((href for href, properties in images if "cover-image" in properties), None) or next((href for href, _ in images if "cover" in href.lower()), None)
        hidden = files[ENCRYPTION].decode("utf-8", "replace").lower() if ENCRYPTION in files else None
        of_cover = {"cover_place": place(cover), "cover_name": f"cover{posixpath.splitext(cover)[1] or '.jpg'}"} if cover is not None else {}
        return empty | {"title": said["title"], "author": said["creator"], "language": said["language"], "protected": hidden is not None and not any(u in hidden for u in FONT_ONLY), "pages": pages} | of_cover
    except Exception as error:  # noqa: BLE001 (whatever a damaged description leads to)
        return empty | {"error": failed(error)}


def _packages(entries: DataFrame) -> DataFrame:
    """A row per archive."""
    telling = F.col("entry").isin(CONTAINER, ENCRYPTION) | F.col("entry").endswith(".opf") | F.col("entry").isNull()
    files = F.collect_list(F.when(telling, F.struct("entry", "content", "error")))
    by_path = entries.groupBy("path").agg(files.alias("files"))

    def told(r: dict) -> tuple[dict, int]:
        wrong = next((f["error"] for f in r["files"] if f["error"]), None)
        given = {f["entry"]: f["content"] for f in r["files"] if f["content"] is not None}
        said = package({}) | {"error": wrong} if wrong else package(given)
        return {"path": r["path"], **said}, sum(map(len, given.values()))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(map(told, rows_of(batches)), _PACKAGE_ARROW)

    return by_path.mapInArrow(describe, _PACKAGE)


def _items(packages: DataFrame, entries: DataFrame) -> DataFrame:
    """A row per page of the books that are not protected: what its walk finds, or an error."""
    pages = packages.filter("NOT protected").select("path", F.inline("pages"))
    held = entries.filter("entry IS NOT NULL").select("path", F.col("entry").alias("place"), "content", F.col("error").alias("wrong"), F.lit(True).alias("there"))

    def found(r: dict) -> tuple[dict, int]:
        error = (r["wrong"] or "no content") if r["content"] is None else None
        walk = walked(None if error else r["content"].decode("utf-8-sig", "replace"))
        return {k: r[k] for k in ("path", "pos", "item_id", "href")} | {"error": error or walk["error"]} | {k: walk[k] for k in ("pieces", "prose", "blocks")}, len(r["content"] or b"")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(map(found, rows_of(batches)), _ITEM_ARROW)

    met = pages.join(held, ["path", "place"], "left")
    wrong = F.when(F.col("there").isNull(), F.concat(F.lit("KeyError: no entry "), "place")).otherwise(F.col("wrong"))
    return met.select("path", "pos", "item_id", "href", "content", wrong.alias("wrong")).mapInArrow(walk, _ITEM)


@dataclass
class Archives:
    """The books of archives, their pages walked once, as tables."""

    entries: DataFrame
    packages: DataFrame
    items: DataFrame

    def errors(self) -> DataFrame:
        """path, error: the first thing that is wrong with each archive that cannot be read."""
        wrong = self.items.filter("error IS NOT NULL").groupBy("path").agg(F.min_by("error", "pos").alias("error"))
        return self.packages.filter("error IS NOT NULL").select("path", "error").unionByName(wrong)

    def books(self, stem: str = "book") -> DataFrame:
        told = self.packages.drop("error").join(self.errors(), "path", "left")
        return told.select(F.col("path").alias("book"), title_or(F.col("title"), F.lit(stem)).alias("title"), title_or(F.col("author"), F.lit("Unknown")).alias("author"), "language", "protected", "error", "cover_name")

    def covers(self) -> DataFrame:
        """book, cover_name, cover of the books that have one."""
        images = self.entries.select("path", F.col("entry").alias("cover_place"), F.col("content").alias("cover"))
        return self.packages.join(images, ["path", "cover_place"]).select(F.col("path").alias("book"), "cover_name", "cover")

    def chapters(self) -> DataFrame:
        items = self.items.join(self.errors().select("path"), "path", "left_anti").withColumnRenamed("path", "book")
        heading = F.get(F.filter("blocks", lambda b: b["tag"].isin(*HEADINGS)), F.lit(0))
        # Titles are what stands in an element without its white space at tags; body text has blanks there.
        early = F.transform(F.filter("blocks", lambda b: b["tag"] == "p"), lambda b: told(F.col("prose"), b, ""))
        return spine_chapters(items.select("book", "pos", "item_id", "href", told(F.col("prose"), heading, "").alias("heading"), early.alias("paragraphs"), body_text(F.col("prose"), F.col("blocks")).alias("text")))


def opened(entries: DataFrame) -> Archives:
    """Reads the descriptions and walks the pages of all archives, each once."""
    packages = written(_packages(entries))
    return Archives(entries, packages, written(_items(packages, entries)))
