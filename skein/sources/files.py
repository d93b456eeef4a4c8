"""Books from files: EPUB, plain text and Markdown become chapters; EPUB metadata becomes a row.

Files are read by Spark's binaryFile source, so any path works that Spark can open, and a broken file is a row with an error
and not the end of the job.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from urllib.parse import unquote
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators import chapters as C

#: Characters of a page that is no chapter for being short.
SHORT_PAGE = 200


class Epub:
    """The package of an EPUB: its manifest, reading order and metadata."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        root = ElementTree.fromstring(self.zip.read("META-INF/container.xml"))
        self.at = next(e.get("full-path") for e in root.iter() if self.name(e) == "rootfile")
        self.package = ElementTree.fromstring(self.zip.read(self.at))
        self.items = {e.get("id"): e for e in self.package.iter() if self.name(e) == "item"}
        self.order = [self.items[e.get("idref")] for e in self.package.iter() if self.name(e) == "itemref" and e.get("idref") in self.items]

    @staticmethod
    def name(e) -> str:
        return e.tag.rsplit("}", 1)[-1]

    def path(self, item) -> str:
        return posixpath.normpath(posixpath.join(posixpath.dirname(self.at), unquote(item.get("href") or "")))

    def text(self, item) -> str:
        return self.zip.read(self.path(item)).decode("utf-8", "replace")

    def css(self) -> str:
        return "\n".join(self.text(i) for i in self.items.values() if i.get("media-type") == "text/css")

    def told(self, tag: str) -> str | None:
        return next((e.text.strip() for e in self.package.iter() if self.name(e) == tag and e.text and e.text.strip()), None)

    def meta(self, name: str) -> str | None:
        return next((e.get("content") for e in self.package.iter() if self.name(e) == "meta" and e.get("name") == name), None)

    def cover(self) -> str | None:
        """By the item that the metadata name, the one marked as cover, or an image that is called so."""
        images = [i for i in self.items.values() if (i.get("media-type") or "").startswith("image/")]
        named = self.items.get(self.meta("cover") or "")
        marked = next((i for i in images if "cover-image" in (i.get("properties") or "").split()), None)
        called = next((i for i in images if "cover" in f"{i.get('id')} {i.get('href')}".lower()), None)
        found = next((i for i in (named, marked, called) if i is not None), None)
        return None if found is None else self.path(found)


def _heading(html: str) -> str:
    return next((t for _, k, t, *_ in C.html_paragraphs(html) if k == "header"), "")


def _is_boilerplate(name: str, heading: str, text: str) -> bool:
    lines = text.strip().split("\n")
    listed = text.count("\n") > 5 and len(lines) > 10 and sum(len(ln.strip()) < 80 for ln in lines) > 0.8 * len(lines)
    return bool(re.search(C.SKIPPED_FILES, name) or heading and re.match(C.SKIPPED_HEADS, heading)) or listed


def epub_chapters(data: bytes) -> list[tuple[int, str, str, str]]:
    """(number, title, text, html) of the pages in reading order that are chapters."""
    book, out = Epub(data), []
    for item in book.order:
        if "nav" in (item.get("properties") or "").split():
            continue
        html = book.text(item)
        text = "\n".join(t for _, _, t, *_ in C.html_paragraphs(html))
        heading = _heading(html)
        if len(text) < SHORT_PAGE or _is_boilerplate(book.path(item), heading, text):
            continue
        told = [C.number_of(m[1]) for h in C.HEADINGS if (m := h.match(heading))]
        out.append((next((n for n in told if n > 0), len(out) + 1), heading, text, html))
    return out


def chapters_of(path: str, data: bytes) -> list[tuple[int, str, str, str]]:
    suffix = posixpath.splitext(path)[1].lower()
    if suffix == ".epub":
        return epub_chapters(data)
    if suffix in (".txt", ".md"):
        return [(n, t, x, "") for n, t, x, _ in C.chapters(data.decode("utf-8", "replace"))]
    raise ValueError(f"no reader for {suffix or 'files without suffix'}; .epub, .txt and .md are read")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """path, place, number, title, text, html, words, error: a row a chapter, or one with the error of a file.

    Where chapters of a file share a number, all of it are numbered in order.
    """

    def run(batches):
        import pyarrow as pa

        names = ["path", "place", "number", "title", "text", "html", "words", "error"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [(name, k, n, t, x, h, len(x.split()), None) for k, (n, t, x, h) in enumerate(chapters_of(name, data))]
                except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows = [(name, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                cols = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    rows = _files(spark, path).mapInArrow(run, "path string, place int, number int, title string, text string, html string, words int, error string")
    own = W.partitionBy("path")
    return rows.withColumn("number", F.when(F.size(F.collect_set("number").over(own)) < F.count("number").over(own), F.col("place") + 1).otherwise(F.col("number")))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """path, title, author, language, publisher, date, description, series, series_index, cover, css of each EPUB that opens."""
    cols = ["title", "creator", "language", "publisher", "date", "description"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    e = Epub(data)
                except (KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError):
                    continue
                index = e.meta("calibre:series_index")
                rows.append((name, *map(e.told, cols), e.meta("calibre:series"), float(index) if index and re.fullmatch(r"\d+(\.\d+)?", index) else None, e.cover(), e.css()))
            parts = list(zip(*rows, strict=True)) or [[]] * 11
            types = [pa.string()] * 8 + [pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts, types, strict=True)], ["path", "title", "author", "language", "publisher", "date", "description", "series", "series_index", "cover", "css"])

    epubs = _files(spark, path).where(F.lower("path").endswith(".epub"))
    return epubs.mapInArrow(run, "path string, title string, author string, language string, publisher string, date string, description string, series string, series_index double, cover string, css string")
