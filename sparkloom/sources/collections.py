"""Data Source ``page_collection``: folders of paged JSON, XML or HTML files as rows of fields, with declared files that must be there.

Options: ``path`` (a folder), ``kind`` (json, xml, html), ``required`` (file names or stems, comma-separated), ``item`` (tag of an XML or HTML item, default
``item`` and ``article``). Files whose names begin with a dot or an underscore are not read. Partitions are files, small ones together up to ``PART_BYTES``.

A collection never is an empty relation by mistake: a folder without files, a missing required file and a file without items stop the query.
Rows: file, page and total as the file declares them (null where it does not), item (from 0), fields (map; of repeated keys the first; nested values as JSON).
"""

from __future__ import annotations

import json
import os
import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES = 32 << 20
SCHEMA = "file string, page int, total long, item int, fields map<string,string>"
Item = tuple[int | None, int | None, dict[str, str | None]]


def as_text(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False, sort_keys=True)


def number(x) -> int | None:
    return int(x) if x is not None and re.fullmatch(r"\s*\d+\s*", str(x)) else None


def json_items(data: bytes, _: str) -> Iterator[Item]:
    """A list of objects, or an object with one; where there are several lists, the longest is the items."""
    root = json.loads(data)
    lists = [v for v in root.values() if isinstance(v, list) and all(isinstance(x, dict) for x in v)] if isinstance(root, dict) else [root]
    head = root if isinstance(root, dict) else {}
    for x in max(lists, key=len, default=[]):
        yield number(head.get("page")), number(head.get("total")), {k: as_text(v) for k, v in x.items()}


def xml_items(data: bytes, tag: str) -> Iterator[Item]:
    """Elements with the tag: attributes, then children by their tags."""
    root = ElementTree.fromstring(data)
    for x in root.iter(tag):
        fields: dict[str, str | None] = dict(x.attrib)
        for child in x:
            fields.setdefault(child.tag, "".join(child.itertext()).strip() or None)
        yield number(root.get("page")), number(root.get("total")), fields


class _Lines(HTMLParser):
    """Lines of text inside elements with a tag; page and total from ``meta`` elements."""

    BREAKS = frozenset("p li div tr br h1 h2 h3 h4 dt dd".split())

    def __init__(self, tag: str):
        super().__init__()
        self.tag, self.depth, self.hidden, self.items, self.meta = tag, 0, 0, [], {}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and a.get("name"):
            self.meta.setdefault(a["name"], a.get("content"))
        self.hidden += tag in ("script", "style")
        if tag == self.tag:
            self.depth += 1
            if self.depth == 1:
                self.items.append("")
        elif tag in self.BREAKS:
            self._add("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag == self.tag and self.depth:
            self.depth -= 1
        elif tag in self.BREAKS:
            self._add("\n")

    def handle_data(self, data):
        if not self.hidden:
            self._add(data)

    def _add(self, text: str) -> None:
        if self.depth:
            self.items[-1] += text


def html_items(data: bytes, tag: str) -> Iterator[Item]:
    """Elements with the tag: their ``key : value`` lines."""
    p = _Lines(tag)
    p.feed(data.decode("utf-8", "replace"))
    p.close()
    for text in p.items:
        fields: dict[str, str | None] = {}
        for line in text.split("\n"):
            key, colon, value = line.partition(":")
            if colon and key.strip():
                fields.setdefault(key.strip(), value.strip() or None)
        yield number(p.meta.get("page")), number(p.meta.get("total")), fields


PARSERS = {"json": (json_items, ""), "xml": (xml_items, "item"), "html": (html_items, "article")}


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), "/" + path[5:].lstrip("/") if path.startswith("file:") else os.path.abspath(path)) if path.startswith("file:") or "://" not in path else pafs.FileSystem.from_uri(path)


class CollectionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"], options["kind"]
        self.required = [x.strip() for x in options.get("required", "").split(",") if x.strip()]
        self.tag = options.get("item", PARSERS[self.kind][1])

    def partitions(self) -> list[Files]:
        fs, root = _open(self.path)
        found = [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))]
        if not found:
            raise FileNotFoundError(f"no files in {self.path}")
        have = {f.base_name for f in found} | {f.base_name.rsplit(".", 1)[0] for f in found}
        missing = [x for x in self.required if x not in have]
        if missing:
            raise FileNotFoundError(f"declared files are missing: {', '.join(missing)}")
        out, size = [], PART_BYTES
        for f in sorted(found, key=lambda f: f.path):
            if size + f.size > PART_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].names.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = _open(self.path)
        for name in partition.names:
            with fs.open_input_file(name) as f:
                data = f.read()
            n = 0
            for page, total, fields in PARSERS[self.kind][0](data, self.tag):
                yield os.path.basename(name), page, total, n, fields
                n += 1
            if not n:
                raise ValueError(f"{name} has no items")


class PageCollection(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_collection"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CollectionReader:
        if self.options.get("kind") not in PARSERS:
            raise ValueError(f"kind must be one of {', '.join(PARSERS)}")
        return CollectionReader(dict(self.options))


def collection(spark: SparkSession, path: str, kind: str, required: str = "", **options: str) -> DataFrame:
    """``spark.read.format("page_collection")`` with the source registered."""
    spark.dataSource.register(PageCollection)
    return spark.read.format("page_collection").options(path=path, kind=kind, required=required, **options).load()
