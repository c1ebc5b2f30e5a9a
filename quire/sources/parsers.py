"""Parsing of content: type detection, text and metadata, embedded documents, to any depth.

A parser takes bytes and gives a ``Parsed``: text, metadata, pages and embedded items. ``REGISTRY`` maps media types to parsers; a type
without one, and every format that needs a library or an engine that isn't there (PDF, PST, OCR), comes out as
``unsupported-media-type``. ``register`` adds or replaces a parser; the last one wins.
"""

from __future__ import annotations

import csv
import email
import email.policy
import gzip
import hashlib
import io
import posixpath
import re
import signal
import sys
import tarfile
import threading
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_CONTENT, EMPTY, ENCRYPTED = "unsupported-media-type", "empty-file", "encrypted"

#: (offset, bytes, media type); the first that fits counts.
MAGIC = (
    (0, b"%PDF-", "application/pdf"), (0, b"PK\x03\x04", "application/zip"), (0, b"PK\x05\x06", "application/zip"), (0, b"\x1f\x8b", "application/gzip"), (257, b"ustar", "application/x-tar"),
    (0, b"{\\rtf", "application/rtf"), (0, b"\x89PNG", "image/png"), (0, b"\xff\xd8\xff", "image/jpeg"), (0, b"GIF8", "image/gif"), (0, b"II*\x00", "image/tiff"), (0, b"MM\x00*", "image/tiff"),
    (0, b"!BDN", "application/vnd.ms-outlook-pst"), (0, b"\xd0\xcf\x11\xe0", "application/x-ole-storage"), (0, b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"), (0, b"Rar!", "application/x-rar-compressed"),
)
EXTENSIONS = {
    "html": "text/html", "htm": "text/html", "xhtml": "text/html", "csv": "text/csv", "txt": "text/plain", "tsv": "text/tab-separated-values", "xml": "application/xml", "json": "application/json", "md": "text/plain",
    "eml": "message/rfc822", "mht": "message/rfc822", "mhtml": "message/rfc822", "mime": "message/rfc822", "mbox": "application/mbox",
}
#: What a mail begins with: as written, in any case, and a news item whose header has an id further down.
_MAIL = re.compile(rb"\A(?:Date:|User-Agent:|X-Mailer:|Delivered-To:|Status:|X-Mozilla-(?:Status2?|Keys):|N?#! rnews|(?:Pipe|Forward) to|(?i:Received:|Message-ID:|MIME-Version:|From:|Return-Path:|Relay-Version:))")
_HEADER = re.compile(rb"\A(?i:To|Cc|Subject|X-[\w-]+|DKIM-Signature|Reply-To|Content-Type): ?")
#: What one of a mailbox's first lines begins with, 32 to 256 bytes from the start.
_MBOX = re.compile(rb"\n(?:Subject: |Mime-Version: |Delivered-To: |Date: |From: |Received: (?:from|via|by) )")

csv.field_size_limit(sys.maxsize)


@dataclass
class Item:
    """An embedded document: name, bytes, declared type and length, relation to its container, inline or not. ``opened`` gives a stream in the place of bytes that are too many for a row."""

    name: str | None
    data: bytes
    content_type: str | None = None
    relation: str | None = None
    inline: bool = False
    declared: str | None = None
    opened: Callable[[], BinaryIO] | None = None


@dataclass
class Parsed:
    text: str = ""
    metadata: dict[str, list[str]] = field(default_factory=dict)
    items: list[Item] = field(default_factory=list)
    pages: list[str] = field(default_factory=list)
    html: str | None = None
    reason: str | None = None
    #: Pictures (bytes, type) of the pages, where a parser can make them, for ``Options.ocr_strategy``.
    images: list[tuple[bytes, str]] = field(default_factory=list)


class Encrypted(Exception):
    pass


class TooLarge(Exception):
    pass


class ContentNotFound(Exception):
    pass


def detect(data: bytes, name: str | None = None) -> str:
    """Media type by content first, by name where content says no more than text."""
    for at, magic, kind in MAGIC:
        if data[at : at + len(magic)] == magic:
            if kind == "application/zip":
                return _zip_kind(data)
            return kind
    header = _MBOX.search(data, 32, 300) if data.startswith(b"From ") else None
    if header and header.start() <= 256:
        return "application/mbox"
    if _MAIL.match(data) or data.startswith(b"X-Notes-Item:") and b"Message-ID:" in data[: 8192 + 11] or _HEADER.match(data) and re.search(rb"(?im)^(From|To|Subject|Date|Message-ID|MIME-Version):", data[:8192]):
        return "message/rfc822"
    head = data[:1024].lstrip().lower()
    if head.startswith((b"<!doctype html", b"<html")) or b"<html" in head:
        return "text/html"
    if head.startswith(b"<?xml"):
        return "application/xml"
    ext = (name or "").rpartition(".")[2].lower()
    if ext in EXTENSIONS:
        return EXTENSIONS[ext]
    if b"\x00" in data[:4096] and not data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "application/octet-stream"
    return "text/plain" if data else "application/octet-stream"


_OFFICE, _OPEN = "application/vnd.openxmlformats-officedocument", "application/vnd.oasis.opendocument"


def _zip_kind(data: bytes) -> str:
    try:
        names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
    except (zipfile.BadZipFile, OSError):
        return "application/zip"
    for part, kind in (("word/document.xml", "wordprocessingml.document"), ("xl/workbook.xml", "spreadsheetml.sheet"), ("ppt/presentation.xml", "presentationml.presentation")):
        if part in names:
            return _OFFICE + "." + kind
    if "[Content_Types].xml" in names:
        return _OFFICE
    if "mimetype" in names:
        return zipfile.ZipFile(io.BytesIO(data)).read("mimetype").decode("ascii", "replace").strip() or "application/zip"
    return "application/zip"


def decode(data: bytes) -> tuple[str, str]:
    """Text and the encoding it was in."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace"), "UTF-8" if name == "utf-8-sig" else "UTF-16"
    try:
        return data.decode("utf-8"), "UTF-8"
    except UnicodeDecodeError:
        return data.decode("windows-1252", "replace"), "windows-1252"


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOOLEAN = frozenset("allowfullscreen hidden ismap loop multiple muted nomodule novalidate open readonly required reversed selected checked controls compact declare default defer disabled async active autofocus autosubmit nohref noresize noshade nowrap".split())
SAFE = frozenset(
    "a abbr address article aside b bdi bdo blockquote br caption cite code col colgroup dd del details dfn div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hr i img ins kbd li main mark nav ol p pre q s samp section small span strong sub summary sup table tbody td tfoot th thead time tr u ul var wbr".split()
)
_BLOCK = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
_SILENT = frozenset(("script", "style", "template", "object"))


class _Html(HTMLParser):
    """Text, title, metadata, pages and a clean serialisation in one pass."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text, self.out, self.meta, self.title, self.pages = [], [], {}, [], []
        self.silent, self.in_title, self.open, self.page, self.depth = 0, False, [], None, 0

    def handle_starttag(self, tag, attrs):
        a = {k: v for k, v in attrs}
        if tag in _SILENT:
            self.silent += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "meta":
            name = a.get("name") or a.get("property")
            if name and a.get("content") is not None and "http-equiv" not in a and "httpequiv" not in a:
                self.meta.setdefault(name, []).append(a["content"])
        if self.silent:
            return
        if tag in _BLOCK:
            self.text.append("\n")
        if tag == "div":
            self.depth += 1
            if "page" in (a.get("class") or "").split() and self.page is None:
                self.page = (self.depth, len(self.text))
        if tag in SAFE:
            self.out.append("<" + tag + "".join(f" {k}" if k in BOOLEAN or v is None else f' {k}="{escape(v)}"'.replace("&#x27;", "'") for k, v in attrs if not k.startswith("on") and not (k in ("href", "src", "action") and re.match(r"[\s\x00-\x1f]*javascript:", v or "", re.I))) + ">")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.in_title = False
        if self.silent:
            return
        if tag == "div":
            if self.page and self.page[0] == self.depth:
                self.pages.append("".join(self.text[self.page[1] :]))
                self.page = None
            self.depth = max(0, self.depth - 1)
        if tag in _BLOCK:
            self.text.append("\n")
        if tag in SAFE and tag not in VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.silent:
            self.text.append(data)
            self.out.append(escape(data, quote=False))


def _tidy(text: str) -> str:
    text = re.sub(r"[ \t\r\x0b\f]+", " ", text)
    return re.sub(r" ?\n[ \n]*", "\n", text).strip()


def parse_html(data: bytes) -> Parsed:
    text, encoding = decode(data)
    h = _Html()
    h.feed(text)
    h.close()
    meta = {k: list(v) for k, v in h.meta.items()}
    title = _tidy("".join(h.title))
    if title:
        meta.setdefault("title", []).insert(0, title)
    meta["Content-Encoding"] = [encoding]
    return Parsed(_tidy("".join(h.text)), meta, pages=[_tidy(p) for p in h.pages], html="".join(h.out))


def serialize(metadata: dict[str, list[str]], title: str, body: str) -> str:
    """A document in HTML5: its metadata as ``meta`` elements, its title, and what a parser gave for the body."""
    meta = "".join(f'<meta name="{escape(k)}" content="{escape(v)}">' for k, values in metadata.items() for v in values).replace("&#x27;", "'")
    return f'<!DOCTYPE html>\n<html><head><meta charset="UTF-8">{meta}<title>{escape(title, quote=False)}</title></head><body>{body}</body></html>\n'


def parse_text(data: bytes) -> Parsed:
    text, encoding = decode(data)
    return Parsed(text, {"Content-Encoding": [encoding]}, pages=text.split("\f") if "\f" in text else [])


def parse_csv(data: bytes) -> Parsed:
    """Rows as lines, cells parted by tabs. The delimiter is the one that gives the most rows the same number of cells, more than one; a comma where none does."""
    text, encoding = decode(data)
    best, rows, name = -1, [], "comma"
    for sign, called in ((",", "comma"), (";", "semicolon"), ("\t", "tab"), ("|", "pipe")):
        if best >= 0 and sign not in text:
            continue
        found = list(csv.reader(io.StringIO(text, newline=""), delimiter=sign))
        widths = [len(r) for r in found if r]
        usual = max(set(widths), key=widths.count) if len(set(widths)) < 1000 and widths else 1
        score = sum(w == usual for w in widths) if usual > 1 else 0
        if score > best:
            best, rows, name = score, found, called
    return Parsed("\n".join("\t".join(re.sub(r"\r\n?|\n", " ", c) for c in r) for r in rows), {"Content-Encoding": [encoding], "csv:delimiter": [name], "Content-Type": [f"text/csv; charset={encoding}; delimiter={name}"], "csv:rows": [str(len(rows))]})


def _local(tag: str) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def parse_xml(data: bytes) -> Parsed:
    """The text of all elements, one that begins or holds a block of its own on a new line; attributes and comments are left out."""
    return Parsed(_tidy("\n".join(t.strip() for t in ElementTree.fromstring(data).itertext() if t.strip())), {})


def parse_json(data: bytes) -> Parsed:
    """The source as it stands, which is its text: keys and values both."""
    return parse_text(data)


def parse_mail(data: bytes) -> Parsed:
    """Headers as metadata, all inline texts in their order as text, all attachments and nested messages as items. Of alternatives the first one with any text counts."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    meta: dict[str, list[str]] = {}
    for k, v in message.items():
        meta.setdefault(f"Message:{k}", []).append(str(v))
    if message["subject"]:
        meta["title"] = [str(message["subject"])]
    texts, items = [], []

    def go(part, spare: bool = False) -> None:
        kind = part.get_content_type()
        if kind == "message/rfc822":
            inner = part.get_payload()
            for m in inner if isinstance(inner, list) else [inner]:
                items.append(Item(part.get_filename(), m.as_bytes(), kind, str(len(items))))
        elif part.is_multipart():
            before = len(texts)
            for p in part.iter_parts():
                go(p, spare or kind == "multipart/alternative" and len(texts) > before)
        else:
            content = part.get_payload(decode=True) or b""
            attached = part.get_content_disposition() == "attachment" or part.get_filename()
            if not attached and kind in ("text/plain", "text/html"):
                text = "" if spare else (parse_html(content).text if kind == "text/html" else decode(content)[0]).strip()
                texts.extend([text] if text else [])  # spare: the same body in another form
            else:
                items.append(Item(part.get_filename(), content, kind, part.get("Content-ID") or str(len(items)), part.get_content_disposition() == "inline" and part.get_content_maintype() == "image"))

    go(message)
    return Parsed("\n".join(texts), meta, items)


def parse_mbox(data: bytes) -> Parsed:
    """Messages between lines that begin with ``From ``; such lines inside of messages are quoted with ``>``."""
    messages = [re.sub(rb"(?m)^>(>*From )", rb"\1", m) for m in re.split(rb"(?m)^From [^\n]*\n", data)[1:]]
    return Parsed("", {"mbox:messages": [str(len(messages))]}, [Item(None, m, "message/rfc822", str(i)) for i, m in enumerate(messages)])


def parse_zip(data: bytes) -> Parsed:
    items = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i, info in enumerate(x for x in z.infolist() if not x.is_dir()):
            if info.flag_bits & 1:
                raise Encrypted(info.filename)
            items.append(Item(info.filename, b"", None, str(i), declared=str(info.file_size)))
            if info.file_size > MOST_BYTES:
                items[-1].opened = lambda info=info: zipfile.ZipFile(io.BytesIO(data)).open(info)
            else:
                items[-1].data = z.read(info)
    return Parsed("\n".join(i.name or "" for i in items), {"archive:entries": [str(len(items))]}, items)


def parse_tar(data: bytes) -> Parsed:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        items = [Item(m.name, t.extractfile(m).read(), None, str(i), declared=str(m.size)) for i, m in enumerate(x for x in t.getmembers() if x.isfile())]
    return Parsed("\n".join(i.name or "" for i in items), {"archive:entries": [str(len(items))]}, items)


def parse_gzip(data: bytes) -> Parsed:
    inner = gzip.decompress(data)
    return Parsed("", {}, [Item(None, inner, None, "0", declared=str(len(inner)))])


def parse_rtf(data: bytes) -> Parsed:
    text = data.decode("latin-1")
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("windows-1252", "replace"), text)
    text = re.sub(r"\\(par|line|row)\b ?", "\n", text)
    text = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) & 0xFFFF), text)
    text = re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", text)
    return Parsed(_tidy(text), {})


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _properties(z: zipfile.ZipFile, name: str) -> dict[str, list[str]]:
    """Title, creator, dates and the like of an office document."""
    prefix = {"http://purl.org/dc/elements/1.1/": "dc:", "http://purl.org/dc/terms/": "dcterms:", "urn:oasis:names:tc:opendocument:xmlns:meta:1.0": "meta:", "http://schemas.openxmlformats.org/package/2006/metadata/core-properties": "cp:"}
    out: dict[str, list[str]] = {}
    tree = _xml(z, name)
    for e in tree.iter() if tree is not None else ():
        space = e.tag[1:].partition("}")[0] if e.tag.startswith("{") else ""
        if space in prefix and (e.text or "").strip():
            out.setdefault(prefix[space] + _local(e.tag), []).append(e.text.strip())
    if "dc:title" in out:
        out["title"] = out["dc:title"][:1]
    return out


def _resources(z: zipfile.ZipFile, *folders: str) -> list[Item]:
    return [Item(n, z.read(n), None, n, inline="/media/" in f"/{n}" or n.startswith("Pictures/")) for n in z.namelist() if n.startswith(folders) and not n.endswith("/")]


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Parts by relation id."""
    folder, name = posixpath.split(part)
    tree = _xml(z, f"{folder}/_rels/{name}.rels")
    return {e.get("Id"): posixpath.normpath(posixpath.join(folder, e.get("Target"))).lstrip("/") if not e.get("Target", "").startswith("/") else e.get("Target")[1:] for e in tree} if tree is not None else {}


def _lines(tree: ElementTree.Element, paragraph: str = "p", text: str = "t") -> list[str]:
    """Texts of the paragraphs."""
    return ["".join((t.text or "") if _local(t.tag) == text else "\t" for t in p.iter() if _local(t.tag) in (text, "tab")) for p in tree.iter() if _local(p.tag) == paragraph]


def parse_docx(data: bytes) -> Parsed:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return Parsed("\n".join(_lines(_xml(z, "word/document.xml"))).strip(), _properties(z, "docProps/core.xml"), _resources(z, "word/embeddings/", "word/media/"))


def parse_xlsx(data: bytes) -> Parsed:
    """Each sheet: its name, then its rows as lines, cells parted by tabs; empty cells between others keep their places. Formulas show their last value, dates their number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = _xml(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in strings if _local(si.tag) == "si"] if strings is not None else []
        targets, out, sheets = _targets(z, "xl/workbook.xml"), [], []
        for sheet in (e for e in _xml(z, "xl/workbook.xml").iter() if _local(e.tag) == "sheet"):
            part = next((targets[v] for k, v in sheet.attrib.items() if _local(k) == "id" and v in targets), None)
            if part is None or part not in z.namelist():
                continue
            lines = [sheet.get("name", "")]
            for row in (e for e in _xml(z, part).iter() if _local(e.tag) == "row"):
                cells: dict[int, str] = {}
                for c in (e for e in row if _local(e.tag) == "c"):
                    letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == ("t" if c.get("t") == "inlineStr" else "v"))
                    if c.get("t") == "s" and value:
                        value = shared[int(value)]
                    elif c.get("t") == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    cells[at - 1 if letters else len(cells)] = re.sub(r"[\r\n]+", " ", value)
                lines.append("\t".join(cells.get(i, "") for i in range(max(cells, default=-1) + 1)))
            sheets.append("\n".join(lines))
        return Parsed("\n".join(sheets).strip(), _properties(z, "docProps/core.xml"), _resources(z, "xl/embeddings/", "xl/media/"), pages=sheets)


def parse_pptx(data: bytes) -> Parsed:
    """Slides in the order of the presentation, each with its notes; a slide is a page."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        targets, slides = _targets(z, "ppt/presentation.xml"), []
        for e in _xml(z, "ppt/presentation.xml").iter():
            part = next((targets.get(v) for k, v in e.attrib.items() if k.endswith("}id")), None) if _local(e.tag) == "sldId" else None
            if part in z.namelist():
                notes = [n for n in _targets(z, part).values() if "notesSlide" in n and n in z.namelist()]
                slides.append("\n".join(x for p in (part, *notes) for x in _lines(_xml(z, p)) if x.strip()))
        return Parsed("\n".join(slides).strip(), _properties(z, "docProps/core.xml"), _resources(z, "ppt/embeddings/", "ppt/media/"), pages=slides)


def _cell(e: ElementTree.Element) -> str:
    return " ".join("".join(p.itertext()) for p in e.iter() if _local(p.tag) == "p")


def parse_open_document(data: bytes) -> Parsed:
    """Paragraphs and headings as lines; table rows as lines with cells parted by tabs, each sheet under its name. Sheets and slides are pages. Cells that are repeated for layout only are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        pages: list[str] = []

        def go(e: ElementTree.Element, out: list[str]) -> None:
            kind = _local(e.tag)
            if kind in ("p", "h"):
                out.append("".join(e.itertext()))
            elif kind == "table-row":
                cells = [(_cell(c), int(next((v for k, v in c.attrib.items() if _local(k) == "number-columns-repeated"), 1))) for c in e if _local(c.tag) in ("table-cell", "covered-table-cell")]
                while cells and not cells[-1][0]:
                    cells.pop()
                out.append("\t".join(c for c, n in cells for _ in range(n)))
            elif kind == "table" or kind == "page" and "drawing" in e.tag:
                inner: list[str] = [next((v for k, v in e.attrib.items() if _local(k) == "name"), "")] if kind == "table" else []
                for child in e:
                    go(child, inner)
                page = "\n".join(inner).strip()
                pages.append(page)
                out.append(page)
            else:
                for child in e:
                    go(child, out)

        lines: list[str] = []
        go(_xml(z, "content.xml"), lines)
        return Parsed("\n".join(lines).strip(), _properties(z, "meta.xml"), _resources(z, "Pictures/", "Object "), pages=pages)


def parse_epub(data: bytes) -> Parsed:
    """The chapters in reading order, each a page; pictures as inline resources."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = next(e.get("full-path") for e in _xml(z, "META-INF/container.xml").iter() if _local(e.tag) == "rootfile")
        package, folder = _xml(z, root), posixpath.dirname(root)
        place = lambda href: posixpath.normpath(posixpath.join(folder, href))
        parts = {e.get("id"): (place(e.get("href")), e.get("media-type") or "") for e in package.iter() if _local(e.tag) == "item"}
        chapters = [parse_html(z.read(parts[e.get("idref")][0])) for e in package.iter() if _local(e.tag) == "itemref" and e.get("idref") in parts]
        items = [Item(n, z.read(n), kind, n, inline=True) for n, kind in parts.values() if kind.startswith("image/") and n in z.namelist()]
        return Parsed("\n".join(c.text for c in chapters if c.text), _properties(z, root), items, [c.text for c in chapters], "".join(c.html or "" for c in chapters))


#: Embedded documents beyond this are too large for a row: they carry an error in the place of their text, with their true size and digest.
MOST_BYTES = (1 << 31) - (1 << 20)
Parser = Callable[[bytes], Parsed]
REGISTRY: dict[str, Parser] = {
    "text/html": parse_html, "text/plain": parse_text, "text/csv": parse_csv, "text/tab-separated-values": parse_csv, "application/json": parse_json, "application/xml": parse_xml,
    "message/rfc822": parse_mail, "application/mbox": parse_mbox, "application/zip": parse_zip, "application/x-tar": parse_tar, "application/gzip": parse_gzip, "application/rtf": parse_rtf,
    f"{_OFFICE}.wordprocessingml.document": parse_docx, f"{_OFFICE}.spreadsheetml.sheet": parse_xlsx, f"{_OFFICE}.presentationml.presentation": parse_pptx, "application/epub+zip": parse_epub,
    f"{_OPEN}.text": parse_open_document, f"{_OPEN}.spreadsheet": parse_open_document, f"{_OPEN}.presentation": parse_open_document,
}


def register(media_type: str, parser: Parser) -> None:
    REGISTRY[media_type] = parser


def count_entries(data: bytes) -> int | None:
    """Entries of a plain archive that aren't directories; None where the container is a document format or can't be read."""
    if not data.startswith(b"PK") or _zip_kind(data) != "application/zip":
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return sum(not i.is_dir() for i in z.infolist())
    except zipfile.BadZipFile:
        return None


STRATEGIES = ("NO_OCR", "AUTO", "OCR_AND_TEXT", "OCR_ONLY")


class TimeoutException(Exception):
    pass


def limited(seconds: float, work: Callable[[], list]) -> list:
    """``work()``, broken off after some seconds; no limit for 0. Outside of a process's main thread, where no alarm can be had, a thread that is late is left behind."""
    if seconds <= 0:
        return work()
    late = TimeoutException(f"more than {seconds:g} s")
    if threading.current_thread() is threading.main_thread():

        def stop(*_):
            raise late

        before = signal.signal(signal.SIGALRM, stop)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return work()
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
    done: list = []

    def run() -> None:
        try:
            done.append((work(), None))
        except BaseException as e:
            done.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not done:
        raise late
    value, error = done[0]
    if error:
        raise error
    return value


def clean_metadata(data: bytes, kind: str) -> bytes:
    """A cleaner for ``Options``: office documents without their properties, nor anything that refers to them; anything else unchanged."""
    if not kind.startswith((_OFFICE, _OPEN)):
        return data
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for info in old.infolist():
            if info.filename.startswith("docProps/") or kind.startswith(_OPEN) and info.filename == "meta.xml":
                continue
            part = old.read(info)
            if info.filename in ("_rels/.rels", "[Content_Types].xml", "META-INF/manifest.xml"):
                part = re.sub(rb"<(?:\w+:)?(?:Relationship|Override|file-entry)\b[^>]*(?:[\"'/]docProps/|[\"']meta\.xml[\"'])[^>]*?(?:/>|>\s*</(?:\w+:)?(?:Relationship|Override|file-entry)>)", b"", part)
            new.writestr(info, part)
    return out.getvalue()


@dataclass(frozen=True)
class Options:
    """How to parse: ``embeds`` is spawn (children are rows), concatenate (their text joins their parent's) or ignore.

    ``ocr`` gives an image's text and confidence (0 to 1) from bytes and type; ``transcode`` makes an image of another type readable for it. Without it nothing is recognised; with it, pictures are,
    and ``ocr_strategy`` says what becomes of pages that a parser has pictures of: their text layer alone (NO_OCR), recognised text where a page has none (AUTO), both, or recognised text alone. ``selector`` tells from a
    document's metadata whether it gets ``output`` or plain text. ``keep_raw`` keeps the bytes, of failed documents too. ``timeout`` is for each file, in seconds, a day by default; 0 is no limit.
    """

    embeds: str = "spawn"
    output: str = "text"
    algorithm: str = "sha256"
    project: str = ""
    max_depth: int = 20
    max_bytes: int = 0
    ocr: Callable[[bytes, str], tuple[str, float]] | None = None
    ocr_strategy: str = "NO_OCR"
    ocr_least_bytes: int = 0
    ocr_types: tuple[str, ...] = ("image/png", "image/jpeg", "image/tiff", "image/gif")
    transcode: Callable[[bytes, str], bytes] | None = None
    cleaner: Callable[[bytes, str], bytes] | None = None
    selector: Callable[[dict[str, list[str]]], bool] | None = None
    keep_raw: bool = False
    timeout: float = 86_400

    def strategy(self) -> str:
        """One of ``STRATEGIES``; NO_OCR without an engine or for an unknown name."""
        name = self.ocr_strategy.upper()
        return name if self.ocr and name in STRATEGIES else "NO_OCR"


def _recognise(p: Parsed, options: Options) -> None:
    """Text of the pages by the OCR strategy, from their text layers and their pictures."""
    strategy = options.strategy()
    if strategy == "NO_OCR" or not p.images:
        return
    layers, sure = [*p.pages, *[""] * (len(p.images) - len(p.pages))], []
    pages = []
    for text, (image, kind) in zip(layers, p.images):
        if strategy == "AUTO" and text.strip():
            pages.append(text)
            continue
        seen, confidence = options.ocr(image, kind)
        sure.append(confidence)
        pages.append(f"{text}\n{seen}" if strategy == "OCR_AND_TEXT" and text else seen)
    p.pages, p.text, p.html = [*pages, *layers[len(pages) :]], "\n".join([*pages, *layers[len(pages) :]]), None
    if sure:
        p.metadata["ocr:parser"], p.metadata["ocr:confidence"] = [getattr(options.ocr, "__name__", "ocr")], [str(sum(sure) / len(sure))]


def _too_large(declared: str | None, most: int) -> bool:
    """As ``filters.too_large``: what isn't an integer is let through."""
    text = (declared or "").strip(" ")
    return most > 0 and bool(re.fullmatch(r"[+-]?[0-9]+", text)) and int(text) > most


def unfold(path: str, data: bytes | None, options: Options, parsers: dict[str, Parser], seen: Callable[[dict, bytes], None] | None = None) -> Iterator[dict]:
    """Rows of a file: the root and all that is embedded in it, depth first; a failure stays with its item. ``seen`` is called with each document's row and bytes before it is parsed."""
    ordinal = 0

    def digest(b: bytes | BinaryIO) -> tuple[str, int]:
        h = hashlib.new(options.algorithm, options.project.encode())
        if isinstance(b, bytes):
            h.update(b)
            return h.hexdigest(), len(b)
        size = 0
        while part := b.read(1 << 24):
            h.update(part)
            size += len(part)
        return h.hexdigest(), size

    def go(data: bytes, name: str | None, relation: str | None, parent: dict | None, declared_type: str | None, opened: Callable[[], BinaryIO] | None = None) -> Iterator[dict]:
        nonlocal ordinal
        level = parent["level"] + 1 if parent else 0
        own, size = digest(opened() if opened else data)
        ident = own if parent is None else hashlib.new(options.algorithm, "".join(x for x in (own, parent["id"], relation, name) if x is not None).encode("utf-8", "surrogatepass")).hexdigest()
        row = {
            "id": ident, "root_id": parent["root_id"] if parent else ident, "parent_id": parent["id"] if parent else None, "level": level, "ordinal": ordinal, "path": path, "name": name,
            "content_type": None, "content": None, "size": size, "digest": own, "metadata": {}, "pages": [], "no_content_reason": None, "error": None, "skipped_depth": 0, "skipped_size": 0, "ocr_confidence": None, "raw": data if options.keep_raw and not opened else None,
        }
        ordinal += 1
        if seen:
            seen(row, data)
        kids: list[dict] = []
        try:
            if opened:
                raise TooLarge(f"{size} bytes")
            kind = detect(data, name)
            if kind == "text/plain" and declared_type in parsers:
                kind = declared_type
            row["content_type"] = kind
            if options.cleaner:
                data = options.cleaner(data, kind)
            if not data:
                row["no_content_reason"] = EMPTY
            elif options.ocr and kind.startswith("image/") and len(data) >= options.ocr_least_bytes and (kind in options.ocr_types or options.transcode):
                image = data if kind in options.ocr_types else options.transcode(data, kind)
                row["content"], row["ocr_confidence"] = options.ocr(image, kind if kind in options.ocr_types else "image/png")
                row["metadata"] = {"ocr:parser": [getattr(options.ocr, "__name__", "ocr")], "ocr:confidence": [str(row["ocr_confidence"])]}
            elif kind not in parsers:
                row["no_content_reason"] = NO_CONTENT
            else:
                p = parsers[kind](data)
                _recognise(p, options)
                row["metadata"], row["pages"], row["no_content_reason"] = p.metadata, p.pages, p.reason
                row["content_type"] = p.metadata.get("Content-Type", [kind])[0]
                shaped = options.output == "html" and (options.selector is None or options.selector(p.metadata))
                row["content"] = serialize(p.metadata, p.metadata.get("title", [""])[0], p.html if p.html is not None else f"<p>{escape(p.text, quote=False)}</p>") if shaped else p.text
                nameless = 0
                for item in p.items if options.embeds != "ignore" else []:
                    if options.max_depth > 0 and level + 1 > options.max_depth:
                        row["skipped_depth"] += 1
                        continue
                    if _too_large(item.declared, options.max_bytes):
                        row["skipped_size"] += 1
                        continue
                    title = item.name
                    if not title:
                        title, nameless = f"untitled_{ident}_{nameless}", nameless + 1
                    below = list(go(item.data, title, item.relation, row, item.content_type, item.opened))
                    if item.inline or options.embeds == "concatenate":
                        for b in below:
                            if b["content"]:
                                block = f'<div class="package-entry"><h1>{escape(b["name"] or "", quote=False)}</h1>{b["content"]}</div>' if options.output == "html" else b["content"]
                                row["content"] = (row["content"] or "") + "\n" + block
                            if b["ocr_confidence"] is not None and item.inline:
                                row["metadata"].setdefault("ocr:parser", b["metadata"]["ocr:parser"])
                        if options.embeds == "concatenate" or not any(b["error"] for b in below):
                            continue
                    kids += below
        except (TimeoutException, _Found):
            raise
        except Encrypted as e:
            row["no_content_reason"], row["error"] = ENCRYPTED, f"EncryptedDocumentException: {e}"
        except RuntimeError as e:
            locked = "password" in str(e)
            row["no_content_reason"] = ENCRYPTED if locked else None
            row["error"] = f"EncryptedDocumentException: {e}" if locked else f"ParseException: {type(e).__name__}: {e}"
        except Exception as e:  # whatever a parser throws concerns this item alone
            row["error"] = f"ParseException: {type(e).__name__}: {e}"
        yield row
        yield from kids

    failed = {"id": hashlib.new(options.algorithm, path.encode("utf-8", "surrogatepass")).hexdigest(), "path": path, "level": 0, "ordinal": 0, "metadata": {}, "pages": [], "skipped_depth": 0, "skipped_size": 0}
    failed["root_id"] = failed["id"]
    if data is None:
        yield failed | {"error": f"NoSuchFileException: {path}"}
        return
    try:
        rows = limited(options.timeout, lambda: list(go(data, path.rpartition("/")[2], None, None, None)))
    except TimeoutException as e:
        rows = [failed | {"error": f"TimeoutException: {e}", "size": len(data), "raw": data if options.keep_raw else None}]
    yield from rows


class _Found(Exception):
    def __init__(self, row: dict, data: bytes) -> None:
        self.row, self.data = row, data


def find_embedded(path: str, data: bytes, ident: str, options: Options = Options(), parsers: dict[str, Parser] | None = None) -> tuple[dict, bytes]:
    """Row (not parsed yet) and bytes of the embedded document with an id. Its root is parsed again, no further than to the document; ``ContentNotFound`` if it isn't there. Ids are those of ``parse`` with the same options."""

    def look(row: dict, found: bytes) -> None:
        if row["id"] == ident:
            raise _Found(row, found)

    try:
        for _ in unfold(path, data, options, parsers or REGISTRY, look):
            pass
    except _Found as e:
        return e.row, e.data
    raise ContentNotFound(ident)


COLUMNS = (
    "id string, root_id string, parent_id string, level int, ordinal int, path string, name string, content_type string, content string, size bigint, digest string, "
    "metadata map<string,array<string>>, pages array<string>, no_content_reason string, error string, skipped_depth int, skipped_size int, ocr_confidence double, raw binary"
)
SCHEMA = pa.schema([
    ("id", pa.string()), ("root_id", pa.string()), ("parent_id", pa.string()), ("level", pa.int32()), ("ordinal", pa.int32()), ("path", pa.string()), ("name", pa.string()), ("content_type", pa.string()), ("content", pa.string()), ("size", pa.int64()), ("digest", pa.string()),
    ("metadata", pa.map_(pa.string(), pa.list_(pa.string()))), ("pages", pa.list_(pa.string())), ("no_content_reason", pa.string()), ("error", pa.string()), ("skipped_depth", pa.int32()), ("skipped_size", pa.int32()), ("ocr_confidence", pa.float64()), ("raw", pa.binary()),
])
#: A batch of rows ends after so many rows or bytes.
BATCH_ROWS, BATCH_BYTES = 200, 32 << 20


def read_bytes(path: str) -> bytes | None:
    """Content of a file by path, or by URL from a store that Arrow can read (``file:``, ``hdfs:``, ``s3:``, ``gs:``); None if it can't be read."""
    try:
        if "://" in path or path.startswith("file:"):
            from pyarrow import fs

            store, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
            with store.open_input_stream(place) as f:
                return f.read()
        with open(path, "rb") as f:
            return f.read()
    except (OSError, pa.ArrowException):
        return None


def _plain(value):
    """Without lone surrogates, which no UTF-8 column can hold."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode() if not value.isascii() else value
    if isinstance(value, dict):
        return [(_plain(k), [_plain(x) for x in v]) for k, v in value.items()]
    return [_plain(x) for x in value] if isinstance(value, list) else value


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    total = 0
    for row in rows:
        held.append({k: _plain(v) for k, v in row.items()})
        total += sum(len(row.get(k) or b"") for k in ("content", "raw")) + 1000
        if len(held) >= BATCH_ROWS or total >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, SCHEMA)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, SCHEMA)


def parse(files: DataFrame, options: Options = Options(), path: str = "path", content: str | None = None) -> DataFrame:
    """Documents (``COLUMNS``) of files given by path or URL, or by path and content. Content is read where it is parsed, so only paths are moved about."""
    parsers = dict(REGISTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for i, p in enumerate(batch.column("path").to_pylist()):
                    if content:
                        c = batch.column("content")[i].as_py()
                        data = c.encode() if isinstance(c, str) else c
                    else:
                        data = read_bytes(p)
                    yield from unfold(p, data, options, parsers)

        yield from _batches(rows())

    chosen = files.select(F.col(path).alias("path"), *([F.col(content).alias("content")] if content else []))
    return chosen.mapInArrow(run, COLUMNS)


def embedded(files: DataFrame, options: Options = Options(), path: str = "path", ident: str = "id") -> DataFrame:
    """(path, id, name, raw, error) for pairs of a root's path and an embedded document's id: its bytes, or ``ContentNotFound``."""
    parsers = dict(REGISTRY)
    kind = pa.schema([("path", pa.string()), ("id", pa.string()), ("name", pa.string()), ("raw", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, want in zip(batch.column("path").to_pylist(), batch.column("id").to_pylist()):
                data, name, raw, error = read_bytes(p), None, None, None
                try:
                    if data is None:
                        raise FileNotFoundError(p)
                    row, raw = find_embedded(p, data, want, options, parsers)
                    name = row["name"]
                except (ContentNotFound, TimeoutException, OSError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_pylist([{"path": p, "id": want, "name": name, "raw": raw, "error": error}], kind)

    return files.select(F.col(path).alias("path"), F.col(ident).alias("id")).mapInArrow(run, "path string, id string, name string, raw binary, error string")


def archive_entries(files: DataFrame, path: str = "path", content: str | None = None) -> DataFrame:
    """(path, entries) of files: entries of plain archives, null for anything else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            counts = [count_entries((batch.column("content")[i].as_py() if content else read_bytes(p)) or b"") for i, p in enumerate(paths)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "entries"])

    return files.select(F.col(path).alias("path"), *([F.col(content).cast("binary").alias("content")] if content else [])).mapInArrow(run, "path string, entries bigint")
