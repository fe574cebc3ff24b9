"""A file as a graph of objects: revisions, object streams, encryption, the page tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .crypto import Security
from .filters import decode
from .lexer import Keyword, Lexer
from .objects import Name, PdfError, Ref, Stream, numbers

LEAST_BYTES, HEAD, TAIL = 20, 20, 1024
DEFAULT_BOX = (0.0, 0.0, 612.0, 792.0)
INHERITED = ("MediaBox", "Rotate", "Resources")


@dataclass(slots=True)
class Entry:
    """A cross-reference entry. kind: used, free or packed."""

    num: int
    gen: int
    kind: str
    offset: int = 0  # used: of the object; free: the next free number; packed: number of the object stream
    index: int = 0  # packed: place in the object stream
    revision: int = 0


@dataclass
class Page:
    index: int
    ref: Ref | None
    dict: dict
    inherited: dict


@dataclass
class Document:
    version: str | None
    start: int
    trailer: dict
    entries: list[Entry]
    objects: dict[int, tuple[Ref, object]] = field(default_factory=dict)
    errors: list[tuple[int, str]] = field(default_factory=list)
    security: Security | None = None
    fonts: dict[int, tuple] = field(default_factory=dict, repr=False, compare=False)  # those read, by object number

    def get(self, x):
        """x, or what it refers to; references in a circle are null."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x.num, (None, None))[1]
        return None

    def dict_of(self, x) -> dict:
        x = self.get(x)
        return x if isinstance(x, dict) else x.dict if isinstance(x, Stream) else {}

    def content(self, x) -> bytes:
        x = self.get(x)
        return decode(x, self.get) if isinstance(x, Stream) else b""

    @property
    def catalog(self) -> dict:
        return self.dict_of(self.trailer.get("Root"))

    @property
    def info(self) -> dict:
        return self.dict_of(self.trailer.get("Info"))

    @property
    def declared_pages(self) -> int | None:
        n = self.get(self.dict_of(self.catalog.get("Pages")).get("Count"))
        return n if isinstance(n, int) else None

    def pages(self) -> list[Page]:
        """The page tree's leaves in order, each with what it takes from its nearest ancestor."""
        out: list[Page] = []
        seen: set[int] = set()
        stack: list[tuple[object, dict]] = [(self.catalog.get("Pages"), {})]
        while stack:
            x, above = stack.pop()
            if isinstance(x, Ref):
                if x.num in seen:
                    continue
                seen.add(x.num)
            node = self.dict_of(x)
            if not node:
                continue
            own = above | {k: node[k] for k in INHERITED if self.get(node.get(k)) is not None}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                stack += [(k, own) for k in reversed(kids)]
            elif node.get("Type") != "Pages":
                out.append(Page(len(out), x if isinstance(x, Ref) else None, node, own))
        return out

    def box(self, page: Page, name: str = "MediaBox") -> tuple:
        """MediaBox is inherited; CropBox is not, and is the MediaBox where absent."""
        x = self.get(page.inherited.get(name) if name == "MediaBox" else page.dict.get(name))
        got = numbers([self.get(v) for v in x], 4) if isinstance(x, list) else None
        return got or (DEFAULT_BOX if name == "MediaBox" else self.box(page))

    def rotation(self, page: Page) -> int:
        x = self.get(page.inherited.get("Rotate"))
        return int(x) % 360 if isinstance(x, (int, float)) else 0

    def resources(self, page: Page) -> dict:
        return self.dict_of(page.inherited.get("Resources"))

    def page_content(self, page: Page) -> bytes:
        """All content streams of a page, joined by line breaks, so that operands may go over from one to the next."""
        x = self.get(page.dict.get("Contents"))
        return b"\n".join(self.content(s) for s in x) if isinstance(x, list) else self.content(x)


def header_version(data: bytes) -> str | None:
    m = re.search(rb"%PDF-(\d+\.\d+)", data[:HEAD])
    return m[1].decode() if m else None


_START = re.compile(rb"startxref\s+(\d+)")
_SECTION = re.compile(rb"(\d+)[ \t]+(\d+)\s*")
_ROW = re.compile(rb"\s*(\d{1,10})[ \t]+(\d{1,5})[ \t]+([nf])")


def _classic(lexer: Lexer, revision: int) -> list[Entry]:
    """Sections of a classic table; lexer stands after the word xref."""
    out = []
    while True:
        lexer.skip()
        at = lexer.pos
        m = _SECTION.match(lexer.data, at)
        if not m:
            return out
        first, n, pos = int(m[1]), int(m[2]), m.end()
        row, data = _ROW.match, lexer.data
        for i in range(n):
            e = row(data, pos)
            if not e:
                break
            pos = e.end()
            offset, gen, kind = e.groups()
            out.append(Entry(first + i, int(gen), "used" if kind == b"n" else "free", int(offset), 0, revision))
        lexer.pos = pos


def _packed(stream: Stream, revision: int) -> list[Entry]:
    """Entries of a cross-reference stream."""
    data = decode(stream)
    widths = [int(w) for w in stream.dict.get("W", [])][:3]
    if len(widths) < 3 or sum(widths) <= 0:
        raise PdfError("xref", "a cross-reference stream has no widths")
    size = stream.dict.get("Size", 0)
    index = stream.dict.get("Index") or [0, size]
    out, pos = [], 0
    for first, n in zip(index[::2], index[1::2], strict=False):
        for i in range(n):
            row = data[pos : pos + sum(widths)]
            if len(row) < sum(widths):
                return out
            pos += len(row)
            values, at = [], 0
            for w in widths:
                values.append(int.from_bytes(row[at : at + w], "big"))
                at += w
            kind = values[0] if widths[0] else 1
            if kind == 0:
                out.append(Entry(first + i, values[2], "free", values[1], 0, revision))
            elif kind == 1:
                out.append(Entry(first + i, values[2], "used", values[1], 0, revision))
            elif kind == 2:
                out.append(Entry(first + i, 0, "packed", values[1], values[2], revision))
    return out


def _chain(data: bytes, start: int) -> tuple[dict, list[Entry]]:
    """Trailer of the newest revision and the entries of all, newest first."""
    trailer: dict = {}
    entries: list[Entry] = []
    seen: set[int] = set()
    todo = [start]
    revision = 0
    while todo:
        at = todo.pop(0)
        if at in seen or not 0 <= at < len(data):
            continue
        seen.add(at)
        lexer = Lexer(data, at)
        lexer.skip()
        if data.startswith(b"xref", lexer.pos):
            lexer.pos += 4
            own = _classic(lexer, revision)
            if lexer.next(False) != b"trailer":
                raise PdfError("trailer", "a cross-reference table has no trailer")
            t = lexer.next()
            if not isinstance(t, dict):
                raise PdfError("trailer", "the trailer is no dictionary")
            if isinstance(t.get("XRefStm"), int):
                todo.insert(0, t["XRefStm"])
        else:
            _, x = lexer.indirect()
            if not isinstance(x, Stream) or x.dict.get("Type") != "XRef":
                raise PdfError("xref", "no cross-reference section where one should be")
            own, t = _packed(x, revision), x.dict
        entries += own
        trailer = trailer or t
        if isinstance(t.get("Prev"), (int, float)):
            todo.append(int(t["Prev"]))
        revision += 1
    return trailer, entries


def _scan(data: bytes) -> tuple[dict, list[Entry]]:
    """Entries of all objects found in a file whose tables can't be read."""
    entries = [Entry(int(m[1]), int(m[2]), "used", m.start(1)) for m in re.finditer(rb"(?<![0-9])(\d{1,10})[ \t]+(\d{1,5})[ \t]+obj\b", data)][::-1]
    trailer: dict = {}
    for m in re.finditer(rb"\btrailer\b", data):
        try:
            t = Lexer(data, m.end()).next()
            trailer |= t if isinstance(t, dict) else {}
        except (PdfError, EOFError):
            continue
    for e in entries if "Root" not in trailer else []:
        try:
            _, x = Lexer(data, e.offset).indirect()
        except (PdfError, EOFError):
            continue
        d = x.dict if isinstance(x, Stream) else x if isinstance(x, dict) else {}
        if d.get("Type") == "XRef" and "Root" in d:
            trailer = d | trailer
        elif d.get("Type") == "Catalog":
            trailer.setdefault("Root", Ref(e.num, e.gen))
    if "Root" not in trailer:
        raise PdfError("trailer", "neither a trailer nor a catalog was found")
    return trailer, entries


def latest(entries: list[Entry]) -> dict[int, Entry]:
    """By object number, the entry of the newest revision; a freed number hides its older entries."""
    out: dict[int, Entry] = {}
    for e in entries:
        out.setdefault(e.num, e)
    return out


def parse(data: bytes, password: str = "", repair: bool = True) -> Document:
    """Reads a file; PdfError says why it can't be read, and damaged objects are listed in errors."""
    if len(data) < LEAST_BYTES:
        raise PdfError("size", f"a file has {LEAST_BYTES} bytes at least")
    version = header_version(data)
    if version is None:
        raise PdfError("header", "no header")
    tail_at = max(0, len(data) - TAIL)
    tail = data[tail_at:]
    found = list(_START.finditer(tail))
    start = int(found[-1][1]) if found and b"%%EOF" in tail else -1
    try:
        if start < 0:
            raise PdfError("trailer", "no startxref at the end")
        trailer, entries = _chain(data, start)
        if "Root" not in trailer:
            raise PdfError("trailer", "the trailer names no catalog")
    except (PdfError, EOFError, ValueError, TypeError) as e:
        if not repair:
            raise e if isinstance(e, PdfError) else PdfError("xref", str(e)) from e
        trailer, entries = _scan(data)
    doc = Document(version, start, trailer, entries)
    current = latest(entries)

    def length_of(ref: Ref):
        e = current.get(ref.num)
        if e is None or e.kind != "used":
            return None
        try:
            x = Lexer(data, e.offset).indirect()[1]
        except (PdfError, EOFError):
            return None
        return x if isinstance(x, int) else None

    def read(e: Entry):
        ref, value = Lexer(data, e.offset).indirect(length_of)
        if ref.num != e.num:
            raise PdfError("object", f"object {ref.num} where {e.num} should be")
        return ref, value

    if (encrypt := trailer.get("Encrypt")) is not None:
        sealed = encrypt.num if isinstance(encrypt, Ref) else None
        if sealed is not None:
            encrypt = read(current[sealed])[1] if sealed in current else None
        ids = trailer.get("ID")
        if not isinstance(encrypt, dict):
            raise PdfError("encryption", "the encryption dictionary is missing")
        doc.security = Security(encrypt, bytes(ids[0]) if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b"", password)
    else:
        sealed = None
    for e in current.values():
        if e.kind != "used" or e.offset == 0:
            continue
        try:
            ref, value = read(e)
        except (PdfError, EOFError, ValueError, OverflowError) as x:
            doc.errors.append((e.num, str(x) or "the file ends within the object"))
            continue
        if doc.security and e.num != sealed:
            value = doc.security.open(value, ref)
        doc.objects[e.num] = (ref, value)
    by_stream: dict[int, list[Entry]] = {}
    for e in current.values():
        if e.kind == "packed":
            by_stream.setdefault(e.offset, []).append(e)
    for num, members in by_stream.items():
        box = doc.objects.get(num, (None, None))[1]
        try:
            if not isinstance(box, Stream):
                raise PdfError("object", f"object stream {num} is missing")
            content = decode(box, doc.get)
            first, n = int(doc.get(box.dict.get("First", 0))), int(doc.get(box.dict.get("N", 0)))
            head = Lexer(content[:first])
            pairs = [(head.next(False), head.next(False)) for _ in range(n)]
        except (PdfError, EOFError, ValueError, TypeError) as x:
            doc.errors += [(e.num, str(x)) for e in members]
            continue
        offsets = {k: o for k, o in reversed(pairs) if isinstance(k, int) and isinstance(o, int)}
        for e in members:
            try:
                value = Lexer(content, first + offsets[e.num]).next()
                doc.objects[e.num] = (Ref(e.num, 0), None if isinstance(value, Keyword) else value)
            except (PdfError, EOFError, KeyError) as x:
                doc.errors.append((e.num, str(x)))
    return doc


def count_kinds(doc: Document) -> dict[str, int]:
    out = {"used": 0, "free": 0, "packed": 0}
    for e in latest(doc.entries).values():
        out[e.kind] += 1
    return out


def is_image(x) -> bool:
    return isinstance(x, Stream) and x.dict.get("Subtype") == Name("Image")
