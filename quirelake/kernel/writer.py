"""Files from objects: a builder, whole files, and appended revisions."""

from __future__ import annotations

import hashlib
import zlib

from .content import Instruction, serialize, write_value
from .crypto import Security, aes_encrypt, make_encryption, object_key, rc4
from .filters import encode
from .objects import Name, Ref, Str, Stream


class ContentBuilder:
    """Instructions by name; each method returns the builder."""

    #: Methods and their operators.
    OPS = {"save": "q", "restore": "Q", "concat": "cm", "line_width": "w", "move_to": "m", "line_to": "l", "curve_to": "c", "rectangle": "re", "close": "h", "stroke": "S", "fill": "f", "fill_stroke": "B", "end_path": "n", "fill_rgb": "rg", "stroke_rgb": "RG", "begin_text": "BT", "end_text": "ET", "move": "Td", "next_line": "T*", "text_matrix": "Tm", "leading": "TL"}

    def __init__(self):
        self.instructions: list[Instruction] = []

    def op(self, op: str, *args) -> ContentBuilder:
        self.instructions.append(Instruction(op, list(args)))
        return self

    def __getattr__(self, name: str):
        if name not in self.OPS:
            raise AttributeError(name)
        return lambda *args: self.op(self.OPS[name], *args)

    def font(self, name: str, size: float) -> ContentBuilder:
        return self.op("Tf", Name(name), size)

    def show(self, raw: bytes) -> ContentBuilder:
        return self.op("Tj", Str(raw))

    def draw(self, name: str) -> ContentBuilder:
        return self.op("Do", Name(name))

    def build(self) -> bytes:
        return serialize(self.instructions)


class Builder:
    """A new file. Objects are numbered as they come."""

    def __init__(self, version: str = "1.7"):
        self.version, self.objects = version, {}
        self.catalog, self.tree = self.add({"Type": Name("Catalog")}), self.add({"Type": Name("Pages"), "Kids": [], "Count": 0})
        self.objects[self.catalog.num]["Pages"] = self.tree
        self.trailer: dict = {"Root": self.catalog}
        self.font = None

    def add(self, value) -> Ref:
        ref = Ref(len(self.objects) + 1)
        self.objects[ref.num] = value
        return ref

    def default_font(self) -> Ref:
        if self.font is None:
            self.font = self.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
        return self.font

    def page(self, content: bytes | list[bytes], filters: list[str] = (), box=(0, 0, 612, 792), resources: dict | None = None, parent: Ref | None = None, **more) -> Ref:
        """A page of the given content streams; box None leaves it to an ancestor."""
        streams = []
        for own in content if isinstance(content, list) else [content]:
            d = {"Filter": [Name(f) for f in filters]} if filters else {}
            streams.append(self.add(Stream(d, encode(own, list(filters)))))
        up = parent or self.tree
        own = {"Type": Name("Page"), "Parent": up, "Contents": streams if isinstance(content, list) else streams[0], "Resources": resources if resources is not None else {"Font": {"F1": self.default_font()}}}
        if box is not None:
            own["MediaBox"] = list(box)
        ref = self.add(own | more)
        self._hang(up, ref)
        return ref

    def branch(self, parent: Ref | None = None, **more) -> Ref:
        """An inner node of the page tree."""
        up = parent or self.tree
        ref = self.add({"Type": Name("Pages"), "Kids": [], "Count": 0, "Parent": up} | more)
        self.objects[up.num]["Kids"].append(ref)
        return ref

    def _hang(self, up: Ref, ref: Ref) -> None:
        self.objects[up.num]["Kids"].append(ref)
        while up is not None:
            self.objects[up.num]["Count"] += 1
            up = self.objects[up.num].get("Parent")

    def info(self, **values: str) -> None:
        """Title, Author and so on."""
        raw = lambda v: Str(v.encode("latin-1") if all(ord(c) < 256 for c in v) else b"\xfe\xff" + v.encode("utf-16-be"))
        self.trailer["Info"] = self.add({k: raw(v) for k, v in values.items()})

    def build(self, packed: bool = False, encryption: tuple[str, str, str] | None = None) -> bytes:
        """packed: object streams and a cross-reference stream. encryption: scheme, user and owner password."""
        return write_file({n: (0, v) for n, v in self.objects.items()}, self.trailer, self.version, packed, encryption)


def file_id(said: dict[int, bytes]) -> bytes:
    """The same objects, as they are written, give the same id."""
    h = hashlib.md5()
    for n in sorted(said):
        h.update(str(n).encode())
        h.update(said[n])
    return h.digest()


def sealed(value, ref: Ref, security: Security):
    """value with its strings and stream encrypted."""

    def data(raw: bytes) -> bytes:
        if security.r >= 5:
            return aes_encrypt(security.key, raw, hashlib.md5(raw + str(ref).encode()).digest())
        key = object_key(security.key, ref, security.v == 4)
        return aes_encrypt(key, raw, hashlib.md5(raw + str(ref).encode()).digest()) if security.v == 4 else rc4(key, raw)

    if isinstance(value, bytes):
        return Str(data(bytes(value)))
    if isinstance(value, list):
        return [sealed(v, ref, security) for v in value]
    if isinstance(value, dict):
        return {k: sealed(v, ref, security) for k, v in value.items()}
    if isinstance(value, Stream):
        return Stream(sealed(value.dict, ref, security), data(value.raw))
    return value


def _table(offsets: dict[int, tuple[int, int]]) -> bytes:
    """A classic table of used objects: number to (offset, generation)."""
    out = [b"xref\n"]
    numbers = sorted(offsets)
    i = 0
    while i < len(numbers):
        j = i
        while j + 1 < len(numbers) and numbers[j + 1] == numbers[j] + 1:
            j += 1
        out.append(f"{numbers[i]} {j - i + 1}\n".encode())
        for n in numbers[i : j + 1]:
            offset, gen = offsets[n]
            out.append(b"%010d %05d %s \n" % (max(offset, 0), gen, b"f" if offset < 0 or n == 0 else b"n"))
        i = j + 1
    return b"".join(out)


#: Trailer keys that belong to how a file was stored, not to what it says.
STORED = ("Prev", "XRefStm", "Encrypt", "Type", "W", "Index", "Filter", "DecodeParms", "Length", "Size", "ID")


def write_file(objects: dict[int, tuple[int, object]], trailer: dict, version: str = "1.7", packed: bool = False, encryption: tuple[str, str, str] | None = None) -> bytes:
    """A whole file of objects: number to (generation, value)."""
    objects = dict(objects)
    own = {k: v for k, v in trailer.items() if k not in STORED}
    said = {n: write_value(value) for n, (_, value) in objects.items()}
    ident = file_id(said)
    security = seal = None
    if encryption:
        scheme, user, owner = encryption
        entries, security = make_encryption(scheme, user, owner, ident)
        seal = max(objects, default=0) + 1
        objects[seal] = (0, entries)
        own["Encrypt"] = Ref(seal)
    own["ID"] = [Str(ident), Str(ident)]
    out = bytearray(f"%PDF-{version}\n".encode() + b"%\xe2\xe3\xcf\xd3\n")
    places: dict[int, tuple[int, int]] = {0: (0, 65535)}
    inside: dict[int, tuple[int, int]] = {}
    boxed = [n for n in sorted(objects) if packed and objects[n][0] == 0 and not isinstance(objects[n][1], Stream) and n != seal]
    top = max(objects, default=0)
    streams: dict[int, Stream] = {}
    for k in range(0, len(boxed), 100):
        top += 1
        head, body = [], b""
        for i, n in enumerate(boxed[k : k + 100]):
            head.append(f"{n} {len(body)}")
            body += said[n] + b"\n"
            inside[n] = (top, i)
        first = " ".join(head).encode() + b"\n"
        streams[top] = Stream({"Type": Name("ObjStm"), "N": len(head), "First": len(first), "Filter": Name("FlateDecode")}, zlib.compress(first + body))
    for n, (gen, value) in [*sorted((n, o) for n, o in objects.items() if n not in inside), *((n, (0, s)) for n, s in streams.items())]:
        if security and n != seal:
            value = sealed(value, Ref(n, gen), security)
        places[n] = (len(out), gen)
        out += b"%d %d obj\n%b\nendobj\n" % (n, gen, said[n] if n in said and not security else write_value(value))
    start = len(out)
    if packed:
        top += 1
        rows = bytearray()
        for n in range(top + 1):
            if n in inside:
                rows += bytes([2]) + inside[n][0].to_bytes(4, "big") + inside[n][1].to_bytes(2, "big")
            elif n == top:
                rows += bytes([1]) + start.to_bytes(4, "big") + bytes(2)
            elif n in places and n:
                rows += bytes([1]) + places[n][0].to_bytes(4, "big") + places[n][1].to_bytes(2, "big")
            else:
                rows += bytes(5) + b"\xff\xff"
        table = Stream(own | {"Type": Name("XRef"), "Size": top + 1, "W": [1, 4, 2], "Filter": Name("FlateDecode")}, zlib.compress(bytes(rows)))
        out += f"{top} 0 obj\n".encode() + write_value(table) + b"\nendobj\n"
    else:
        out += _table(places) + b"trailer\n" + write_value(own | {"Size": top + 1}) + b"\n"
    return bytes(out + f"startxref\n{start}\n%%EOF\n".encode())


def append_revision(data: bytes, changed: dict[int, tuple[int, object]], freed: list[int], trailer: dict, previous: int, size: int) -> bytes:
    """data and a revision of the changed and freed objects only."""
    out = bytearray(data if data.endswith(b"\n") else data + b"\n")
    places: dict[int, tuple[int, int]] = {}
    for n, (gen, value) in sorted(changed.items()):
        places[n] = (len(out), gen)
        out += f"{n} {gen} obj\n".encode() + write_value(value) + b"\nendobj\n"
    for n in freed:
        places[n] = (-1, 1)
    start = len(out)
    own = {k: v for k, v in trailer.items() if k not in STORED or k == "ID"}
    out += _table(places) + b"trailer\n" + write_value(own | {"Size": max(size, *(n + 1 for n in places), 0), "Prev": previous}) + b"\n"
    return bytes(out + f"startxref\n{start}\n%%EOF\n".encode())
