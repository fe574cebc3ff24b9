"""Fonts as codecs: codes to text, text to codes, and widths."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .encodings import glyph, private_use, table
from .lexer import Keyword, Lexer
from .objects import Name, PdfError, Ref, Stream, number

#: Character collections and the Python codec of the legacy encodings over them.
CODECS = {"GBK": "gbk", "GBKp": "gbk", "GBK2K": "gb18030", "GB": "gb2312", "B5pc": "big5", "ETen": "big5", "ETenms": "big5", "HKscs": "big5hkscs", "90ms": "cp932", "90msp": "cp932", "90pv": "shift_jis", "83pv": "shift_jis", "EUC": "euc_jp", "KSC": "euc_kr", "KSCms": "cp949", "KSCpc": "euc_kr", "UniGB": "utf-16-be", "UniCNS": "utf-16-be", "UniJIS": "utf-16-be", "UniKS": "utf-16-be"}
CJK_ORDERINGS = ("GB1", "CNS1", "Japan1", "Korea1", "KR")


@dataclass
class CMap:
    """Codes to text or to character ids, with the code spaces that say how long a code is."""

    spaces: list[tuple[bytes, bytes]] = field(default_factory=list)
    text: dict[bytes, str] = field(default_factory=dict)
    cid: dict[bytes, int] = field(default_factory=dict)
    cid_ranges: list[tuple[bytes, bytes, int]] = field(default_factory=list)
    notdef: list[tuple[bytes, bytes, int]] = field(default_factory=list)
    base: CMap | None = None
    vertical: bool = False
    codec: str | None = None

    def fits(self, code: bytes) -> bool:
        """Whether code lies in a code space, byte by byte."""
        return any(len(lo) == len(code) and all(a <= c <= b for a, c, b in zip(lo, code, hi, strict=True)) for lo, hi in self.spaces) or bool(self.base and self.base.fits(code))

    def lengths(self) -> list[int]:
        own = {len(lo) for lo, _ in self.spaces} | {len(c) for c in self.text} | {len(c) for c in self.cid}
        return sorted(own | set(self.base.lengths() if self.base else ()), reverse=True) or [1]

    def split(self, raw: bytes) -> list[bytes]:
        """Codes of a string: the longest that a code space or a mapping has, else one of the shortest length."""
        out, i, lengths = [], 0, self.lengths()
        if len(lengths) == 1:
            n = lengths[0]
            return [raw[i : i + n] for i in range(0, len(raw), n)]
        known: dict[bytes, bool] = {}
        while i < len(raw):
            for n in lengths:
                code = raw[i : i + n]
                there = known.get(code)
                if there is None:
                    there = known[code] = code in self.text or code in self.cid or self.fits(code)
                if there and len(code) == n:
                    break
            else:
                n = lengths[-1]
                code = raw[i : i + n]
            out.append(code)
            i += len(code)
        return out

    def text_of(self, code: bytes) -> str | None:
        got = self.text.get(code)
        return got if got is not None or self.base is None else self.base.text_of(code)

    def cid_of(self, code: bytes) -> int | None:
        if code in self.cid:
            return self.cid[code]
        for lo, hi, first in self.cid_ranges:
            if len(lo) == len(code) and lo <= code <= hi:
                return first + int.from_bytes(code, "big") - int.from_bytes(lo, "big")
        got = self.base.cid_of(code) if self.base else None
        if got is None:
            got = next((cid for lo, hi, cid in self.notdef if len(lo) == len(code) and lo <= code <= hi), None)
        return got


def utf16(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace") if len(raw) % 2 == 0 else raw.decode("latin-1")


def parse_cmap(data: bytes, named=None) -> CMap:
    """A CMap program. named: gives the CMap that usecmap names."""
    out, lexer, stack = CMap(), Lexer(data), []
    while True:
        try:
            x = lexer.next(False)
        except EOFError:
            return out
        except PdfError:
            continue
        if not isinstance(x, Keyword):
            stack.append(x)
            continue
        word = x.decode("latin-1")
        if word == "usecmap" and stack and isinstance(stack[-1], Name):
            out.base = (named or predefined)(str(stack[-1]))
        elif word == "def" and len(stack) >= 2 and stack[-2] == "WMode":
            out.vertical = stack[-1] == 1
        elif word == "endcodespacerange":
            out.spaces += [(lo, hi) for lo, hi in zip(stack[::2], stack[1::2], strict=False) if isinstance(lo, bytes) and isinstance(hi, bytes)]
        elif word == "endbfchar":
            for code, to in zip(stack[::2], stack[1::2], strict=False):
                if isinstance(code, bytes):
                    out.text[bytes(code)] = utf16(to) if isinstance(to, bytes) else glyph(str(to)) or ""
        elif word == "endbfrange":
            for lo, hi, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                if not (isinstance(lo, bytes) and isinstance(hi, bytes)):
                    continue
                first, n = int.from_bytes(lo, "big"), min(int.from_bytes(hi, "big") - int.from_bytes(lo, "big"), 0xFFFF)
                for i in range(n + 1):
                    if isinstance(to, list):
                        if i >= len(to):
                            break
                        text = utf16(to[i]) if isinstance(to[i], bytes) else glyph(str(to[i])) or ""
                    else:
                        last = int.from_bytes(to[-2:], "big") + i
                        text = utf16(bytes(to[:-2]) + (last & 0xFFFF).to_bytes(min(2, max(1, len(to))), "big")) if isinstance(to, bytes) and to else ""
                    out.text[(first + i).to_bytes(len(lo), "big")] = text
        elif word == "endcidchar":
            out.cid |= {bytes(c): int(v) for c, v in zip(stack[::2], stack[1::2], strict=False) if isinstance(c, bytes) and isinstance(v, int)}
        elif word in ("endcidrange", "endnotdefrange"):
            rows = [(bytes(lo), bytes(hi), v) for lo, hi, v in zip(stack[::3], stack[1::3], stack[2::3], strict=False) if isinstance(lo, bytes) and isinstance(v, int)]
            if word == "endcidrange":
                out.cid_ranges += rows
            else:
                out.notdef += rows
        elif word == "endnotdefchar":
            out.notdef += [(bytes(c), bytes(c), v) for c, v in zip(stack[::2], stack[1::2], strict=False) if isinstance(c, bytes) and isinstance(v, int)]
        stack = []


def predefined(name: str) -> CMap | None:
    """Identity and legacy CMaps by name; those with a codec give text, no character ids."""
    vertical = name.endswith("-V") or name == "V"
    if name.startswith("Identity"):
        return CMap([(b"\0\0", b"\xff\xff")], cid_ranges=[(b"\0\0", b"\xff\xff", 0)], vertical=vertical)
    codec = CODECS.get(name.split("-")[0])
    if codec is None:
        return None
    if name.startswith("GBpc"):
        codec = "gbk"
    spaces = [(b"\0\0", b"\xff\xff")] if codec.startswith("utf-16") else [(b"\0", b"\x80"), (b"\x81\x40", b"\xfe\xfe"), *([(b"\xa1", b"\xdf")] if codec in ("cp932", "shift_jis") else [])]
    if codec in ("cp932", "shift_jis"):
        spaces[1:2] = [(b"\x81\x40", b"\x9f\xfc"), (b"\xe0\x40", b"\xfc\xfc")]
    return CMap(spaces, vertical=vertical, codec=codec)


@dataclass
class Font:
    subtype: str = "Type1"
    base: str = ""
    encoding: str = ""
    codes: dict[int, str] = field(default_factory=dict)  # of a simple font
    widths: dict[int, float] = field(default_factory=dict)
    default_width: float = 0.0
    cmap: CMap | None = None
    to_unicode: CMap | None = None
    ordering: str = ""
    embedded: str | None = None
    texts: dict[bytes, str] = field(default_factory=dict, repr=False, compare=False)  # of the codes that were met

    @property
    def composite(self) -> bool:
        return self.subtype == "Type0"

    def split(self, raw: bytes) -> list[bytes]:
        if self.composite:
            return (self.cmap or self.to_unicode or CMap([(b"\0\0", b"\xff\xff")])).split(raw)
        return [raw[i : i + 1] for i in range(len(raw))]

    def text_of(self, code: bytes) -> str:
        if self.to_unicode is not None and (got := self.to_unicode.text_of(code)) is not None:
            return got
        if not self.composite:
            return private_use(self.codes.get(code[0], chr(code[0])))
        if self.cmap is not None and self.cmap.codec:
            return code.decode(self.cmap.codec, "replace")
        if self.cmap is not None and (got := self.cmap.text_of(code)) is not None:
            return got
        return chr(int.from_bytes(code, "big")) if len(code) <= 2 else ""

    def decode(self, raw: bytes) -> str:
        return self.said(self.split(raw))

    def said(self, codes: list[bytes]) -> str:
        """The text of codes; that of each is found once."""
        texts = self.texts
        try:
            return "".join([texts[c] for c in codes])
        except KeyError:
            texts |= {c: self.text_of(c) for c in set(codes) if c not in texts}
            return "".join([texts[c] for c in codes])

    def encode(self, text: str) -> bytes | None:
        """Codes for a text; None if the font has none for a character of it."""
        back: dict[str, bytes] = {}
        if not self.composite:
            back = {c: bytes([b]) for b, c in sorted(self.codes.items(), reverse=True)}
        if self.to_unicode is not None:
            back |= {t: c for c, t in sorted(self.to_unicode.text.items(), reverse=True) if t}
        out, i = [], 0
        most = max(map(len, back), default=1)
        while i < len(text):
            for n in range(min(most, len(text) - i), 0, -1):
                if (code := back.get(text[i : i + n])) is not None:
                    break
            else:
                n, c = 1, text[i]
                if self.composite and self.cmap is not None and self.cmap.codec:
                    try:
                        code = c.encode(self.cmap.codec)
                    except UnicodeEncodeError:
                        return None
                elif self.composite and self.to_unicode is None and ord(c) < 0x10000:
                    code = ord(c).to_bytes(2, "big")
                elif not self.composite and not self.codes and ord(c) < 256:
                    code = bytes([ord(c)])
                else:
                    return None
            out.append(code)
            i += n
        return b"".join(out)

    def width(self, code: bytes) -> float:
        """In thousandths of the font size."""
        if self.composite:
            cid = self.cmap.cid_of(code) if self.cmap else None
            return self.widths.get(int.from_bytes(code, "big") if cid is None else cid, self.default_width)
        return self.widths.get(code[0], self.default_width)


def is_cjk(ordering: str) -> bool:
    return ordering in CJK_ORDERINGS


def _cid_widths(items: list, get) -> dict[int, float]:
    out: dict[int, float] = {}
    i = 0
    while i + 1 < len(items):
        first, then = get(items[i]), get(items[i + 1])
        if isinstance(then, list):
            out |= {int(first) + k: number(get(w)) for k, w in enumerate(then)}
            i += 2
        elif i + 2 < len(items):
            w = number(get(items[i + 2]))
            out |= {k: w for k in range(int(first), min(int(then), int(first) + 0xFFFF) + 1)}
            i += 3
        else:
            break
    return out


def read_font(doc, x) -> Font:
    """A font dictionary as a codec."""
    get, d = doc.get, doc.dict_of(x)
    font = Font(str(get(d.get("Subtype")) or "Type1"), str(get(d.get("BaseFont")) or ""))
    stream = get(d.get("ToUnicode"))
    if isinstance(stream, Stream):
        font.to_unicode = parse_cmap(doc.content(stream))
    described = d
    if font.composite:
        encoding = get(d.get("Encoding"))
        if isinstance(encoding, Stream):
            font.cmap = parse_cmap(doc.content(encoding))
            font.encoding = str(encoding.dict.get("CMapName", "stream"))
        else:
            font.encoding = str(encoding or "Identity-H")
            font.cmap = predefined(font.encoding) or predefined("Identity-H")
        kids = get(d.get("DescendantFonts"))
        described = doc.dict_of(kids[0]) if isinstance(kids, list) and kids else {}
        info = doc.dict_of(described.get("CIDSystemInfo"))
        ordering = get(info.get("Ordering"))
        font.ordering = bytes(ordering).decode("latin-1") if isinstance(ordering, bytes) else ""
        font.default_width = number(get(described.get("DW")), 1000.0)
        items = get(described.get("W"))
        font.widths = _cid_widths(items, get) if isinstance(items, list) else {}
    else:
        encoding = get(d.get("Encoding"))
        named = str(encoding) if isinstance(encoding, Name) else str(get(encoding.get("BaseEncoding")) or "") if isinstance(encoding, dict) else ""
        own = {"Symbol": "Symbol", "ZapfDingbats": "ZapfDingbats"}.get(font.base.split("+")[-1])
        font.encoding = own or named or "StandardEncoding"
        font.codes = dict(table(font.encoding))
        if isinstance(encoding, dict):
            code = 0
            for item in get(encoding.get("Differences")) or []:
                item = get(item)
                if isinstance(item, Name):
                    if (text := glyph(str(item))) is not None:
                        font.codes[code] = text
                    code += 1
                elif isinstance(item, (int, float)):
                    code = int(item)
        first, widths = get(d.get("FirstChar")), get(d.get("Widths"))
        if isinstance(first, int) and isinstance(widths, list):
            font.widths = {first + i: number(get(w)) for i, w in enumerate(widths)}
        descriptor = doc.dict_of(d.get("FontDescriptor"))
        font.default_width = number(get(descriptor.get("MissingWidth")), 0.0 if font.widths else 500.0)
    descriptor = doc.dict_of(described.get("FontDescriptor"))
    font.embedded = next((k for k in ("FontFile", "FontFile2", "FontFile3") if isinstance(get(descriptor.get(k)), Stream)), None)
    return font


def _kept_font(doc, x) -> Font:
    """read_font, once for each object of a file as long as that is what it is."""
    own = doc.get(x)
    if not isinstance(x, Ref) or own is None:
        return read_font(doc, x)
    kept = doc.fonts.get(x.num)
    if kept is None or kept[0] is not own:
        kept = doc.fonts[x.num] = (own, read_font(doc, x))
    return kept[1]


def page_fonts(doc, page) -> dict[str, Font]:
    fonts = doc.dict_of(doc.resources(page).get("Font"))
    return {k: _kept_font(doc, v) for k, v in fonts.items()}


#: Scripts in the order in which a name is tried. Fixed values.
SCRIPT_MARKS = {"japanese": ("mincho", "gothic", "japan", "kozuka", "hiragino", "meiryo", "ryumin"), "korean": ("batang", "gulim", "dotum", "malgun", "korea", "myeongjo"), "traditional_chinese": ("mingliu", "pmingliu", "cns1", "msjh", "kaiu"), "simplified_chinese": ("simsun", "simhei", "song", "heiti", "kaiti", "fangsong", "yahei", "gb1")}


def script_of(font_name: str) -> str | None:
    low = re.sub(r"[^a-z0-9]", "", font_name.lower())
    return next((script for script, marks in SCRIPT_MARKS.items() if any(m in low for m in marks)), None)
