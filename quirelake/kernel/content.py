"""Content streams as lists of instructions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from .lexer import _NEXT, DELIMITERS, HEX, KEPT, LIST, MARK, NAME, SPACE, STRING, WHOLE, WORD, Keyword, Lexer, name_of, word_of
from .objects import Name, PdfError, Ref, Str, Stream, show_number

#: Operators with their category and operand count (-1: any). Operators and counts are fixed by the file format.
OPERATORS: dict[str, tuple[str, int]] = {
    "q": ("graphics_state", 0),
    "Q": ("graphics_state", 0),
    "cm": ("graphics_state", 6),
    "w": ("graphics_state", 1),
    "J": ("graphics_state", 1),
    "j": ("graphics_state", 1),
    "M": ("graphics_state", 1),
    "d": ("graphics_state", 2),
    "ri": ("graphics_state", 1),
    "i": ("graphics_state", 1),
    "gs": ("graphics_state", 1),
    "m": ("path_construction", 2),
    "l": ("path_construction", 2),
    "c": ("path_construction", 6),
    "v": ("path_construction", 4),
    "y": ("path_construction", 4),
    "h": ("path_construction", 0),
    "re": ("path_construction", 4),
    "S": ("path_painting", 0),
    "s": ("path_painting", 0),
    "f": ("path_painting", 0),
    "F": ("path_painting", 0),
    "f*": ("path_painting", 0),
    "B": ("path_painting", 0),
    "B*": ("path_painting", 0),
    "b": ("path_painting", 0),
    "b*": ("path_painting", 0),
    "n": ("path_painting", 0),
    "W": ("clipping_path", 0),
    "W*": ("clipping_path", 0),
    "BT": ("text_object", 0),
    "ET": ("text_object", 0),
    "Tc": ("text_state", 1),
    "Tw": ("text_state", 1),
    "Tz": ("text_state", 1),
    "TL": ("text_state", 1),
    "Tf": ("text_state", 2),
    "Tr": ("text_state", 1),
    "Ts": ("text_state", 1),
    "Td": ("text_positioning", 2),
    "TD": ("text_positioning", 2),
    "Tm": ("text_positioning", 6),
    "T*": ("text_positioning", 0),
    "Tj": ("text_showing", 1),
    "TJ": ("text_showing", 1),
    "'": ("text_showing", 1),
    '"': ("text_showing", 3),
    "CS": ("color", 1),
    "cs": ("color", 1),
    "SC": ("color", -1),
    "SCN": ("color", -1),
    "sc": ("color", -1),
    "scn": ("color", -1),
    "G": ("color", 1),
    "g": ("color", 1),
    "RG": ("color", 3),
    "rg": ("color", 3),
    "K": ("color", 4),
    "k": ("color", 4),
    "sh": ("shading", 1),
    "Do": ("external_object", 1),
    "BI": ("inline_image", 0),
    "ID": ("inline_image", 0),
    "EI": ("inline_image", 0),
    "MP": ("marked_content", 1),
    "DP": ("marked_content", 2),
    "BMC": ("marked_content", 1),
    "BDC": ("marked_content", 2),
    "EMC": ("marked_content", 0),
    "BX": ("compatibility", 0),
    "EX": ("compatibility", 0),
}

#: Abbreviations in inline images: keys, and names as values. Fixed by the file format.
INLINE_KEYS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "L": "Length", "W": "Width"}
INLINE_VALUES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}


@dataclass(slots=True)
class Instruction:
    op: str
    args: list = field(default_factory=list)


def _inline(lexer: Lexer) -> Instruction:
    """An inline image, from after BI to EI, as one instruction with a stream."""
    own: dict = {}
    while True:
        key = lexer.next(False)
        if isinstance(key, Keyword):
            if key == b"ID":
                break
            continue
        if not isinstance(key, Name):
            continue
        value = lexer.next(False)
        name = INLINE_KEYS.get(str(key), str(key))
        if name == "ColorSpace" and isinstance(value, Name):
            value = Name(INLINE_VALUES.get(str(value), str(value)))
        own[name] = value
    start = lexer.pos + 1
    length = own.get("Length")
    if not isinstance(length, int):
        length = None
        if "Filter" not in own and isinstance(own.get("Width"), int) and isinstance(own.get("Height"), int):
            parts = {"DeviceRGB": 3, "DeviceCMYK": 4}.get(str(own.get("ColorSpace")), 1)
            bits = 1 if own.get("ImageMask") else int(own.get("BitsPerComponent", 8))
            length = (own["Width"] * parts * bits + 7) // 8 * own["Height"]
    end = re.compile(rb"[\0\t\n\x0c\r ]?EI(?=[\0\t\n\x0c\r ]|$)")
    m = end.match(lexer.data, start + length) if length is not None else None
    m = m or end.search(lexer.data, start)
    stop = m.start() if m else len(lexer.data)
    lexer.pos = m.end() if m else len(lexer.data)
    return Instruction("BI", [Stream(own, lexer.data[start:stop])])


def _plain_list(data: bytes, pos: int) -> tuple[list, int] | None:
    """The items from pos to the end of an array, and where that is; None if any is more than a number, a name or a short string."""
    items, match = [], _NEXT.match
    while m := match(data, pos):
        kind, pos = m.lastindex, m.end()
        if kind == STRING:
            items.append(Str(m[STRING]))
        elif kind == WHOLE:
            items.append(int(m[WHOLE]))
        elif kind == NAME:
            items.append(name_of(m[NAME]))
        elif kind == WORD and type(x := word_of(m[WORD])) is not Keyword:
            items.append(x)
        else:
            return (items, pos) if kind == MARK and m[MARK] == b"]" else None
    return None


def parse_content(data: bytes) -> list[Instruction]:
    lexer, args, out = Lexer(data), [], []
    pos, match = 0, _NEXT.match
    while True:
        m = match(data, pos)
        if m is None:
            return out
        kind, pos = m.lastindex, m.end()
        if kind == WHOLE:
            args.append(int(m[WHOLE]))
            continue
        if kind == NAME:
            args.append(name_of(m[NAME]))
            continue
        if kind == STRING:
            args.append(Str(m[STRING]))
            continue
        if kind == WORD:
            word = m[WORD]
            op = _KNOWN.get(word)
            if op is not None:
                out.append(Instruction(op, args))
                args = []
                continue
            x = word_of(word)
        elif kind == LIST and (got := _plain_list(data, pos)) is not None:
            x, pos = got
        else:
            # Lists, dictionaries and strings of other kinds; a mark alone takes away what came before it.
            lexer.pos = m.start(kind) - (kind == HEX)
            try:
                x = lexer.next(False)
            except PdfError:
                args, pos = [], lexer.pos
                continue
            pos = lexer.pos
        if type(x) is not Keyword:
            args.append(x)
            continue
        if x == b"BI":
            lexer.pos = pos
            try:
                out.append(_inline(lexer))
            except EOFError:
                return out
            except PdfError:
                pass
            pos = lexer.pos
        elif x[0] not in DELIMITERS:
            out.append(Instruction(x.decode("latin-1"), args))
        args = []


@lru_cache(maxsize=KEPT)
def escape_name(name: str) -> str:
    return "".join(c if 33 <= ord(c) <= 126 and c not in "#()<>[]{}/%" else f"#{ord(c) & 255:02X}" for c in name)


_ESCAPED = {ord("("): b"\\(", ord(")"): b"\\)", ord("\\"): b"\\\\", 10: b"\\n", 13: b"\\r", 9: b"\\t", 8: b"\\b", 12: b"\\f"}
_TO_ESCAPE = re.compile(rb"[()\\\n\r\t\x08\x0c]")
_PRINTABLE = bytes(range(32, 127))


def literal(raw: bytes) -> bytes:
    """A string in parentheses; mostly unprintable ones in hex."""
    if len(raw.translate(None, _PRINTABLE)) * 2 > len(raw):
        return b"<" + raw.hex().upper().encode() + b">"
    return b"(" + _TO_ESCAPE.sub(lambda m: _ESCAPED[m[0][0]], raw) + b")"


#: Operators by their bytes; of an inline image, what follows BI is no operand.
_KNOWN = {op.encode("latin-1"): op for op in OPERATORS if op != "BI"}


@lru_cache(maxsize=KEPT)
def _written_name(name: str) -> bytes:
    return b"/" + escape_name(name).encode()


def write_value(x) -> bytes:
    """A value in the file's syntax."""
    if type(x) is int:
        return b"%d" % x
    if type(x) is Name:
        return _written_name(x)
    if type(x) is Ref:
        return b"%d %d R" % (x.num, x.gen)
    if x is None:
        return b"null"
    if isinstance(x, (bool, int, float)):
        return show_number(x).encode()
    if isinstance(x, str):
        return _written_name(x)
    if isinstance(x, bytes):
        return literal(x)
    if isinstance(x, (list, tuple)):
        return b"[" + b" ".join(map(write_value, x)) + b"]"
    if isinstance(x, dict):
        return b"<<" + b"".join([b"%b %b\n" % (_written_name(k), write_value(v)) for k, v in x.items()]) + b">>"
    if isinstance(x, Stream):
        return write_value(x.dict | {"Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
    if isinstance(x, Ref):
        return b"%d %d R" % (x.num, x.gen)
    raise TypeError(f"no object of a file: {type(x)}")


def serialize(instructions: list[Instruction]) -> bytes:
    """Content of instructions, one to a line."""
    lines = []
    for i in instructions:
        if i.op == "BI" and i.args and isinstance(i.args[0], Stream):
            own = b" ".join(b"/" + escape_name(k).encode() + b" " + write_value(v) for k, v in i.args[0].dict.items())
            lines.append(b"BI " + own + b" ID " + i.args[0].raw + b" EI")
        else:
            lines.append(b" ".join([*map(write_value, i.args), i.op.encode("latin-1")]))
    return b"\n".join(lines)


def is_space(byte: int) -> bool:
    return byte in SPACE
