"""Objects from bytes."""

from __future__ import annotations

import re
from functools import lru_cache

from .objects import Name, PdfError, Ref, Str, Stream

SPACE = b"\0\t\n\x0c\r "
DELIMITERS = b"()<>[]{}/%"
_SKIP = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*")
_NUMBER = re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d+)(?:-\d*)?")
_PLAIN = re.compile(rb"[^()\\\r]*")
_NAME_HEX = re.compile(rb"#([0-9A-Fa-f]{2})")
_ESCAPES = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}
DEEPEST = 100


class Keyword(bytes):
    """A bare word: an operator, or a word of the file's structure."""


#: What to_number is not needed for are whole numbers and decimals with a sign at most; strings without escapes or nesting are whole.
_W, _R = rb"\0\t\n\x0c\r ", rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]"
_END = rb"(?=[" + _W + rb"()<>\[\]{}/%]|\Z)"
_TOKEN = (
    rb"(?:[" + _W + rb"]++|%[^\r\n]*+)*+(?:/(" + _R + rb"*+)|([+-]?[0-9]++)" + _END + rb"|(" + _R + rb"++)|\(([^()\\\r]*+)\)|(<<)|<([0-9A-Fa-f]*+)>|(\[)|(>>|[)>\]}{])|([(<]))"
)
_NEXT = re.compile(_TOKEN)
_NEXT_REF = re.compile(_TOKEN.replace(rb"([+-]?[0-9]++)", rb"([0-9]++)[" + _W + rb"]++([0-9]++)[" + _W + rb"]++R(?!" + _R + rb")|([+-]?[0-9]++)", 1))
NAME, WHOLE, WORD, STRING, OPENS, HEX, LIST, MARK, OTHER = range(1, 10)
_DECIMAL = re.compile(rb"[+-]?(?:\d+\.\d*|\.\d+)")
_HEAD = re.compile(rb"(?:[" + _W + rb"]++|%[^\r\n]*+)*+([0-9]++)[" + _W + rb"]++([0-9]++)[" + _W + rb"]++obj(?!" + _R + rb")")
_LENGTH_HOLDS = re.compile(rb"\s*endstream")
_OCTAL = re.compile(rb"[0-7]{1,3}")
_STARTS_NUMBER = frozenset(b"0123456789+-.")
_CONSTANTS = {b"true": True, b"false": False, b"null": None}
#: Names and references are values that nothing changes: those seen are used again, up to so many.
KEPT = 4096
_NAMES: dict[bytes, Name] = {}


def to_number(token: bytes) -> int | float:
    sign = -1 if token.startswith(b"-") else 1
    body = token.lstrip(b"+-").split(b"-")[0]
    if b"." in body:
        return sign * float(body if body != b"." else b"0")
    return sign * int(body)


def name_of(raw: bytes) -> Name:
    """The name that raw, what follows the slash, stands for."""
    name = _NAMES.get(raw)
    if name is None:
        text = _NAME_HEX.sub(lambda m: bytes([int(m[1], 16)]), raw) if b"#" in raw else raw
        name = Name(text.decode("latin-1"))
        if len(_NAMES) < KEPT and len(raw) < 64:
            _NAMES[raw] = name
    return name


def word_of(word: bytes):
    """What a run of regular characters is: a number, a constant or a Keyword."""
    if word[0] in _STARTS_NUMBER:
        if _DECIMAL.fullmatch(word):
            return float(word)
        if _NUMBER.fullmatch(word):
            return to_number(word)
    return _CONSTANTS[word] if word in _CONSTANTS else Keyword(word)


@lru_cache(maxsize=KEPT)
def reference(num: int, gen: int) -> Ref:
    return Ref(num, gen)


#: Levels up to which _well_formed reads.
FLAT = 50


def _well_formed(data: bytes, pos: int) -> tuple[dict, int] | None:
    """The dictionary whose entries begin at pos and where it ends, without a call for each token.

    None for what has anything but pairs of names and values in it, or is nested deeply: Lexer reads that.
    """
    box, key, outer, match = {}, None, [], _NEXT_REF.match
    while m := match(data, pos):
        kind, pos = m.lastindex, m.end()
        if kind == NAME:
            raw = m[1]
            x = _NAMES.get(raw) or name_of(raw)
            if key is None and type(box) is dict:
                key = str(x)
                continue
        elif kind == 3:
            x = reference(int(m[2]), int(m[3]))
        elif kind == WHOLE + 2:
            x = int(m[4])
        elif kind == MARK + 2:
            mark, whole = m[10], type(box) is list
            if key is not None or mark != (b"]" if whole else b">>"):
                return None
            if not outer:
                return box, pos
            x = box
            box, key = outer.pop()
        elif kind in (OPENS + 2, LIST + 2):
            if len(outer) >= FLAT or key is None and type(box) is dict:
                return None
            outer.append((box, key))
            box, key = {} if kind == OPENS + 2 else [], None
            continue
        elif kind == STRING + 2:
            x = Str(m[6])
        elif kind == WORD + 2:
            x = word_of(m[5])
            if type(x) is Keyword:
                return None
        elif kind == HEX + 2:
            digits = m[8]
            x = Str(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        else:
            return None
        if type(box) is list:
            box.append(x)
        elif key is None:
            return None
        else:
            box[key] = x
            key = None
    return None


class Lexer:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def skip(self) -> None:
        self.pos = _SKIP.match(self.data, self.pos).end()

    def next(self, refs: bool = True, depth: int = 0):
        """The next object or Keyword; raises EOFError at the end."""
        m = (_NEXT_REF if refs else _NEXT).match(self.data, self.pos)
        if m is None:
            self.skip()
            raise EOFError
        if depth > DEEPEST:
            self.skip()
            raise PdfError("nesting", "objects are nested too deeply")
        kind = m.lastindex
        if refs and kind > NAME:
            if kind == 3:
                self.pos = m.end()
                return reference(int(m[2]), int(m[3]))
            kind -= 2
        self.pos = m.end()
        if kind == NAME:
            raw = m[1]
            return _NAMES.get(raw) or name_of(raw)
        if kind == WHOLE:
            return int(m[m.lastindex])
        if kind == WORD:
            return word_of(m[m.lastindex])
        if kind == STRING:
            return Str(m[m.lastindex])
        if kind == LIST:
            return self._list(refs, depth)
        if kind == MARK:
            return Keyword(m[m.lastindex])
        if kind == OPENS:
            if refs and not depth and (got := _well_formed(self.data, self.pos)):
                value, self.pos = got
                return value
            self.pos -= 2
            return self._dict(refs, depth)
        if kind == HEX:
            digits = m[m.lastindex]
            return Str(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        self.pos -= 1
        return self._literal() if self.data[self.pos] == 0x28 else self._hex()

    def _literal(self) -> Str:
        data, pos, depth, out = self.data, self.pos + 1, 1, []
        while pos < len(data):
            end = _PLAIN.match(data, pos).end()
            out.append(data[pos:end])
            pos = end
            if pos >= len(data):
                break
            c = data[pos]
            pos += 1
            if c == 0x28:
                depth += 1
                out.append(b"(")
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
                out.append(b")")
            elif c == 0x0D:
                out.append(b"\n")
                pos += data[pos : pos + 1] == b"\n"
            else:
                e = data[pos : pos + 1]
                if m := _OCTAL.match(data, pos):
                    out.append(bytes([int(m[0], 8) & 255]))
                    pos = m.end()
                elif e == b"\r":
                    pos += 2 if data[pos + 1 : pos + 2] == b"\n" else 1
                elif e == b"\n":
                    pos += 1
                elif e:
                    out.append(_ESCAPES.get(e[0], e))
                    pos += 1
        self.pos = pos
        return Str(b"".join(out))

    def _hex(self) -> Str:
        end = self.data.find(b">", self.pos)
        end = len(self.data) if end < 0 else end
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.pos + 1 : end])
        self.pos = end + 1
        return Str(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))

    def _list(self, refs: bool, depth: int) -> list:
        out = []
        while True:
            try:
                x = self.next(refs, depth + 1)
            except EOFError:
                return out
            if type(x) is Keyword:
                if x == b"]":
                    return out
                if x in (b"endobj", b"endstream", b">>"):
                    return out
                continue
            out.append(x)

    def _dict(self, refs: bool, depth: int) -> dict:
        self.pos += 2
        out: dict = {}
        while True:
            try:
                key = self.next(refs, depth + 1)
                if type(key) is Keyword:
                    if key in (b">>", b"endobj", b"stream"):
                        if key == b"stream":
                            self.pos -= 6
                        return out
                    continue
                if type(key) is not Name:
                    continue
                value = self.next(refs, depth + 1)
            except EOFError:
                return out
            if type(value) is Keyword:
                if value == b">>":
                    return out
                continue
            out[str(key)] = value

    def indirect(self, length_of=None) -> tuple[Ref, object]:
        """``n g obj ... endobj`` at the current place; length_of resolves a stream's indirect length."""
        if m := _HEAD.match(self.data, self.pos):
            num, gen, self.pos = int(m[1]), int(m[2]), m.end()
        else:
            num, gen, word = self.next(False), self.next(False), self.next(False)
            if not isinstance(num, int) or not isinstance(gen, int) or word != b"obj":
                raise PdfError("object", f"no object at {self.pos}")
        value = self.next()
        if isinstance(value, Keyword):
            value = None
        if isinstance(value, dict):
            self.skip()
            if self.data.startswith(b"stream", self.pos):
                value = self._stream(value, length_of)
        return reference(num, gen), value

    def _stream(self, value: dict, length_of) -> Stream:
        start = self.pos + 6
        if self.data.startswith(b"\r\n", start):
            start += 2
        elif self.data[start : start + 1] in (b"\n", b"\r"):
            start += 1
        length = value.get("Length")
        if isinstance(length, Ref):
            length = length_of(length) if length_of else None
        if isinstance(length, int) and 0 <= length <= len(self.data) - start and _LENGTH_HOLDS.match(self.data, start + length):
            end = start + length
        else:
            end = self.data.find(b"endstream", start)
            end = len(self.data) if end < 0 else end
            if self.data[end - 2 : end] == b"\r\n":
                end -= 2
            elif end > start and self.data[end - 1 : end] in (b"\n", b"\r"):
                end -= 1
        self.pos = end
        return Stream(value, self.data[start:end])
