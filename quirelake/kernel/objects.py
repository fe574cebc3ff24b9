"""The object model of page-description files, in plain Python values.

null, booleans, numbers, lists and dicts (keyed by plain strings) are Python's
own; names, strings, references and streams have the classes below.
"""

from __future__ import annotations

from dataclasses import dataclass, field


class Name(str):
    """A name, without its slash."""

    __slots__ = ()

    def __repr__(self) -> str:
        return f"/{str(self)}"


class Str(bytes):
    """A string's bytes."""


@dataclass(frozen=True, order=True, slots=True)
class Ref:
    num: int
    gen: int = 0

    def __str__(self) -> str:
        return f"{self.num} {self.gen}"


@dataclass
class Stream:
    dict: dict
    raw: bytes = b""
    decoded: bytes | None = field(default=None, compare=False)


class PdfError(Exception):
    """A file that can't be read; kind says why."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


Rect = tuple[float, float, float, float]
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def multiply(a: tuple, b: tuple) -> tuple:
    """a, then b (row vectors)."""
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3],
        a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def transform(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def shifted(m: tuple, x: float, y: float) -> tuple:
    """A shift, then m."""
    return m[0], m[1], m[2], m[3], x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def number(x, default: float = 0.0) -> float:
    """Soft cast: what is no number is the default."""
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else default


def numbers(x, n: int) -> tuple | None:
    """The first n items of a list if they are all numbers, else None."""
    if not isinstance(x, list) or len(x) < n or any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in x[:n]):
        return None
    return tuple(float(v) for v in x[:n])


def show_number(x: float) -> str:
    """Whole numbers without a point, others with six digits at most."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if float(x).is_integer():
        return str(int(x))
    return f"{x:.6f}".rstrip("0").rstrip(".")


def show_text(raw: bytes) -> str:
    """A text string: UTF-16 or UTF-8 with a byte-order mark, else Latin-1."""
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    if raw[:2] == b"\xff\xfe":
        return raw[2:].decode("utf-16-le", "replace")
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    return raw.decode("latin-1")


def plain(x, depth: int = 0):
    """A value of JSON: names get a slash, references are "n g", streams a summary, other strings are text."""
    if depth > 64:
        return None
    if isinstance(x, Name):
        return "/" + str(x)
    if isinstance(x, bytes):
        return show_text(x)
    if isinstance(x, Ref):
        return f"{x.num} {x.gen} R"
    if isinstance(x, Stream):
        return {"type": "stream", "dictionary": plain(x.dict, depth + 1), "dataLength": len(x.raw)}
    if isinstance(x, list):
        return [plain(v, depth + 1) for v in x]
    if isinstance(x, dict):
        return {str(k): plain(v, depth + 1) for k, v in x.items()}
    if isinstance(x, float) and x.is_integer():
        return int(x)
    return x


def kind_of(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    for kind, name in ((Name, "name"), (bytes, "string"), (Ref, "reference"), (Stream, "stream"), (list, "array"), (dict, "dictionary")):
        if isinstance(x, kind):
            return name
    return "number"
