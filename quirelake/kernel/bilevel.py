"""JBIG2 pages of generic regions, coded arithmetically or as fax rows. Other kinds of segment are an error, not a guess."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .fax import decode_fax
from .objects import PdfError

#: States of the arithmetic coder: probability, next state after the likelier and after the other symbol, and whether the likelier one changes. Fixed by the standard.
STATES = [
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0),
    (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0),
    (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
]
#: Pixels of a context by template as (dx, dy), most significant first; None marks an adaptive one, in order. Fixed by the standard.
TEMPLATES = [
    [None, (-1, -2), (0, -2), (1, -2), None, None, (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), None, (-4, 0), (-3, 0), (-2, 0), (-1, 0)],
    [(-1, -2), (0, -2), (1, -2), (2, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), (2, -1), None, (-3, 0), (-2, 0), (-1, 0)],
    [(-1, -2), (0, -2), (1, -2), (-2, -1), (-1, -1), (0, -1), (1, -1), None, (-2, 0), (-1, 0)],
    [(-3, -1), (-2, -1), (-1, -1), (0, -1), (1, -1), None, (-4, 0), (-3, 0), (-2, 0), (-1, 0)],
]
#: Which adaptive pixel stands at each None of template 0.
ADAPTIVE_ORDER = [[3, 2, 1, 0], [0], [0], [0]]
#: Contexts of the pixel that says that a row repeats the one above.
REPEAT = (0x9B25, 0x0795, 0x00E5, 0x0195)
UNKNOWN_HEIGHT, LARGEST_PIXELS = 0xFFFFFFFF, 1 << 26


class Arithmetic:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.code, self.left, self.span = self._byte(0) << 16, 0, 0x8000
        self._more()
        self.code = self.code << 7 & 0xFFFFFFFF
        self.left -= 7

    def _byte(self, i: int) -> int:
        return self.data[i] if i < len(self.data) else 0xFF

    def _more(self) -> None:
        if self._byte(self.at) == 0xFF:
            if self._byte(self.at + 1) > 0x8F:
                self.code += 0xFF00
                self.left = 8
            else:
                self.at += 1
                self.code += self._byte(self.at) << 9
                self.left = 7
        else:
            self.at += 1
            self.code += self._byte(self.at) << 8
            self.left = 8

    def bit(self, contexts: list, k: int) -> int:
        """contexts[k] is (state, likelier symbol)."""
        state, likely = contexts[k]
        p, more, less, swap = STATES[state]
        self.span -= p
        if self.code >> 16 < p:
            out = likely if self.span < p else 1 - likely
            rare = self.span >= p
            self.span = p
        else:
            self.code -= p << 16
            if self.span & 0x8000:
                return likely
            rare = self.span < p
            out = 1 - likely if rare else likely
        contexts[k] = (less, 1 - likely if swap else likely) if rare else (more, likely)
        while not self.span & 0x8000:
            if not self.left:
                self._more()
            self.span <<= 1
            self.code = self.code << 1 & 0xFFFFFFFF
            self.left -= 1
        return out


def context_pixels(template: int, adaptive: list[tuple[int, int]]) -> list[tuple[int, int]]:
    order = iter(ADAPTIVE_ORDER[template])
    return [p if p is not None else adaptive[next(order)] for p in TEMPLATES[template]]


def generic(data: bytes, width: int, height: int, template: int, adaptive: list[tuple[int, int]], typical: bool) -> np.ndarray:
    """A region's pixels (height x width, 1 black)."""
    coder, pixels = Arithmetic(data), context_pixels(template, adaptive)
    contexts = [(0, 0)] * (1 << len(pixels))
    pad = 130
    rows = [bytearray(width + 2 * pad) for _ in range(height)]
    blank, repeats = bytearray(width + 2 * pad), False
    for y in range(height):
        if typical:
            repeats ^= bool(coder.bit(contexts, REPEAT[template]))
            if repeats:
                rows[y][:] = rows[y - 1] if y else blank
                continue
        sources = [(rows[y + dy] if y + dy >= 0 else blank, pad + dx) for dx, dy in pixels]
        now = rows[y]
        for x in range(width):
            k = 0
            for row, shift in sources:
                k = k << 1 | row[x + shift]
            now[x + pad] = coder.bit(contexts, k)
    return np.array([np.frombuffer(r, np.uint8)[pad : pad + width] for r in rows], np.uint8).reshape(height, width)


@dataclass
class Segment:
    number: int
    kind: int
    data: bytes


def segments(data: bytes) -> list[Segment]:
    """Of an embedded stream: no file header, each header followed by its data."""
    out, at = [], 0
    while at + 11 <= len(data):
        number, flags = int.from_bytes(data[at : at + 4], "big"), data[at + 4]
        at += 5
        count = data[at] >> 5
        if count == 7:
            count = int.from_bytes(data[at : at + 4], "big") & 0x1FFFFFFF
            at += 4 + (count + 8) // 8
        else:
            at += 1
        at += count * (1 if number <= 256 else 2 if number <= 65536 else 4) + (4 if flags & 0x40 else 1)
        length = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if length == 0xFFFFFFFF:
            length = len(data) - at
        out.append(Segment(number, flags & 63, data[at : at + length]))
        at += length
    return out


def _combine(page: np.ndarray, region: np.ndarray, x: int, y: int, op: int) -> None:
    h, w = min(region.shape[0], page.shape[0] - y), min(region.shape[1], page.shape[1] - x)
    if h <= 0 or w <= 0 or x < 0 or y < 0:
        return
    own, new = page[y : y + h, x : x + w], region[:h, :w]
    own[:] = (own | new, own & new, own ^ new, 1 - (own ^ new), new)[op if op < 5 else 0]


def decode_bilevel(data: bytes, globals_: bytes = b"") -> bytes:
    """Packed rows of a page, 0 black as image samples have it."""
    page = None
    for s in [*segments(globals_), *segments(data)]:
        d = s.data
        number = lambda i, n=4: int.from_bytes(d[i : i + n], "big")  # noqa: E731, B023
        if s.kind == 48:
            width, height = number(0), number(4)
            if height == UNKNOWN_HEIGHT:
                height = 1000
            if width * height > LARGEST_PIXELS:
                raise PdfError("size", "a bilevel page is too large")
            page = np.full((height, width), d[16] >> 2 & 1, np.uint8)
        elif s.kind in (36, 38, 39):
            width, height, x, y, op, flags = number(0), number(4), number(8), number(12), d[16] & 7, d[17]
            if width * height > LARGEST_PIXELS or page is None:
                raise PdfError("size", "a bilevel region is too large or has no page")
            if flags & 1:
                raw = decode_fax(d[18:], {"K": -1, "Columns": width, "Rows": height, "BlackIs1": True})
                region = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(height, -1), axis=1)[:, :width]
            else:
                template, at = flags >> 1 & 3, 18
                n = 4 if template == 0 else 1
                signed = lambda b: b - 256 if b > 127 else b
                adaptive = [(signed(d[at + 2 * i]), signed(d[at + 2 * i + 1])) for i in range(n)]
                region = generic(d[at + 2 * n :], width, height, template, adaptive, bool(flags >> 3 & 1))
            _combine(page, region, x, y, op)
        elif s.kind in (49, 50, 51, 52, 62):
            continue
        else:
            raise PdfError("filter", f"unsupported bilevel segment of kind {s.kind}")
    if page is None:
        raise PdfError("filter", "a bilevel image has no page")
    return np.packbits(1 - page, axis=1).tobytes()
