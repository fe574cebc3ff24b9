"""CCITT fax decoding: Group 3 in one and two dimensions, and Group 4."""

from __future__ import annotations

from functools import lru_cache

from .objects import PdfError

#: Codes of run lengths, as bit strings: 0 to 63, then the make-up codes 64, 128, ... 1728. Fixed by the standard.
WHITE = "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
WHITE_MAKEUP = "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
BLACK = "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
BLACK_MAKEUP = "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
#: Make-up codes 1792, 1856, ... 2560 of both colours.
LONG_MAKEUP = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111"
#: Modes of two-dimensional rows: pass, horizontal, and the vertical offsets.
MODES = {"0001": "pass", "001": "horizontal", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}
END_OF_LINE = "000000000001"
LARGEST_SIDE = 1 << 16


@lru_cache(maxsize=None)
def run_codes(black: bool) -> dict[tuple[int, int], int]:
    """Run lengths by (bits, value)."""
    short, makeup = (BLACK, BLACK_MAKEUP) if black else (WHITE, WHITE_MAKEUP)
    rows = [(c, i) for i, c in enumerate(short.split())]
    rows += [(c, 64 * (i + 1)) for i, c in enumerate(makeup.split())]
    rows += [(c, 1792 + 64 * i) for i, c in enumerate(LONG_MAKEUP.split())]
    return {(len(c), int(c, 2)): n for c, n in rows}


MODE_CODES = {(len(c), int(c, 2)): m for c, m in MODES.items()}


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.n = data, 0, len(data) * 8

    def peek(self, n: int) -> int:
        """The next n bits, zeros beyond the end."""
        byte = self.at >> 3
        chunk = int.from_bytes(self.data[byte : byte + 5].ljust(5, b"\0"), "big")
        return chunk >> (40 - (self.at & 7) - n) & ((1 << n) - 1)

    def code(self, table: dict, longest: int):
        for n in range(1, longest + 1):
            if (got := table.get((n, self.peek(n)))) is not None:
                self.at += n
                return got
        return None


def _run(bits: Bits, black: bool) -> int:
    total = 0
    while True:
        n = bits.code(run_codes(black), 13)
        if n is None:
            raise PdfError("filter", "a fax row has an unknown run")
        total += n
        if n < 64:
            return total


def _row_1d(bits: Bits, columns: int) -> list[int]:
    """Places where the colour changes; the first is where black begins."""
    out, at, black = [], 0, False
    while at < columns:
        at = min(columns, at + _run(bits, black))
        out.append(at)
        black = not black
    return out


def _row_2d(bits: Bits, columns: int, above: list[int]) -> list[int] | None:
    out: list[int] = []
    a0, black = -1, False
    while a0 < columns:
        mode = bits.code(MODE_CODES, 7)
        if mode is None:
            return None if a0 < 0 else out + [columns]
        # b1: the first change above, right of a0, to the colour that isn't the current one.
        k = next((i for i, x in enumerate(above) if x > a0 and i % 2 == black), len(above))
        b1 = above[k] if k < len(above) else columns
        if mode == "pass":
            a0 = above[k + 1] if k + 1 < len(above) else columns
        elif mode == "horizontal":
            start = max(a0, 0)
            first = min(columns, start + _run(bits, black))
            a0 = min(columns, first + _run(bits, not black))
            out += [first, a0]
        else:
            a0 = max(0, min(columns, b1 + mode))
            out.append(a0)
            black = not black
    return out


def decode_fax(data: bytes, params: dict) -> bytes:
    """Packed rows of a fax image, 0 black unless BlackIs1."""
    k, columns, rows = int(params.get("K", 0)), int(params.get("Columns", 1728)), int(params.get("Rows", 0) or params.get("Height", 0) or 0)
    align, black_is_1, damaged = bool(params.get("EncodedByteAlign")), bool(params.get("BlackIs1")), int(params.get("DamagedRowsBeforeError", 0))
    if not 0 < columns <= LARGEST_SIDE:
        raise PdfError("filter", "a fax image is too wide")
    bits, above, out = Bits(data), [columns], []
    while bits.at < bits.n and (not rows or len(out) < rows) and len(out) < LARGEST_SIDE:
        if align:
            bits.at = (bits.at + 7) // 8 * 8
        ended = 0
        while k >= 0:
            # Fill bits may stand before the end of a line.
            mark = bits.at
            while bits.at < bits.n and bits.peek(12) == 0:
                bits.at += 1
            if bits.peek(12) != 1:
                bits.at = mark
                break
            bits.at += 12
            ended += 1
            two = k > 0 and not bits.peek(1)
            bits.at += k > 0
            if ended >= 6:
                break
        if ended >= 6 or ended > 1 and bits.at >= bits.n:
            break
        if k < 0 and bits.peek(24) == 0x001001:
            break
        try:
            row = _row_2d(bits, columns, above) if k < 0 or k > 0 and ended and two else _row_1d(bits, columns)
            if row is None:
                break
        except PdfError:
            if bits.at >= bits.n or bits.n - bits.at < 12 or k < 0 or damaged <= 0:
                break
            damaged -= 1
            row = list(above)
            while bits.at < bits.n and bits.peek(12) != 1:
                bits.at += 1
        above = row
        out.append(row)
    if rows:
        out += [[columns]] * (rows - len(out))
    packed = bytearray()
    for row in out:
        line, at, black = 0, 0, False
        for x in [*row, columns]:
            if x > at:
                line = line << (x - at) | ((1 << (x - at)) - 1 if black else 0)
                at = x
            black = not black
        size = (columns + 7) // 8
        line <<= size * 8 - columns
        if not black_is_1:
            line ^= (1 << size * 8) - 1
        packed += line.to_bytes(size, "big")
    return bytes(packed)


def encode_g4(rows: list[list[bool]], columns: int) -> bytes:
    """Group 4 data of rows of pixels (true: black): for tests and for writing."""
    back = {m: c for c, m in MODES.items()}
    runs = {black: {n: format(v, f"0{w}b") for (w, v), n in run_codes(black).items()} for black in (False, True)}

    def run(n: int, black: bool) -> str:
        out = ""
        while n > 2623:
            out += runs[black][2560]
            n -= 2560
        if n >= 64:
            out += runs[black][n // 64 * 64]
            n %= 64
        return out + runs[black][n]

    def changes(row: list[bool]) -> list[int]:
        out, colour = [], False
        for i, p in enumerate(row):
            if p != colour:
                out.append(i)
                colour = p
        return out

    text, above = "", []
    for row in rows:
        own, a0, black = changes(row), -1, False
        while a0 < columns:
            a1 = next((x for i, x in enumerate(own) if x > a0 and i % 2 == black), columns) if a0 >= 0 else (own[0] if own else columns)
            k = next((i for i, x in enumerate(above) if x > a0 and i % 2 == black), len(above))
            b1 = above[k] if k < len(above) else columns
            b2 = above[k + 1] if k + 1 < len(above) else columns
            if b2 < a1:
                text += back["pass"]
                a0 = b2
            elif abs(a1 - b1) <= 3:
                text += back[a1 - b1]
                a0, black = a1, not black
            else:
                a2 = next((x for x in own if x > a1), columns)
                text += back["horizontal"] + run(a1 - max(a0, 0), black) + run(a2 - a1, not black)
                a0 = a2
        above = own
    text += END_OF_LINE * 2
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")
