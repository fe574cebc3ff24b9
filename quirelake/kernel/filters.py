"""Stream filters: decoders for all, encoders where a file needs one."""

from __future__ import annotations

import re
import zlib

import numpy as np

from .objects import PdfError, Stream

#: No stream may decode to more than this, however small it is.
LARGEST = 256 << 20
SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "RL": "RunLengthDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
#: Filters whose output is an image file of its own, passed on as it is.
PASSED = ("DCTDecode", "JPXDecode")


def flate(data: bytes) -> bytes:
    """zlib data, raw deflate data as a second try; what a damaged stream gives until the damage."""
    try:
        whole = zlib.decompressobj().decompress(data, LARGEST + 1)
        if whole and len(whole) <= LARGEST:
            return whole
    except zlib.error:
        pass
    for bits in (15, -15):
        d = zlib.decompressobj(bits)
        out = bytearray()
        try:
            out += d.decompress(data, LARGEST + 1)
        except zlib.error:
            out = bytearray()
            d = zlib.decompressobj(bits)
            try:
                for i in range(0, len(data), 256):
                    out += d.decompress(data[i : i + 256], LARGEST + 1 - len(out))
            except zlib.error:
                pass
        if len(out) > LARGEST:
            raise PdfError("size", "a stream decodes to too many bytes")
        if out or bits < 0:
            return bytes(out)
        if not data:
            return b""
    return b""


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits; with early change the width grows one code sooner."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    width, held, have, out, last = 9, 0, 0, bytearray(), b""
    for byte in data:
        held, have = (held << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = held >> have & ((1 << width) - 1)
        if code == 256:
            del table[258:]
            width, last = 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            now = table[code]
        elif last:
            now = last + last[:1]
        else:
            break
        out += now
        if len(out) > LARGEST:
            raise PdfError("size", "a stream decodes to too many bytes")
        if last and len(table) < 4096:
            table.append(last + now[:1])
        last = now
        while width < 12 and len(table) + early >= 1 << width:
            width += 1
    return bytes(out)


def lzw_encode(data: bytes, early: int = 1) -> bytes:
    # Strings by the code of all but their last byte, and that byte; a byte is its own code.
    codes: dict[int, int] = {}
    held, have, width, following, now, out = 256, 9, 9, 258, -1, bytearray()
    for byte in data:
        if now < 0:
            now = byte
            continue
        more = codes.get(now << 8 | byte)
        if more is not None:
            now = more
            continue
        held, have = held << width | now, have + width
        codes[now << 8 | byte] = following
        following += 1
        # The decoder is one entry behind, so its width is that of one entry less.
        if following - 1 + early >= 1 << width:
            width = min(12, max(9, (following - 1 + early).bit_length()))
        if following >= 4095:
            held, have = held << width | 256, have + width
            codes, following, width = {}, 258, 9
        now = byte
        if have > 512:
            whole, have = have // 8, have % 8
            out += (held >> have).to_bytes(whole, "big")
            held &= (1 << have) - 1
    if now >= 0:
        held, have = held << width | now, have + width
        width = min(12, max(9, (following + early).bit_length()))
    held, have = held << width | 257, have + width
    held <<= -have % 8
    return bytes(out) + held.to_bytes((have + 7) // 8, "big")


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii_hex_encode(data: bytes) -> bytes:
    return data.hex().upper().encode() + b">"


def ascii85(data: bytes) -> bytes:
    body = re.sub(rb"[\0\t\n\x0c\r ]", b"", data).removeprefix(b"<~").split(b"~")[0]
    out, group = bytearray(), []
    for c in body:
        if c == ord("z") and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (_base85(group) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group) - 1
        out += (_base85(group + [84] * (5 - len(group))) & 0xFFFFFFFF).to_bytes(4, "big")[:n]
    return bytes(out)


def _base85(digits: list[int]) -> int:
    x = 0
    for d in digits:
        x = x * 85 + d
    return x


def ascii85_encode(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 4):
        part = data[i : i + 4]
        x = int.from_bytes(part.ljust(4, b"\0"), "big")
        if not x and len(part) == 4:
            out += b"z"
            continue
        digits = []
        for _ in range(5):
            x, d = divmod(x, 85)
            digits.append(d + 33)
        out += bytes(digits[::-1])[: len(part) + 1]
    return bytes(out) + b"~>"


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        if len(out) > LARGEST:
            raise PdfError("size", "a stream decodes to too many bytes")
    return bytes(out)


def run_length_encode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 128 and data[i + n : i + n + 1] == data[i : i + 1]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[i]])
        else:
            while n < 128 and i + n < len(data) and data[i + n] != data[i + n - 1]:
                n += 1
            out += bytes([n - 1]) + data[i : i + n]
        i += n
    return bytes(out) + b"\x80"


def unpredicted(data: bytes, params: dict) -> bytes:
    """Undoes the row predictor of Flate and LZW streams."""
    predictor = params.get("Predictor", 1)
    if not isinstance(predictor, int) or predictor < 2:
        return data
    colors, bits, columns = (int(params.get(k, d)) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    pixel, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if row <= 0:
        return data
    if predictor == 2:
        if bits != 8:
            return data
        rows = np.frombuffer(data[: len(data) // row * row], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes() + data[len(data) // row * row :]
    out, before = bytearray(), np.zeros(row, np.uint8)
    for i in range(0, len(data), row + 1):
        kind = data[i]
        line = np.frombuffer(data[i + 1 : i + 1 + row].ljust(row, b"\0"), np.uint8).copy()
        if kind == 1:
            for k in range(pixel):
                line[k::pixel] = np.cumsum(line[k::pixel], dtype=np.uint8)
        elif kind == 2:
            line += before
        elif kind in (3, 4):
            up, now = before.astype(int).tolist(), line.astype(int).tolist()
            for k in range(row):
                a = now[k - pixel] if k >= pixel else 0
                b = up[k]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    c = up[k - pixel] if k >= pixel else 0
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[k] = (now[k] + guess) & 255
            line = np.array(now, np.uint8)
        out += line.tobytes()
        before = line
    return bytes(out)


def chain(stream: Stream, resolve=lambda x: x) -> list[tuple[str, dict]]:
    """Filters of a stream with their parameters; references are resolved."""
    filters = resolve(stream.dict.get("Filter", stream.dict.get("F")))
    params = resolve(stream.dict.get("DecodeParms", stream.dict.get("DP")))
    filters = [resolve(f) for f in filters] if isinstance(filters, list) else [] if filters is None else [filters]
    params = [resolve(p) for p in params] if isinstance(params, list) else [params]
    own = lambda i: {k: resolve(v) for k, v in params[i].items()} if i < len(params) and isinstance(params[i], dict) else {}
    return [(SHORT.get(str(f), str(f)), own(i)) for i, f in enumerate(filters) if isinstance(f, str)]


def decode(stream: Stream, resolve=lambda x: x) -> bytes:
    """A stream's content. An unknown filter is an error; image files are passed on."""
    if stream.decoded is None:
        data = stream.raw
        for name, params in chain(stream, resolve):
            if name == "FlateDecode":
                data = unpredicted(flate(data), params)
            elif name == "LZWDecode":
                data = unpredicted(lzw(data, int(params.get("EarlyChange", 1))), params)
            elif name == "ASCIIHexDecode":
                data = ascii_hex(data)
            elif name == "ASCII85Decode":
                data = ascii85(data)
            elif name == "RunLengthDecode":
                data = run_length(data)
            elif name == "CCITTFaxDecode":
                from .fax import decode_fax

                data = decode_fax(data, params)
            elif name == "JBIG2Decode":
                from .bilevel import decode_bilevel

                shared = params.get("JBIG2Globals")
                data = decode_bilevel(data, decode(shared, resolve) if isinstance(shared, Stream) else b"")
            elif name == "Crypt" or name in PASSED:
                pass
            else:
                raise PdfError("filter", f"unsupported filter {name}")
        stream.decoded = data
    return stream.decoded


ENCODERS = {"FlateDecode": zlib.compress, "ASCIIHexDecode": ascii_hex_encode, "ASCII85Decode": ascii85_encode, "LZWDecode": lzw_encode, "RunLengthDecode": run_length_encode}


def encode(data: bytes, filters: list[str]) -> bytes:
    """Content for a stream whose Filter is this list: the last is applied first."""
    for name in reversed(filters):
        data = ENCODERS[SHORT.get(name, name)](data)
    return data
