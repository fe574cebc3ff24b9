"""Vector paths and images of a page."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from .content import Instruction
from .filters import PASSED, chain, decode
from .objects import IDENTITY, Name, PdfError, Stream, multiply, number, numbers, transform

#: Distance of a Bezier curve's control points for a quarter of an ellipse.
KAPPA = 0.5522847498
PAINT = {"S": (1, 0, 0), "s": (1, 0, 1), "f": (0, 1, 0), "F": (0, 1, 0), "f*": (0, 1, 0), "B": (1, 1, 0), "B*": (1, 1, 0), "b": (1, 1, 1), "b*": (1, 1, 1)}


@dataclass
class Path:
    segments: list[tuple[str, list[float]]]
    stroke: tuple | None
    fill: tuple | None
    line_width: float

    def bounds(self) -> tuple | None:
        xs, ys = [], []
        for kind, p in self.segments:
            if kind == "rectangle":
                xs += [p[0], p[0] + p[2]]
                ys += [p[1], p[1] + p[3]]
            else:
                xs += p[::2]
                ys += p[1::2]
        return (min(xs), min(ys), max(xs), max(ys)) if xs else None


@dataclass
class _State:
    fill: tuple = (0.0, 0.0, 0.0)
    stroke: tuple = (0.0, 0.0, 0.0)
    width: float = 1.0


def cmyk_to_rgb(c: float, m: float, y: float, k: float) -> tuple[float, float, float]:
    return tuple(max(0.0, min(1.0, (1 - v) * (1 - k))) for v in (c, m, y))


def color(args: list) -> tuple | None:
    """Red, green and blue of one, three or four components."""
    v = [float(x) for x in args if isinstance(x, (int, float))]
    return (v[0],) * 3 if len(v) == 1 else tuple(v) if len(v) == 3 else cmyk_to_rgb(*v) if len(v) == 4 else None


def paths(instructions: list[Instruction]) -> list[Path]:
    out, segments, at = [], [], (0.0, 0.0)
    s, stack = _State(), []
    for i in instructions:
        op, a = i.op, [float(x) if type(x) is int or type(x) is float else number(x) for x in i.args]
        if op == "q":
            stack.append(replace(s))
        elif op == "Q":
            s = stack.pop() if stack else s
        elif op in ("m", "l") and len(a) >= 2:
            at = (a[0], a[1])
            segments.append(("move" if op == "m" else "line", [*at]))
        elif op in ("c", "v", "y") and len(a) >= (6 if op == "c" else 4):
            p = a[:6] if op == "c" else [*at, *a[:4]] if op == "v" else [*a[:4], *a[2:4]]
            at = (p[4], p[5])
            segments.append(("curve", p))
        elif op == "h":
            segments.append(("close", []))
        elif op == "re" and len(a) >= 4:
            at = (a[0], a[1])
            segments.append(("rectangle", a[:4]))
        elif op in ("g", "rg", "k", "sc", "scn"):
            s.fill = color(i.args) or s.fill
        elif op in ("G", "RG", "K", "SC", "SCN"):
            s.stroke = color(i.args) or s.stroke
        elif op == "w" and a:
            s.width = a[0]
        elif op in PAINT:
            stroke, fill, close = PAINT[op]
            if close:
                segments.append(("close", []))
            if segments:
                out.append(Path(segments, s.stroke if stroke else None, s.fill if fill else None, s.width))
            segments = []
        elif op == "n":
            segments = []
    return out


def ellipse(cx: float, cy: float, rx: float, ry: float) -> list[Instruction]:
    kx, ky = rx * KAPPA, ry * KAPPA
    return [
        Instruction("m", [cx + rx, cy]),
        Instruction("c", [cx + rx, cy + ky, cx + kx, cy + ry, cx, cy + ry]),
        Instruction("c", [cx - kx, cy + ry, cx - rx, cy + ky, cx - rx, cy]),
        Instruction("c", [cx - rx, cy - ky, cx - kx, cy - ry, cx, cy - ry]),
        Instruction("c", [cx + kx, cy - ry, cx + rx, cy - ky, cx + rx, cy]),
        Instruction("h"),
    ]


def drawn(shape: str, numbers_: list[float], stroke: tuple | None = None, fill: tuple | None = None, width: float = 1.0) -> list[Instruction]:
    """A rectangle (x, y, width, height), a line (x1, y1, x2, y2) or an ellipse (centre, radii), in a state of its own."""
    body = {"rectangle": lambda n: [Instruction("re", n)], "line": lambda n: [Instruction("m", n[:2]), Instruction("l", n[2:])], "ellipse": lambda n: ellipse(*n)}[shape](list(numbers_))
    if shape == "line":
        stroke, fill = stroke or (0, 0, 0), None
    out = [Instruction("q"), Instruction("w", [width])]
    out += [Instruction("RG", list(stroke))] if stroke else []
    out += [Instruction("rg", list(fill))] if fill else []
    return [*out, *body, Instruction("B" if stroke and fill else "f" if fill else "S" if stroke else "n"), Instruction("Q")]


@dataclass
class Image:
    name: str
    width: int
    height: int
    bits: int
    space: str
    position: tuple | None = None
    stream: Stream | None = field(default=None, repr=False)


def space_name(doc, x) -> str:
    x = doc.get(x)
    return str(x) if isinstance(x, Name) else str(doc.get(x[0])) if isinstance(x, list) and x else "DeviceGray"


def images(doc, page, instructions: list[Instruction]) -> list[Image]:
    """Images among the page's resources, each where it is drawn first."""
    places: dict[str, tuple] = {}
    ctm, stack = IDENTITY, []
    for i in instructions:
        if i.op == "q":
            stack.append(ctm)
        elif i.op == "Q":
            ctm = stack.pop() if stack else ctm
        elif i.op == "cm" and (m := numbers(i.args, 6)):
            ctm = multiply(m, ctm)
        elif i.op == "Do" and i.args:
            corners = [transform(ctm, x, y) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1))]
            xs, ys = [p[0] for p in corners], [p[1] for p in corners]
            places.setdefault(str(i.args[0]), (min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)))
    out = []
    for name, ref in doc.dict_of(doc.resources(page).get("XObject")).items():
        x = doc.get(ref)
        if isinstance(x, Stream) and x.dict.get("Subtype") == "Image":
            w, h, bits = (doc.get(x.dict.get(k)) for k in ("Width", "Height", "BitsPerComponent"))
            if isinstance(w, int) and isinstance(h, int):
                mask = doc.get(x.dict.get("ImageMask")) is True
                out.append(Image(name, w, h, 1 if mask else bits if isinstance(bits, int) else 8, space_name(doc, x.dict.get("ColorSpace")), places.get(name), x))
    return out


def samples(data: bytes, width: int, height: int, parts: int, bits: int) -> np.ndarray:
    """height x width x parts samples of a packed image; short data is filled with zeros."""
    row = (width * parts * bits + 7) // 8
    raw = np.frombuffer(data[: row * height].ljust(row * height, b"\0"), np.uint8).reshape(height, row)
    if bits == 8:
        out = raw
    elif bits == 16:
        out = raw[:, ::2].astype(np.uint16) << 8 | raw[:, 1::2]
    else:
        each = np.unpackbits(raw, axis=1)[:, : width * parts * bits].reshape(height, width * parts, bits)
        out = (each * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)
    return out[:, : width * parts].reshape(height, width, parts)


def pixels(doc, image: Image) -> bytes:
    """8-bit RGB of an image; image files within a file (JPEG and so on) are an error."""
    x = image.stream
    if any(f in PASSED for f, _ in chain(x, doc.get)):
        raise PdfError("filter", "the image is a file of its own format")
    data = decode(x, doc.get)
    space = doc.get(x.dict.get("ColorSpace"))
    palette = None
    name = space_name(doc, space)
    under = space_name(doc, space[1]) if name == "Indexed" and isinstance(space, list) and len(space) > 1 else name
    ranges = doc.get(x.dict.get("Decode"))
    usual = [0, (1 << image.bits) - 1] if name == "Indexed" else [0, 1] * (len(ranges) // 2 if isinstance(ranges, list) else 0)
    if under in ("Separation", "DeviceN", "Lab", "Pattern") or isinstance(ranges, list) and [number(doc.get(v), -1) for v in ranges] != usual:
        raise PdfError("pixels", f"samples of {under}, or samples with ranges of their own, are not understood")
    if name == "Indexed" and isinstance(space, list) and len(space) >= 4:
        base = space_name(doc, space[1])
        lookup = doc.get(space[3])
        lookup = decode(lookup, doc.get) if isinstance(lookup, Stream) else bytes(lookup or b"")
        n = {"DeviceRGB": 3, "DeviceCMYK": 4}.get(base, 1)
        palette = rgb(np.frombuffer(lookup[: len(lookup) // n * n], np.uint8).reshape(-1, n))
        parts = 1
    elif name == "ICCBased" and isinstance(space, list):
        parts = int(number(doc.get(doc.dict_of(space[1]).get("N")), 3))
    else:
        parts = {"DeviceRGB": 3, "CalRGB": 3, "Lab": 3, "DeviceCMYK": 4}.get(name, 1)
    got = samples(data, image.width, image.height, parts, image.bits)
    if palette is not None:
        return palette[np.minimum(got[:, :, 0], len(palette) - 1)].tobytes()
    eight = (got.astype(np.uint32) * 255 // ((1 << image.bits) - 1)).astype(np.uint8)
    return rgb(eight.reshape(-1, parts)).tobytes()


def rgb(x: np.ndarray) -> np.ndarray:
    """Rows of gray, RGB or CMYK bytes as RGB bytes; fractions are cut off."""
    if x.shape[1] == 1:
        return np.repeat(x, 3, axis=1)
    if x.shape[1] == 4:
        wide = x.astype(np.float64) / 255
        return np.clip((1 - wide[:, :3]) * (1 - wide[:, 3:]) * 255, 0, 255).astype(np.uint8)
    return x[:, :3]
