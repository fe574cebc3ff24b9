"""Functions of a file: sampled, exponential, stitched, and calculator programs."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import product

from .filters import decode
from .lexer import Keyword, Lexer
from .objects import PdfError, Stream, number

MOST_STEPS = 100_000


def clip(values: list[float], bounds: list[float]) -> list[float]:
    return [max(bounds[2 * i], min(bounds[2 * i + 1], v)) if 2 * i + 1 < len(bounds) else v for i, v in enumerate(values)]


def interpolate(x: float, x0: float, x1: float, y0: float, y1: float) -> float:
    return y0 if x1 == x0 else y0 + (x - x0) * (y1 - y0) / (x1 - x0)


def sampled(x: list[float], sizes: list[int], samples: list[list[float]]) -> list[float]:
    """Multilinear interpolation in a grid; x in grid coordinates, the first varying fastest."""
    low = [min(max(int(math.floor(v)), 0), n - 1) for v, n in zip(x, sizes, strict=True)]
    out = [0.0] * len(samples[0])
    for corner in product((0, 1), repeat=len(x)):
        weight, at, step = 1.0, 0, 1
        for v, lo, c, n in zip(x, low, corner, sizes, strict=True):
            part = min(max(v - lo, 0.0), 1.0)
            weight *= part if c else 1 - part
            at += min(lo + c, n - 1) * step
            step *= n
        if weight:
            out = [o + weight * s for o, s in zip(out, samples[at], strict=True)]
    return out


def exponential(x: float, c0: list[float], c1: list[float], n: float) -> list[float]:
    p = x**n if x > 0 or n > 0 else 0.0 if x == 0 else float("nan")
    return [a + p * (b - a) for a, b in zip(c0, c1, strict=False)]


def _integer(x) -> int:
    return int(x)


def _shift(a, b) -> int:
    a, b = int(a), int(b)
    return a << b if b >= 0 else a >> -b


def _round_half_up(x):
    return x if isinstance(x, int) else float(math.floor(x + 0.5))


def _angle(a, b) -> float:
    d = math.degrees(math.atan2(a, b))
    return d + 360 if d < 0 else d


_UNARY = {
    "abs": abs, "neg": lambda a: -a, "ceiling": lambda a: a if isinstance(a, int) else float(math.ceil(a)), "floor": lambda a: a if isinstance(a, int) else float(math.floor(a)), "round": _round_half_up, "truncate": lambda a: a if isinstance(a, int) else float(math.trunc(a)), "sqrt": math.sqrt,
    "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)), "ln": math.log, "log": math.log10, "cvi": _integer, "cvr": float, "not": lambda a: (not a) if isinstance(a, bool) else ~int(a),
}
_BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else 0.0, "idiv": lambda a, b: int(math.trunc(a / b)) if b else 0, "mod": lambda a, b: int(math.fmod(a, b)) if b else 0,
    "exp": lambda a, b: float(a) ** b, "atan": _angle, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a ^ b, "bitshift": _shift,
}


def compile_program(source: bytes) -> list:
    """Nested lists of numbers, booleans, operators and blocks."""
    lexer = Lexer(source)
    out: list = []
    stack = [out]
    while True:
        try:
            x = lexer.next(False)
        except EOFError:
            return out[0] if len(out) == 1 and isinstance(out[0], list) else out
        if x == b"{" and isinstance(x, Keyword):
            stack[-1].append([])
            stack.append(stack[-1][-1])
        elif x == b"}" and isinstance(x, Keyword):
            if len(stack) > 1:
                stack.pop()
        else:
            stack[-1].append(x.decode("latin-1") if isinstance(x, Keyword) else x)


@lru_cache(maxsize=256)
def _compiled(source: bytes) -> list:
    """compile_program of what is run again and again; running changes nothing in it."""
    return compile_program(source)


def run_program(program: list, inputs: list[float]) -> list[float]:
    stack = list(inputs)
    left = MOST_STEPS

    def run(body: list) -> None:
        nonlocal left
        for x in body:
            left -= 1
            if left < 0:
                raise PdfError("function", "a program takes too long")
            if not isinstance(x, str):
                stack.append(x)
            elif x in _BINARY:
                b, a = stack.pop(), stack.pop()
                stack.append(_BINARY[x](a, b))
            elif x in _UNARY:
                stack.append(_UNARY[x](stack.pop()))
            elif x == "dup":
                stack.append(stack[-1])
            elif x == "exch":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif x == "pop":
                stack.pop()
            elif x == "copy":
                n = int(stack.pop())
                if n > 0:
                    stack.extend(stack[-n:])
            elif x == "index":
                stack.append(stack[-1 - int(stack.pop())])
            elif x == "roll":
                j, n = int(stack.pop()), int(stack.pop())
                if n > 0:
                    top = stack[-n:]
                    j %= n
                    stack[-n:] = top[n - j :] + top[: n - j]
            elif x == "if":
                then = stack.pop()
                if stack.pop():
                    run(then)
            elif x == "ifelse":
                other, then = stack.pop(), stack.pop()
                run(then if stack.pop() else other)
            else:
                raise PdfError("function", f"unknown operator {x}")

    try:
        run(program)
    except (IndexError, TypeError, ValueError, OverflowError, ZeroDivisionError) as e:
        raise PdfError("function", str(e)) from e
    return [float(v) for v in stack]


def read_samples(data: bytes, n: int, bits: int) -> list[int]:
    big = int.from_bytes(data[: (n * bits + 7) // 8].ljust((n * bits + 7) // 8, b"\0"), "big")
    total = (n * bits + 7) // 8 * 8
    return [big >> (total - (i + 1) * bits) & ((1 << bits) - 1) for i in range(n)]


def evaluate(doc, x, inputs: list[float], depth: int = 0) -> list[float]:
    """The value of a function object."""
    x = doc.get(x)
    d = doc.dict_of(x)
    floats = lambda key, default=(): [number(doc.get(v)) for v in doc.get(d.get(key)) or default]
    kind, domain, bounds = doc.get(d.get("FunctionType")), floats("Domain"), floats("Range")
    if depth > 16:
        raise PdfError("function", "functions are nested too deeply")
    inputs = clip(inputs, domain)
    if kind == 0:
        sizes, bits, parts = [int(v) for v in floats("Size")], int(number(doc.get(d.get("BitsPerSample")), 8)), len(bounds) // 2
        encode = floats("Encode") or [v for n in sizes for v in (0, n - 1)]
        decode_ = floats("Decode") or bounds
        raw = read_samples(decode(x, doc.get), math.prod(sizes) * parts, bits)
        rows = [[float(v) for v in raw[i : i + parts]] for i in range(0, len(raw), parts)]
        at = [min(max(interpolate(v, domain[2 * i], domain[2 * i + 1], encode[2 * i], encode[2 * i + 1]), 0), sizes[i] - 1) for i, v in enumerate(inputs)]
        top = (1 << bits) - 1
        out = [interpolate(v, 0, top, decode_[2 * i], decode_[2 * i + 1]) for i, v in enumerate(sampled(at, sizes, rows))]
    elif kind == 2:
        out = exponential(inputs[0], floats("C0", [0.0]), floats("C1", [1.0]), number(doc.get(d.get("N")), 1.0))
    elif kind == 3:
        parts, limits, encode = doc.get(d.get("Functions")), floats("Bounds"), floats("Encode")
        k = sum(b <= inputs[0] for b in limits)
        edges = [domain[0], *limits, domain[1]]
        k = min(k, len(parts) - 1)
        out = evaluate(doc, parts[k], [interpolate(inputs[0], edges[k], edges[k + 1], encode[2 * k], encode[2 * k + 1])], depth + 1)
    elif kind == 4 and isinstance(x, Stream):
        out = run_program(_compiled(decode(x, doc.get)), inputs)
        out = out[-(len(bounds) // 2) :] if bounds else out
    else:
        raise PdfError("function", f"unknown function type {kind}")
    return clip(out, bounds)
