"""Numeric functions of files as columns: interpolation, stitching, and calculator operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def interpolate(x: Column, x0: float, x1: float, y0, y1) -> Column:
    y0, y1 = (v if isinstance(v, Column) else F.lit(float(v)) for v in (y0, y1))
    return y0 if x1 == x0 else y0 + (x - x0) * (y1 - y0) / (x1 - x0)


def exponential(x: Column, c0: list[float], c1: list[float], n: float) -> Column:
    """An array: c0 + x**n (c1 - c0)."""
    p = F.pow(x, F.lit(float(n)))
    return F.array(*(F.lit(float(a)) + p * (float(b) - float(a)) for a, b in zip(c0, c1, strict=True)))


def sampled(x: Column, samples: list[float], low: float = 0.0, high: float = 1.0) -> Column:
    """Linear interpolation in equally spaced samples."""
    n, values = len(samples), F.array(*(F.lit(float(s)) for s in samples))
    at = clip((clip(x, low, high) - low) * (n - 1) / (high - low), 0.0, float(n - 1))
    i = F.least(F.floor(at).cast("int"), F.lit(max(n - 2, 0)))
    a, b = F.get(values, i), F.get(values, F.least(i + 1, F.lit(n - 1)))
    return a + (at - i) * (b - a)


def bilinear(x: Column, y: Column, rows: list[list[float]]) -> Column:
    """In a grid over the unit square; rows by y."""
    h, w = len(rows), len(rows[0])
    values = F.array(*(F.lit(float(v)) for r in rows for v in r))
    px, py = clip(x, 0.0, 1.0) * (w - 1), clip(y, 0.0, 1.0) * (h - 1)
    i, j = F.least(F.floor(px).cast("int"), F.lit(max(w - 2, 0))), F.least(F.floor(py).cast("int"), F.lit(max(h - 2, 0)))
    get = lambda a, b: F.get(values, F.least(b, F.lit(h - 1)) * w + F.least(a, F.lit(w - 1)))
    u, v = px - i, py - j
    return (get(i, j) * (1 - u) + get(i + 1, j) * u) * (1 - v) + (get(i, j + 1) * (1 - u) + get(i + 1, j + 1) * u) * v


def stitched(x: Column, limits: list[float], domain: tuple[float, float], encode: list[tuple[float, float]], parts: list[Callable[[Column], Column]]) -> Column:
    """parts[k] of the stretch between two limits that x lies in."""
    edges, out = [domain[0], *limits, domain[1]], F
    x = clip(x, *domain)
    for k, limit in enumerate(limits):
        out = out.when(x < limit, parts[k](interpolate(x, edges[k], edges[k + 1], *encode[k])))
    return out.otherwise(parts[-1](interpolate(x, edges[-2], edges[-1], *encode[-1])))


def truncated(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))


_safe = lambda a, b, f: F.when(b == 0, F.lit(0.0)).otherwise(f(a, F.when(b != 0, b)))
_flag = lambda c: c.cast("double")
_whole = lambda c: c.cast("bigint")
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "neg": F.negative, "ceiling": lambda a: F.ceil(a).cast("double"), "floor": lambda a: F.floor(a).cast("double"), "round": lambda a: F.floor(a + 0.5).cast("double"), "truncate": lambda a: truncated(a).cast("double"),
    "sqrt": F.sqrt, "sin": lambda a: F.sin(F.radians(a)), "cos": lambda a: F.cos(F.radians(a)), "ln": F.ln, "log": F.log10, "cvi": lambda a: truncated(a).cast("double"), "cvr": lambda a: a, "not": lambda a: F.when(a == 0, 1.0).otherwise(0.0),
}
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: _safe(a, b, lambda x, y: x / y), "idiv": lambda a, b: _safe(a, b, lambda x, y: truncated(x / y).cast("double")), "mod": lambda a, b: _safe(a, b, lambda x, y: x % y),
    "exp": F.pow, "atan": lambda a, b: F.when(F.atan2(a, b) < 0, F.degrees(F.atan2(a, b)) + 360).otherwise(F.degrees(F.atan2(a, b))),
    "eq": lambda a, b: _flag(a == b), "ne": lambda a, b: _flag(a != b), "gt": lambda a, b: _flag(a > b), "ge": lambda a, b: _flag(a >= b), "lt": lambda a, b: _flag(a < b), "le": lambda a, b: _flag(a <= b),
    "and": lambda a, b: _whole(a).bitwiseAND(_whole(b)).cast("double"), "or": lambda a, b: _whole(a).bitwiseOR(_whole(b)).cast("double"), "xor": lambda a, b: _whole(a).bitwiseXOR(_whole(b)).cast("double"),
}


def program(source: str, *inputs: Column) -> list[Column]:
    """A calculator program as expressions: the stack it leaves. Conditionals become CASE, so a program stays inside code generation.

    copy, index and roll need counts that are numbers in the program.
    """
    from quirelake.kernel.calculator import compile_program

    def number(x) -> int:
        if isinstance(x, Column):
            raise ValueError("counts have to be numbers of the program")
        return int(x)

    def column(x) -> Column:
        return x if isinstance(x, Column) else F.lit(float(x))

    def run(body: list, stack: list) -> list:
        stack = list(stack)
        for x in body:
            if not isinstance(x, str):
                stack.append(x)
            elif x == "bitshift":
                n, a = number(stack.pop()), column(stack.pop())
                stack.append((F.shiftleft(_whole(a), n) if n >= 0 else F.shiftright(_whole(a), -n)).cast("double"))
            elif x in BINARY:
                b, a = column(stack.pop()), column(stack.pop())
                stack.append(BINARY[x](a, b))
            elif x in UNARY:
                stack.append(UNARY[x](column(stack.pop())))
            elif x in ("true", "false"):
                stack.append(float(x == "true"))
            elif x == "dup":
                stack.append(stack[-1])
            elif x == "exch":
                stack[-1], stack[-2] = stack[-2], stack[-1]
            elif x == "pop":
                stack.pop()
            elif x == "copy":
                n = number(stack.pop())
                stack += stack[-n:] if n > 0 else []
            elif x == "index":
                stack.append(stack[-1 - number(stack.pop())])
            elif x == "roll":
                j, n = number(stack.pop()), number(stack.pop())
                top, j = stack[-n:], j % n
                stack[-n:] = top[n - j :] + top[: n - j]
            elif x in ("if", "ifelse"):
                other = stack.pop() if x == "ifelse" else []
                then = stack.pop()
                test = column(stack.pop()) != 0
                yes, no = run(then, stack), run(other, stack)
                if len(yes) != len(no):
                    raise ValueError("both branches have to leave as much")
                stack = [a if a is b else F.when(test, column(a)).otherwise(column(b)) for a, b in zip(yes, no, strict=True)]
            else:
                raise ValueError(f"unknown operator {x}")
        return stack

    return [column(x) for x in run(compile_program(source.encode()), list(inputs))]
