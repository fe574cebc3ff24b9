"""Bytes as columns: records of fixed width, cross-reference entries, base 85, run lengths and predictors.

All of it is expressions over binary columns: no byte leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once (within lambdas an expression is worked out for each item); null for null."""
    return F.get(F.transform(F.filter(F.array(value), lambda v: v.isNotNull()), body), F.lit(0))


def counted(n: Column, item: Callable[[Column], Column], none: Column) -> Column:
    """item(0) to item(n - 1) as an array; none (an empty array of its type) for n = 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), item)).otherwise(none)


def whole_number(data: Column) -> Column:
    """Bytes as a big-endian number of up to 7 bytes; no bytes are 0."""
    return F.coalesce(F.conv(F.hex(data), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def part(data: Column, start: Column, size: Column) -> Column:
    """size bytes from start (0-based)."""
    return F.substring(data, (start + 1).cast("int"), size.cast("int"))


def byte_values(data: Column) -> Column:
    """Bytes as an array of numbers."""
    none = F.array().cast("array<int>")
    return let(F.hex(data), lambda digits: counted(F.floor(F.length(digits) / 2), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int"), none))


def from_byte_values(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), ""))


# Cross-references -----------------------------------------------------------------------------------

ENTRY = "array<struct<obj: bigint, kind: string, a: bigint, b: bigint>>"


def table_entries(section: Column) -> Column:
    """Entries (obj, kind, a, b) of a cross-reference table, from the word xref on: n (offset a, generation b) or f (next free a, generation b).

    Entries are 20 bytes each, whatever ends their lines; where a subsection begins follows from the lengths of those
    before it. What is no table has no entries; of one that is cut off, those that are whole.
    """
    return let(F.decode(section, "ISO-8859-1"), _table_entries)


def _table_entries(text: Column) -> Column:
    opening = F.length(F.regexp_extract(text, r"^\s*xref[ \t]*(?:\r\n|\r|\n)", 0))
    heads = F.regexp_extract_all(text, F.lit(r"(?<=[\r\n])[ \t]*[0-9]+ [0-9]+[ \t]*(?:\r\n|\r(?!\n)|\n)(?=[0-9]{10} [0-9]{5} [nf]|[ \t]*[0-9]+ [0-9]+[ \t]*[\r\n]|trailer)"), F.lit(0))
    told = F.transform(heads, lambda h: F.struct(F.regexp_extract(h, "([0-9]+) ([0-9]+)", 1).cast("bigint").alias("first"), F.regexp_extract(h, "([0-9]+) ([0-9]+)", 2).cast("bigint").alias("n"), F.length(h).cast("bigint").alias("size")))
    start = F.struct(opening.cast("bigint").alias("at"), F.array().cast("array<struct<first: bigint, n: bigint, at: bigint>>").alias("done"))
    placed = F.aggregate(told, start, lambda s, h: F.struct((s["at"] + h["size"] + 20 * h["n"]).alias("at"), F.concat(s["done"], F.array(F.struct(h["first"], h["n"], (s["at"] + h["size"]).alias("at")))).alias("done")))["done"]
    none = F.array().cast(ENTRY)

    def entries(s: Column) -> Column:
        def entry(i: Column) -> Column:
            row = F.substring(text, (s["at"] + 20 * i + 1).cast("int"), F.lit(20))
            number = lambda a, n: F.substring(row, a, n).try_cast("bigint")
            return F.struct((s["first"] + i).cast("bigint").alias("obj"), F.substring(row, 18, 1).alias("kind"), number(1, 10).alias("a"), number(12, 5).alias("b"))

        return counted(F.least(s["n"], F.greatest(F.floor((F.length(text) - s["at"] + 2) / 20), F.lit(0))), entry, none)

    found = F.flatten(F.transform(placed, entries))
    return F.when(opening > 0, F.filter(found, lambda e: e["kind"].isin("n", "f") & e["a"].isNotNull() & e["b"].isNotNull())).otherwise(none)


def stream_entries(data: Column, widths: Column, index: Column) -> Column:
    """Entries (obj, kind, a, b) of a cross-reference stream's data: f, n (offset a, generation b) or c (in object stream a, at place b).

    widths are the three of /W, index the pairs (first, how many) of /Index. A first field of no bytes means n. Entries
    of other kinds, and those beyond the data, are left out.
    """
    w = [F.get(widths, F.lit(i)).cast("bigint") for i in range(3)]
    size = w[0] + w[1] + w[2]
    pairs = counted(F.floor(F.size(index) / 2), lambda i: F.struct(F.get(index, 2 * i).cast("bigint").alias("first"), F.get(index, 2 * i + 1).cast("bigint").alias("n")), F.array().cast("array<struct<first: bigint, n: bigint>>"))
    numbers = F.flatten(F.transform(pairs, lambda p: F.when(p["n"] > 0, F.sequence(p["first"], p["first"] + p["n"] - 1)).otherwise(F.array().cast("array<bigint>"))))
    there = F.slice(numbers, F.lit(1), F.least(F.size(numbers), F.floor(F.octet_length(data) / size)).cast("int"))

    def entry(obj: Column, i: Column) -> Column:
        at = i * size
        first = F.when(w[0] == 0, F.lit(1).cast("bigint")).otherwise(whole_number(part(data, at, w[0])))
        kind = F.when(first == 0, "f").when(first == 1, "n").when(first == 2, "c")
        return F.struct(obj.alias("obj"), kind.alias("kind"), whole_number(part(data, at + w[0], w[1])).alias("a"), whole_number(part(data, at + w[0] + w[1], w[2])).alias("b"))

    return F.when(size > 0, F.filter(F.transform(there, entry), lambda e: e["kind"].isNotNull())).otherwise(F.array().cast(ENTRY))


# Filters ---------------------------------------------------------------------------------------------


def ascii85(data: Column) -> Column:
    """Bytes as base 85 text with its end mark; four zero bytes are a z."""
    n = F.octet_length(data)
    zeros = F.unhex(F.repeat(F.lit("00"), F.pmod(-n, F.lit(4))))

    def text(padded: Column) -> Column:
        def group(i: Column) -> Column:
            left = F.least(n - 4 * i, F.lit(4))
            digits = lambda v: F.concat(*(F.chr(F.floor(v / 85**k) % 85 + 33) for k in (4, 3, 2, 1, 0)))
            return let(whole_number(part(padded, 4 * i, F.lit(4))), lambda v: F.when((v == 0) & (left == 4), "z").otherwise(F.substring(digits(v), F.lit(1), left + 1)))

        return F.concat(F.array_join(counted(F.ceil(n / 4), group, F.array().cast("array<string>")), ""), F.lit("~>"))

    return let(F.concat(data, zeros), text)


def from_ascii85(text: Column) -> Column:
    """Bytes of base 85 text up to its end mark; characters that are none of its own are passed over. A last group of one character says nothing."""
    own = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)~>.*$", ""), r"[^!-uz]", ""), "z", "!!!!!")

    def whole(own: Column) -> Column:
        n = F.length(own)

        def data(padded: Column) -> Column:
            def group(i: Column) -> Column:
                five = F.substring(padded, 5 * i + 1, F.lit(5))
                v = sum(((F.ascii(F.substring(five, k + 1, 1)) - 33).cast("bigint") * 85 ** (4 - k) for k in range(5)), F.lit(0).cast("bigint"))
                return F.lpad(F.hex(v % (1 << 32)), 8, "0")

            made = F.unhex(F.array_join(counted(F.ceil(n / 5), group, F.array().cast("array<string>")), ""))
            return F.substring(made, F.lit(1), F.greatest(F.floor((n + 4) / 5) * 4 - F.pmod(-n, F.lit(5)), F.lit(0)).cast("int"))

        return let(F.rpad(own, n + F.pmod(-n, F.lit(5)), "u"), data)

    return let(own, whole)


def run_lengths(data: Column) -> Column:
    """Bytes as runs: each run of equal bytes is (257 - length, byte), 128 long at most, then the end mark."""
    digits = F.regexp_replace(F.hex(data), "(..)", "$1 ")
    runs = F.regexp_extract_all(digits, F.lit(r"([0-9A-F]{2} )\1{0,127}"), F.lit(0))
    # A run of one byte can't be written as a repeat: it is a copy of one.
    each = F.transform(runs, lambda r: F.when(F.length(r) == 3, F.concat(F.lit("00"), F.substring(r, 1, 2))).otherwise(F.concat(F.lpad(F.hex(257 - F.floor(F.length(r) / 3)), 2, "0"), F.substring(r, 1, 2))))
    return F.unhex(F.concat(F.array_join(each, ""), F.lit("80")))


def from_run_lengths(data: Column) -> Column:
    """Bytes of runs up to the end mark, or as far as they go."""
    return let(F.hex(data), _from_runs)


def _from_runs(digits: Column) -> Column:
    n = F.floor(F.length(digits) / 2).cast("int")
    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, i: Column) -> Column:
        def run(size: Column) -> Column:
            copied = F.substring(digits, 2 * i + 3, 2 * (size + 1))
            again = F.repeat(F.substring(digits, 2 * i + 3, F.lit(2)), 257 - size)
            some = F.when(size < 128, F.struct((i + size + 2).alias("next"), F.concat(s["done"], F.array(copied)).alias("done"))).when(size > 128, F.struct((i + 2).alias("next"), F.concat(s["done"], F.array(again)).alias("done")))
            # An end mark: nothing is next.
            return F.coalesce(some, F.struct(F.lit(-1).alias("next"), s["done"].alias("done")))

        return F.when(i != s["next"], s).otherwise(let(F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int"), run))

    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.unhex(F.array_join(F.aggregate(places, start, step)["done"], ""))


def _paeth(left: Column, up: Column, corner: Column) -> Column:
    # How far left + up - corner is from each of the three.
    a, b, c = F.abs(up - corner), F.abs(left - corner), F.abs(left + up - corner - corner)
    return F.when((a <= b) & (a <= c), left).when(b <= c, up).otherwise(corner)


def _predicted(kind: Column, left: Column, up: Column, corner: Column) -> Column:
    return F.when(kind == 1, left).when(kind == 2, up).when(kind == 3, F.floor((left + up) / 2)).when(kind == 4, _paeth(left, up, corner)).otherwise(0).cast("int")


def _at(values: Column, i: Column) -> Column:
    return F.coalesce(F.get(values, i), F.lit(0))


def predicted(data: Column, columns: int, pixel: int, kinds: Column) -> Column:
    """data (rows of columns bytes) as PNG rows: each with the kind of its predictor before it. kinds is an array, a number for each row."""
    return let(byte_values(data), lambda values: _predicted_rows(values, columns, pixel, kinds))


def _predicted_rows(values: Column, columns: int, pixel: int, kinds: Column) -> Column:
    rows = F.ceil(F.size(values) / columns)

    def row(r: Column) -> Column:
        kind, base = F.get(kinds, r), r * columns

        def one(i: Column) -> Column:
            here = lambda back, above: F.when((i >= back) & (r >= above), _at(values, base + i - back - above * columns)).otherwise(0)
            return F.pmod(_at(values, base + i) - _predicted(kind, here(pixel, 0), here(0, 1), here(pixel, 1)), F.lit(256)).cast("int")

        return F.concat(F.array(kind.cast("int")), F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), one))

    return from_byte_values(F.flatten(counted(rows, row, F.array().cast("array<array<int>>"))))


def unpredicted(data: Column, columns: int, pixel: int) -> Column:
    """The bytes of PNG rows (a kind of predictor, then columns bytes each; pixel bytes apart are neighbours): None, Sub, Up, Average and Paeth.

    A last row that is cut off counts as filled up with zeros. A kind that there is none of counts as None.
    """
    return let(byte_values(data), lambda values: _unpredicted_rows(values, columns, pixel))


def _unpredicted_rows(values: Column, columns: int, pixel: int) -> Column:
    rows = F.ceil(F.size(values) / (columns + 1))
    numbers = F.when(rows > 0, F.sequence(F.lit(0), (rows - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.array().cast("array<int>").alias("above"), F.array().cast("array<array<int>>").alias("done"))

    def row(s: Column, r: Column) -> Column:
        base = r * (columns + 1)
        kind = _at(values, base)

        def one(made: Column, i: Column) -> Column:
            before = i >= pixel
            near = F.struct(F.when(before, F.get(made, i - pixel)).otherwise(0).alias("left"), _at(s["above"], i).alias("up"), F.when(before, _at(s["above"], i - pixel)).otherwise(0).alias("corner"))
            v = let(near, lambda x: F.pmod(_at(values, base + 1 + i) + _predicted(kind, x["left"], x["up"], x["corner"]), F.lit(256)).cast("int"))
            return F.concat(made, F.array(v))

        line = F.aggregate(F.sequence(F.lit(0), F.lit(columns - 1)), F.array().cast("array<int>"), one)
        return F.struct(line.alias("above"), F.concat(s["done"], F.array(line)).alias("done"))

    return from_byte_values(F.flatten(F.aggregate(numbers, start, row)["done"]))


def undifferenced(data: Column, columns: int, pixel: int) -> Column:
    """The bytes of rows in which each byte is what it adds to the one pixel bytes before it (the predictor of TIFF, 8 bits)."""

    def whole(values: Column) -> Column:
        def row(r: Column) -> Column:
            one = lambda made, i: F.concat(made, F.array(F.pmod(_at(values, r * columns + i) + F.when(i >= pixel, F.get(made, i - pixel)).otherwise(0), F.lit(256)).cast("int")))
            return F.aggregate(F.sequence(F.lit(0), F.lit(columns - 1)), F.array().cast("array<int>"), one)

        rows = F.ceil(F.size(values) / columns)
        return F.substring(from_byte_values(F.flatten(counted(rows, row, F.array().cast("array<array<int>>")))), F.lit(1), F.size(values))

    return let(byte_values(data), whole)
