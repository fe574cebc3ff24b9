"""Best-fit packing of token sequences, improved by swap-based local search.

Pieces are dealt by a hash of their row into groups of about GROUP pieces, each
packed alone, so the whole costs less than one extra sequence for each group.
In a group, best-fit decreasing gives a first packing. Then the emptiest bin
gives its documents away: a document moves into a bin with room, or is
exchanged for a smaller one, or any two are exchanged for one, each time so
that the sum of squared fills grows; a bin that is stuck is left for the next
least filled one. The search ends when no exchange is left in any bin or the
group has as few bins as its tokens allow.

Nulls: a null text counts as empty (the end id alone); a null doc_id is a
document of its own kind and is carried through. Repeated doc_ids are packed
as documents of their own. A very long text is many full pieces. Columns other
than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, table, vocabulary, written
from .wordcache import encoder

GROUP = 8_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: only the first may be shorter than room."""
    first = n % room or room
    return [(0, min(n, first))] + [(s, room) for s in range(first, n, room)] if n else []


def pieces(docs: DataFrame, path: str, room: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of each piece."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, tail = encoder(path), end_id.to_bytes(4, "little")
        for batch in batches:
            rows, texts = [], batch.column("text")
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids = e.encode(text := texts[i].as_py()) + tail
                if not i:
                    e.check(text)
                for k, (start, n) in enumerate(cut(len(ids) // 4, room)):
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((doc_id, k, start, n, zlib.crc32(own), own if with_ids else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    out = narrow(docs).mapInArrow(encoded, PIECES)
    return out if with_ids else out.drop("ids")


def best_fit(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers by bin."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(room + 1)]
    gaps: list[int] = []  # those that a bin has, in order
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        k = bisect_left(gaps, n)
        if k < len(gaps):
            gap = gaps[k]
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps.pop(k)
            bins[b].append(int(i))
        else:
            gap, b = room, len(bins)
            bins.append([int(i)])
        left = gap - n
        if not by_gap[left]:
            insort(gaps, left)
        by_gap[left].append(b)
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, room: int) -> list[list[int]]:
    """Empties the least filled bins again and again, by moves and exchanges that each raise the sum of squared fills."""
    least = -(-int(sizes.sum()) // room)
    fill = np.array([sum(int(sizes[i]) for i in b) for b in bins], dtype=np.int64)
    place = np.empty(len(sizes), dtype=np.int64)
    for b, own in enumerate(bins):
        place[own] = b
    alive = np.ones(len(bins), dtype=bool)

    def put(i: int, b: int) -> None:
        a = place[i]
        bins[a].remove(i)
        bins[b].append(i)
        fill[a] -= sizes[i]
        fill[b] += sizes[i]
        place[i] = b

    def step(a: int) -> bool:
        """One move or exchange out of bin a; False if there is none."""
        own = sorted(bins[a], key=lambda i: -sizes[i])
        others = alive.copy()
        others[a] = False
        gap = np.where(others, room - fill, -1)
        for i in own:
            fits = np.flatnonzero((gap >= sizes[i]) & (fill + sizes[i] > fill[a]))
            if len(fits):
                put(i, int(fits[np.argmin(gap[fits])]))
                return True
        item_gap = gap[place]
        # An item can be exchanged for n tokens of a if low <= n <= sizes + item_gap: the marks add up to how many can, for each n.
        low = np.maximum(sizes, fill[a] - fill[place] + sizes) + 1
        on = (item_gap >= 0) & (low <= sizes + item_gap)
        marks = np.bincount(low[on], minlength=room + 2)[: room + 2] - np.bincount((sizes + item_gap + 1)[on], minlength=room + 2)[: room + 2]
        can = np.cumsum(marks) > 0
        own_sizes = sizes[own]
        out = tuple(own[x] for x in np.flatnonzero(can[own_sizes])[:1])
        if not out:
            # Pairs by their two lengths, of which a bin has few different ones.
            kinds, first, times = np.unique(-own_sizes, return_index=True, return_counts=True)
            sums = np.minimum(-(kinds[:, None] + kinds), room + 1)
            fit = np.triu(np.append(can[: room + 1], False)[sums])
            fit[np.diag_indices(len(kinds))] &= times > 1
            x, y = (v[:1] for v in np.nonzero(fit))
            out = tuple(own[k] for p, q in zip(x, y, strict=True) for k in (first[p], first[q] + (p == q)))
        if not out:
            return False
        n = int(sizes[list(out)].sum())
        fits = np.flatnonzero(on & (low <= n) & (sizes + item_gap >= n))
        back = int(fits[np.argmin(sizes[fits] + item_gap[fits])])
        b = int(place[back])
        put(back, a)
        for i in out:
            put(i, b)
        return True

    # A bin that is stuck is left for the next least filled one; what that one does may free those that were stuck.
    stuck = np.zeros(len(bins), dtype=bool)
    while alive.sum() > least and (left := np.flatnonzero(alive & ~stuck)).size:
        a = int(left[np.argmin(fill[left])])
        moved = False
        while bins[a] and step(a):
            moved = True
        if moved:
            stuck[:] = False
        if bins[a]:
            stuck[a] = True
        else:
            alive[a] = False
    return [b for b, on in zip(bins, alive, strict=True) if on and b]


def pack(sizes: np.ndarray, room: int) -> list[list[int]]:
    return improve(best_fit(sizes, room), sizes, room)


def packed(cut_pieces: DataFrame, room: int, group: int = GROUP) -> DataFrame:
    """cut_pieces (doc_id, piece, length, ...; a written table) with sequence_id and offset."""
    total = cut_pieces.count()
    groups = max(1, -(-total // group))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema)
    names = cut_pieces.columns

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.select(names).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = rows.column("length").to_numpy()
        sequence, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for b, own in enumerate(pack(sizes, room)):
            sequence[own] = (key[0].as_py() << 32) + b
            offset[own] = np.cumsum(sizes[own]) - sizes[own]
        return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    # Dealt by the row's number in the table, so rows that are alike in everything are spread too.
    dealt = cut_pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("pack_group").applyInArrow(place, f"{out}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, room: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    return packed(written(pieces(docs, path, room, end_id, with_ids), "pieces"), room)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), path or vocabulary("byte_bpe_50k.json"))
