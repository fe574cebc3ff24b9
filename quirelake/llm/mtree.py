"""Exact top-k search by inner product with M-trees.

Vectors are dealt by the nearest of a few pivots, and the rows of a pivot by a
hash into shards of about SHARD rows. Each shard is
an M-tree: pages of entries, an inner page's entry having a routing object, a
covering radius, the distance to the page's own routing object and a child
page. A vector x is given one more component, sqrt(R - |x|^2) with R the
shard's largest squared length; then Euclidean distances from a query (which
has 0 there) fall as inner products grow, and the triangle inequality holds.

Queries first meet one shard of their nearest pivot. The k-th score found there
is a bound that every other shard has to reach. Then blocks of queries of the
same pivot meet the shards of those pivots whose covering radius leaves one of
them such a score, many blocks for each copy of a tree. A block's search is
best-first by the distance that a page's radius leaves at least. A page is
entered only for queries which it can still serve, and for those a distance is
computed only if the stored distance to the parent does not rule the entry out.
Scores are exact integers, whatever their size: products whose sums may not fit
a double are added up in halves of 16 bits, and beyond 62 bits as Python's
integers. Bounds cut strictly, so ties are all seen.

Vectors that are null or hold null or non-finite components take no part. A
shorter vector counts as filled up with zeros, an empty one too. A score that
does not fit a long is null, and ranked all the same. Double components beyond
1e150 are an error; those of floats are all fine. Rows that share a vec_id are
candidates of each other; only the query's own row is left out. Null vec_ids are no queries, and
as candidates lose ties to all others; no id is a mark for them. An empty table
gives no rows. Columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARD, BLOCK = 4_096, 512
#: Pivots at most: one row each, the only vectors that go to every task. Blocks of queries that meet a copy of a tree.
PIVOTS, BLOCKS = 256, 64
#: Shards at least, so that a small table is not the work of a few tasks.
LEAST_SHARDS = 12
PAGE, FAN = 48, 12
#: Components beyond it have squares whose sums no double holds.
LARGEST = 1e150
#: Sums of products up to here are exact in doubles, and in 64-bit integers.
IN_DOUBLES, IN_LONGS = float(1 << 52), float(1 << 62)
NONE = np.iinfo(np.int64).min


def scorer(q: np.ndarray, points: np.ndarray):
    """A function of rows of q and rows of points that gives their inner products exactly, and which arithmetic that takes."""
    # No partial sum is beyond the product of the lengths.
    length = lambda x: float(np.sqrt((x**2).sum(axis=1).max(initial=0)))
    most = length(q) * length(points)
    if most < IN_DOUBLES:
        return lambda a, b: (q[a] @ points[b].T).astype(np.int64), "doubles"
    if most < IN_LONGS and max(np.abs(q).max(initial=0), np.abs(points).max(initial=0)) < 1 << 31:
        halves = lambda x: (np.floor(x / 65536), np.mod(x, 65536))
        (qh, ql), (ph, pl) = halves(q), halves(points)
        whole = lambda x: x.astype(np.int64)

        def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (whole(qh[a] @ ph[b].T) << 32) + (whole(qh[a] @ pl[b].T + ql[a] @ ph[b].T) << 16) + whole(ql[a] @ pl[b].T)

        return added, "halves"
    python = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return lambda a, b: python(q[a]) @ python(points[b]).T, "python"


def _first(score: np.ndarray, place: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """In each row, where the k best are: by score, falling, then by place; those that are none last."""
    if score.dtype != object:
        return np.lexsort((place, ~score, none), axis=1)[:, :k]
    return np.array([sorted(range(len(s)), key=lambda i, s=s, p=p, x=x: (x[i], -s[i], p[i]))[:k] for s, p, x in zip(score, place, none, strict=True)])


@dataclass
class Page:
    leaf: bool
    point: np.ndarray  # routing objects, or the points of a leaf
    to_parent: np.ndarray
    radius: np.ndarray
    child: list = field(default_factory=list)


class MTree:
    """An M-tree over distinct integer vectors (rows of points); rows[i] are the numbers of the rows that have vector i."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray, keep: int):
        """order: row numbers by rank in a tie; each distinct vector keeps its first keep rows."""
        self.points, owner = np.unique(vectors, axis=0, return_inverse=True)
        owner = owner.ravel()
        by = order[np.argsort(owner[order], kind="stable")]
        starts = np.searchsorted(owner[by], np.arange(len(self.points)))
        ends = np.append(starts[1:], len(by))
        self.rows = [by[a : min(b, a + keep)] for a, b in zip(starts, ends, strict=True)]
        square = (self.points.astype(np.float64) ** 2).sum(axis=1)
        self.largest = float(square.max(initial=0))
        self.lifted = np.column_stack([self.points.astype(np.float64), np.sqrt(np.maximum(self.largest - square, 0))])
        self.pages: list[Page] = []
        self.random = np.random.default_rng(0)
        self.root = self._build(np.arange(len(self.points)), None)
        del self.lifted, self.random

    def _far(self, a: np.ndarray, b: int) -> np.ndarray:
        return np.sqrt(((self.lifted[a] - self.lifted[b]) ** 2).sum(axis=1))

    def _build(self, own: np.ndarray, parent: int | None) -> int:
        away = self._far(own, parent) if parent is not None else np.zeros(len(own))
        if len(own) <= PAGE:
            self.pages.append(Page(True, own, away, np.zeros(len(own))))
            return len(self.pages) - 1
        fan = min(FAN, -(-len(own) // PAGE))
        pivots = own[self.random.choice(len(own), fan, replace=False)]
        near = np.stack([self._far(own, p) for p in pivots])
        nearest = near.argmin(axis=0)
        if (np.bincount(nearest, minlength=fan) == len(own)).any():
            nearest = np.arange(len(own)) % fan
        page = Page(False, pivots, np.zeros(fan), np.zeros(fan))
        used = [k for k in range(fan) if (nearest == k).any()]
        page.point, page.radius = pivots[used], np.array([near[k][nearest == k].max() for k in used])
        page.to_parent = self._far(page.point, parent) if parent is not None else np.zeros(len(used))
        page.child = [self._build(own[nearest == k], int(pivots[k])) for k in used]
        self.pages.append(page)
        return len(self.pages) - 1

    def search(self, queries: np.ndarray, own_row: np.ndarray, k: int, rank: np.ndarray, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
        """Best k rows for each query: scores and row numbers (-1: none), and counts of distances computed and avoided.

        own_row: the row left out for each query (-1: none). rank: place of each row in a tie. floor: scores below it are not wanted.
        """
        n = len(queries)
        floor = np.full(n, -np.inf) if floor is None else floor
        q = queries.astype(np.float64)
        square = (q**2).sum(axis=1)
        points = self.points.astype(np.float64)
        best = np.full((n, k), NONE, np.int64)
        edge = np.full(n, -np.inf)  # the last of the best, as a double
        rows = np.full((n, k), -1, np.int64)
        places = np.full((n, k), np.iinfo(np.int64).max)
        done = {"computed": 0, "avoided": 0}
        slack = 1e-9 * (1 + square + self.largest)

        def reach(bound: np.ndarray, sel: np.ndarray) -> np.ndarray:
            """Whether an object at least so far away can still be among the best."""
            return (square[sel, None] + self.largest - np.maximum(bound, 0) ** 2) / 2 >= np.maximum(edge[sel, None], floor[sel, None]) - slack[sel, None]

        exact, kind = scorer(q, points)
        margin = np.zeros(n) if kind == "doubles" else 1e-7 * np.sqrt(square + self.largest)
        queue = [(0.0, 0, self.root, np.zeros(n), np.zeros(n), True)]
        number = 0
        while queue:
            _, _, at, away, bound, top = heapq.heappop(queue)
            sel = np.flatnonzero(np.isfinite(bound))
            sel = sel[reach(bound[sel, None], sel)[:, 0]]
            if not len(sel):
                continue
            page = self.pages[at]
            least = np.zeros((len(sel), len(page.point))) if top else np.abs(away[sel, None] - page.to_parent) - page.radius - margin[sel, None]
            need = reach(np.maximum(least, bound[sel, None]), sel)
            done["avoided"] += need.size - int(need.sum())
            cols = np.flatnonzero(need.any(axis=0))
            some = need.any(axis=1)
            sel, need = sel[some], need[some][:, cols]
            if not len(cols):
                continue
            done["computed"] += len(sel) * len(cols)
            if page.leaf:
                score = exact(sel, page.point[cols])
                hot = (score.astype(float) >= np.maximum(edge[sel, None], floor[sel, None]) - slack[sel, None]).any(axis=1)
                if not hot.any():
                    continue
                who = sel[hot]
                own = [self.rows[p] for p in page.point[cols]]
                each = np.concatenate(own)
                s = np.repeat(score[hot], [len(o) for o in own], axis=1)
                left_out = each[None, :] == own_row[who, None]
                all_r = np.concatenate([rows[who], np.where(left_out, -1, each)], axis=1)
                all_s = np.concatenate([best[who].astype(s.dtype), s], axis=1)
                all_p = np.concatenate([places[who], np.broadcast_to(rank[each], s.shape)], axis=1)
                first = _first(all_s, all_p, all_r < 0, k)
                best = best.astype(s.dtype, copy=False)
                best[who], rows[who], places[who] = (np.take_along_axis(x, first, axis=1) for x in (all_s, all_r, all_p))
                edge[who] = np.where(rows[who, -1] >= 0, best[who, -1].astype(float), -np.inf)
                continue
            score = q[sel] @ points[page.point[cols]].T
            far = np.sqrt(np.maximum(square[sel, None] + self.largest - 2 * score, 0))
            low = np.maximum(far - page.radius[cols] - 1e-7 * (1 + far) - margin[sel, None], bound[sel, None])
            for j, c in enumerate(cols):
                ok = need[:, j]
                child_away, child_bound = np.zeros(n), np.full(n, np.inf)
                child_away[sel[ok]], child_bound[sel[ok]] = far[ok, j], low[ok, j]
                number += 1
                heapq.heappush(queue, (float(low[ok, j].min()), number, page.child[c], child_away, child_bound, False))
        rows[best.astype(float) < floor[:, None] - slack[:, None]] = -1
        return best, rows, done


def _matrix(vectors) -> np.ndarray:
    """Whole numbers: as 32-bit integers if they fit, or as doubles, which hold each of them exactly."""
    size = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(out * 64.0)
    most = np.abs(out).max(initial=0)
    if not most <= LARGEST:
        raise ValueError("a component is too large for exact scores")
    return out.astype(np.int32) if most < 1 << 31 else out


def _ids(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which ids are null, the ids (0 for null), the row numbers."""
    ids = rows.column("id").combine_chunks()
    return ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False), rows.column("row").to_numpy()


def scaled(vectors: DataFrame) -> DataFrame:
    """row, id, vector (as doubles; tasks take the floor of 64 times each component) of the rows of vectors (vec_id, embedding) that take part."""
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    some = vectors.where(F.col("embedding").isNotNull() & fine)
    return some.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def _wide(x: np.ndarray, size: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, size - x.shape[1]))) if x.shape[1] < size else x


def near_pivots(vectors: DataFrame, pivots: np.ndarray, name: str) -> DataFrame:
    """vectors (row, id, vector) with the number of the nearest pivot, and how far away it is."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector").to_pylist())
            size = max(x.shape[1], pivots.shape[1])
            at, x = _wide(pivots, size).astype(np.float64), _wide(x, size).astype(np.float64)
            near = ((at**2).sum(axis=1) - 2 * x @ at.T).argmin(axis=1).astype(np.int32)
            away = np.sqrt(((x - at[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(away)], [*batch.schema.names, name, "away"])

    return vectors.mapInArrow(each, f"row bigint, id bigint, vector array<double>, {name} int, away double")


def top_k(candidates: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates (row, id, vector) of each query (same columns); rows with equal ``row`` are left out."""
    n, m = candidates.count(), queries.count()
    shard = max(1, min(shard, -(-n // LEAST_SHARDS)))
    some = candidates.orderBy(F.xxhash64("row")).limit(max(1, min(PIVOTS, n // shard))).collect()
    pivots = _matrix([r.vector for r in some] or [[0]])
    dealt = written(near_pivots(candidates, pivots, "pivot"), "dealt")
    asked = written(near_pivots(queries, pivots, "pivot"), "asked")
    # The rows of a pivot go to as many shards as they fill; PIVOTS counts and radii at most come to the driver.
    counted = dealt.groupBy("pivot").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()
    sizes, radius = ({r.pivot: -(-r["n"] // shard) for r in counted}, np.full(len(pivots), -1.0))
    for r in counted:
        radius[r.pivot] = r.radius
    first, shards = {}, 0
    for p in sorted(sizes):
        first[p], shards = shards, shards + sizes[p]
    blocks = max(1, -(-m // block))
    number = F.create_map(*(F.lit(x) for p in sorted(sizes) for x in (p, first[p]))) if sizes else F.create_map(F.lit(0), F.lit(0))
    parts = F.create_map(*(F.lit(x) for p in sorted(sizes) for x in (p, sizes[p]))) if sizes else F.create_map(F.lit(0), F.lit(1))
    deal = lambda: (F.coalesce(number[F.col("pivot")], F.lit(0)) + F.pmod(F.xxhash64("row"), F.coalesce(parts[F.col("pivot")], F.lit(1)))).cast("int")

    def tree(key: tuple, rows: pa.Table) -> pa.Table:
        none, ids, own = _ids(rows)
        order = np.lexsort((own, ids, none))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        made = MTree(_matrix(rows.column("vector").to_pylist()), order, k + 1)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps((made, none, ids, own, rank))], pa.binary())})

    def packed(key: tuple, rows: pa.Table) -> pa.Table:
        _, ids, own = _ids(rows)
        floor, q = rows.column("floor").to_numpy().astype(np.float64), _matrix(rows.column("vector").to_pylist())
        # No row of a pivot scores more than its centre does and its radius adds.
        size = max(q.shape[1], pivots.shape[1])
        x, at = _wide(q, size).astype(np.float64), _wide(pivots, size).astype(np.float64)
        far = np.sqrt((x**2).sum(axis=1))[:, None]
        most = x @ at.T + far * radius + 1e-9 * (1 + far * (radius + np.sqrt((at**2).sum(axis=1))))
        reached = np.flatnonzero((radius >= 0) & (most >= floor[:, None]).any(axis=0))
        return pa.table({"block": pa.array([key[0].as_py()], pa.string()), "queries": pa.array([pickle.dumps((q, ids, own, floor))], pa.binary()), "reached": pa.array([reached.tolist()], pa.list_(pa.int32()))})

    def search(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        out = [[pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary())]]
        for made in trees.column("tree"):
            tree, none, ids, own, rank = pickle.loads(made.as_py())
            at = {r: i for i, r in enumerate(own.tolist())}
            for block in blocks.column("queries"):
                q, query_id, query_row, floor = pickle.loads(block.as_py())
                size = max(tree.points.shape[1], q.shape[1])
                tree.points = _wide(tree.points, size)
                left_out = np.array([at.get(r, -1) for r in query_row.tolist()], np.int64)
                score, row, _ = tree.search(_wide(q, size), left_out, k, rank, floor)
                who, place = np.nonzero(row >= 0)
                hit = row[who, place]
                out.append([pa.array(query_row[who]), pa.array(query_id[who]), pa.array(ids[hit], mask=none[hit]), pa.array(own[hit]), *_told(score[who, place])])
        return pa.table([pa.chunked_array(c) for c in zip(*out, strict=True)], ["query_row", "query_id", "vec_id", "row", "score", "side", "wide"])

    def met(places: DataFrame) -> DataFrame:
        """What the trees find for the blocks (shard, part, queries), copied to as many parts as there are."""
        copies = places.select(F.col("shard").alias("of"), F.col("part").alias("copy")).distinct()
        copied = trees.join(copies, F.col("shard") == F.col("of")).select("of", "copy", "tree")
        return copied.groupBy("of", "copy").cogroup(places.groupBy("shard", "part")).applyInArrow(search, "query_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint, side tinyint, wide binary")

    trees = written(dealt.withColumn("shard", deal()).groupBy("shard").applyInArrow(tree, "shard int, tree binary"), "trees")
    # A bound for each query: the k-th score in one shard of its nearest pivot.
    sent_as = "block string, queries binary, reached array<int>"
    per_home = max(1, blocks // max(1, shards))
    home = asked.withColumn("floor", F.lit(float("-inf"))).withColumn("shard", deal()).withColumn("block", F.concat_ws("-", "shard", F.pmod(F.xxhash64("row"), F.lit(per_home))))
    at_home = home.groupBy("block").applyInArrow(packed, sent_as).withColumn("shard", F.split_part("block", F.lit("-"), F.lit(1)).cast("int")).withColumn("part", F.floor(F.split_part("block", F.lit("-"), F.lit(2)).cast("int") / BLOCKS).cast("int"))
    # A floor that doubles round stays below the score; a score beyond 64 bits counts as none.
    scores = met(at_home).groupBy("query_row").agg(F.count("score").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    low = F.col("floor").cast("double")
    floors = written(scores.select(F.col("query_row").alias("row"), (low - F.abs(low) * 1e-12).alias("floor")), "floors")
    # A stated set of queries against the shards that they can reach, block by block; a block's queries have one pivot.
    bounded = asked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    asking = {r.pivot: -(-r["count"] // block) for r in asked.groupBy("pivot").count().collect()}  # PIVOTS counts at most
    split = F.create_map(*(F.lit(x) for p in sorted(asking) for x in (p, asking[p]))) if asking else F.create_map(F.lit(0), F.lit(1))
    bounded = bounded.withColumn("block", F.concat_ws("-", "pivot", F.pmod(F.xxhash64("row"), split[F.col("pivot")])))
    sent = written(bounded.groupBy("block").applyInArrow(packed, sent_as), "blocks")
    found = met(reaching(sent, first, sizes, blocks))
    order = Window.partitionBy("query_row").orderBy(F.col("side").desc(), F.col("wide").desc(), F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def reaching(sent: DataFrame, first: dict[int, int], sizes: dict[int, int], blocks: int) -> DataFrame:
    """The blocks (queries, reached) with each shard that one of their queries may find something in, and the copy of its tree that they meet."""
    own = [F.lit(x) for p in sorted(sizes) for x in (p, F.sequence(F.lit(first[p]), F.lit(first[p] + sizes[p] - 1)))]
    shards = F.create_map(*own) if own else F.create_map(F.lit(0), F.array(F.lit(0)))
    each = F.flatten(F.transform("reached", lambda p: shards[p]))
    return sent.select("queries", F.explode(each).alias("shard"), F.pmod(F.xxhash64("block"), F.lit(-(-blocks // BLOCKS))).cast("int").alias("part"))


def _told(scores: np.ndarray) -> list[pa.Array]:
    """Scores as longs; those that don't fit as null, with their side (1 above, -1 below) and bytes that sort as they do."""
    if scores.dtype != object:
        return [pa.array(scores), pa.array(np.zeros(len(scores), np.int8)), pa.array([None] * len(scores), pa.binary())]
    fits = [-(1 << 63) <= s < 1 << 63 for s in scores]
    wide = [None if ok else (s + (1 << 1100)).to_bytes(138, "big") for s, ok in zip(scores, fits, strict=True)]
    return [pa.array([s if ok else None for s, ok in zip(scores, fits, strict=True)], pa.int64()), pa.array([0 if ok else 1 if s > 0 else -1 for s, ok in zip(scores, fits, strict=True)], pa.int8()), pa.array(wide, pa.binary())]


def op2_mtree_top_k(spark: SparkSession, sf_dir: str, k: int = 20, every: int = 20) -> DataFrame:
    vectors = written(scaled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "vectors")
    return top_k(vectors, vectors.where(F.col("id") % every == 0), k)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(cast(x AS DOUBLE) * 64) AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
