"""Near-duplicate classes by BagMinHash.

A text is a multiset of five-word shingles (words: runs of bytes that are no
ASCII white space; a text of fewer words is one shingle). Weights are counts,
discretised to whole numbers. For each shingle and each interval [0, 1),
[1, 2), [2, 4), [4, 8), ... of weight a Poisson process of that length as its
rate makes points in ascending order, each with a slot of the signature and a
level in the interval; the levels below the shingle's weight count, which
splits only the one interval that the weight falls into. A slot keeps its least
point, so two signatures agree in a slot with probability equal to the weighted
Jaccard similarity. A text's processes are followed only as long as a point can
still lower a slot.

Bands of the signature give buckets. Texts with equal multisets are collapsed
first. In a bucket all rows are compared with a pivot, the row with the most
company in its buckets: mostly the text that the others are copies of. Each
such pair is verified once, by exact multiset overlap, and verified links give
connected components by alternating large and small stars. That leaves pairs of
a bucket in different components. They are not listed. The rows of a bucket's
largest component need not meet each other, only the others, which are few
where a bucket is large because of copies. A bucket that is too large for one
block is cut into blocks by rows and by bytes, those of the largest component
apart; each two blocks that have to meet do so in a task of their own. A pair
is looked at in the first of the buckets that it shares, and is compared by
sketch (a byte for each slot). Pairs whose sketches agree as those of similar
texts do, up to FAR standard deviations less, are compared by their multisets
in 32 bits there and then, and only those that are similar come out, are
verified as well, and join components. The work left grows with the product of
the rows outside a bucket's largest component and the bucket.

Null or empty texts, and texts of white space, have no shingle and are classes
of their own. Rows with the same doc_id are one node, whichever texts they
have. Null doc_ids are classes of their own, with a null class_id. Texts of any
length are hashed whole. Columns other than doc_id and text are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.joins import spread_join

from .common import narrow, table, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: Standard deviations below the expected agreement of sketches at which a pair is passed over (one in three million).
FAR = 5.0
#: Rows of a bucket, and bytes of their multisets, in a block.
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Pairs of one pivot in a task, about.
SALT = 4_096
#: Ids are broadcast up to this many (16 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 200_000
U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * GOLDEN)
_SHIFT = [mix(np.array([7 + i], U))[0] | U(1) for i in range(WORDS + 1)]


def shingle_hashes(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """64-bit hashes of the shingles of each text, in order, repeats included."""
    raws = [t.encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    raw = np.frombuffer(b"".join(raws), np.uint8)
    if not len(raw):
        return []
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(r) for r in raws])
    upto = np.searchsorted(first, ends, side="left")
    if not len(first):
        return [np.zeros(0, U) for _ in texts]
    at = np.repeat(first, last - first)
    letters = raw[inside]
    place = np.flatnonzero(inside) - at
    values = mix(_BYTE[letters] + place.astype(U) * GOLDEN)
    word = mix(np.add.reduceat(values, np.cumsum(last - first) - (last - first)))
    out = []
    for a, b in zip(np.concatenate([[0], upto[:-1]]), upto, strict=True):
        own = word[a:b]
        n = min(words, len(own))
        if not n:
            out.append(np.zeros(0, U))
            continue
        h = np.zeros(len(own) - n + 1, U) + U(n)
        for i in range(n):
            h = (h ^ own[i : len(own) - n + 1 + i]) * _SHIFT[i]
            h ^= h >> U(29)
        out.append(mix(h))
    return out


def expanded(unique: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The multiset as a set: the k-th occurrence of a shingle is an element of its own."""
    if counts.max(initial=1) == 1:
        return unique
    k = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    h = np.repeat(unique, counts)
    return np.where(k == 0, h, mix(h + k.astype(U) * GOLDEN))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int) -> np.ndarray:
    """BagMinHash signatures (bags x slots, as the bits of each slot's least point) of bags (shingles, counts), none empty."""
    n = len(bags)
    least = np.full(n * slots, np.inf)
    doc = np.repeat(np.arange(n), [len(h) for h, _ in bags])
    shingle = np.concatenate([h for h, _ in bags])
    weight = np.concatenate([c for _, c in bags]).astype(np.int64)
    # One process for each interval that the weight reaches into: [0, 1), then [2**(k-1), 2**k).
    procs = []
    k = 0
    while len(doc):
        low = 0 if k == 0 else 1 << (k - 1)
        reach = weight > low
        doc, shingle, weight = doc[reach], shingle[reach], weight[reach]
        if len(doc):
            procs.append((doc, mix(shingle + GOLDEN * np.full(1, k + 1, U)), weight, np.full(len(doc), low), np.full(len(doc), max(low, 1))))
        k += 1
    doc, state, weight, low, length = (np.concatenate(x) for x in zip(*procs, strict=True))
    time, rate = np.zeros(len(doc)), length.astype(np.float64)
    while len(doc):
        state = state + GOLDEN
        a = mix(state)
        b = mix(a + GOLDEN)
        time = time - np.log((a >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate
        slot = (b % U(slots)).astype(np.int64)
        level = low + ((b >> U(32)) % length.astype(U)).astype(np.int64)
        counts = level < weight
        np.minimum.at(least, doc[counts] * slots + slot[counts], time[counts])
        live = np.unique(doc)
        most = np.full(n, -1.0)
        most[live] = least.reshape(n, slots)[live].max(axis=1)
        on = time <= most[doc]
        doc, state, weight, low, length, time, rate = (x[on] for x in (doc, state, weight, low, length, time, rate))
    return least.view(U).reshape(n, slots)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band (bags x bands)."""
    out = np.zeros((len(signature), bands), U) + mix(np.arange(1, bands + 1, dtype=U) * GOLDEN)
    for r in range(rows):
        out = mix((out ^ signature[:, r : bands * rows : rows]) * _SHIFT[0] + U(r))
    return out


def _batches(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most or i == len(texts) - 1:
            yield start, i + 1
            start, held = i + 1, 0


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, digest (of the multiset; null without shingles), keys (one for each band), sketch (a byte for each slot), size (shingles)."""

    def made_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in _batches(texts):
                bags = [np.unique(h, return_counts=True) for h in shingle_hashes(texts[a:b])]
                full = [i for i, (h, _) in enumerate(bags) if len(h)]
                digests, keys, short = [None] * len(bags), [None] * len(bags), [None] * len(bags)
                if full:
                    made = signatures([bags[i] for i in full], bands * rows)
                    found, bytes_ = band_keys(made, bands, rows).view(np.int64), mix(made).astype(np.uint8)
                    for i, own, sketch in zip(full, found, bytes_, strict=True):
                        short[i] = sketch.tobytes()
                        digests[i] = hashlib.blake2b(bags[i][0].tobytes() + bags[i][1].tobytes(), digest_size=16).digest()
                        keys[i] = own
                sizes = [int(c.sum()) for _, c in bags]
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary()), pa.array(sizes, pa.int64())], ["id", "digest", "keys", "sketch", "size"])

    return narrow(docs).where("doc_id IS NOT NULL").mapInArrow(made_of, "id bigint, digest binary, keys array<bigint>, sketch binary, size bigint")


def bags(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, elements (the multiset as a set of 64-bit numbers), short (32 bits of each) of the rows of docs named in ids (id)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _batches(texts):
                own = [expanded(*np.unique(h, return_counts=True)).view(np.int64) for h in shingle_hashes(texts[a:b])]
                short = [np.sort(x.view(U).astype("<u4")).tobytes() for x in own]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(own, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["id", "elements", "short"])

    few = ids.count() <= BROADCAST_IDS
    named = ids.select(F.col("id").alias("doc_id"))
    return narrow(docs).join(F.broadcast(named) if few else named, "doc_id", "left_semi").mapInArrow(each, "id bigint, elements array<bigint>, short binary")


def verified(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """a, b, similarity of pairs (a, b; a written table) by exact overlap. The pairs of a pivot with many are dealt over several tasks."""
    times = pairs.select(F.explode(F.array("a", "b")).alias("pivot")).groupBy("pivot").agg(F.floor(F.count("*") / SALT).cast("int").alias("parts")).where("parts > 0")
    times = written(times, "pivot-parts")
    few = times.count() <= BROADCAST_IDS
    parts = F.broadcast(times) if few else times

    def salted(df: DataFrame, end: str) -> DataFrame:
        """df with the number of parts of the id in end, 0 for all but the pivots with many pairs."""
        return df.join(parts.withColumnRenamed("pivot", end).withColumnRenamed("parts", f"{end}_parts"), end, "left").withColumn(f"{end}_parts", F.coalesce(f"{end}_parts", F.lit(0)))

    def copies(end: str) -> DataFrame:
        rows = salted(elements.select(F.col("id").alias(end), F.col("elements").alias(f"of_{end}")), end)
        return rows.withColumn(f"{end}_part", F.explode(F.sequence(F.lit(0), F.col(f"{end}_parts")))).drop(f"{end}_parts")

    salt = lambda end, other: F.pmod(F.xxhash64(other), F.col(f"{end}_parts") + 1).cast("int").alias(f"{end}_part")
    asked = salted(salted(pairs, "a"), "b").select("a", "b", salt("a", "b"), salt("b", "a"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    found = asked.join(copies("b"), ["b", "b_part"]).join(copies("a"), ["a", "a_part"]).select("a", "b", (both / (F.size("of_a") + F.size("of_b") - both)).alias("similarity"))
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


#: Which rows of a task meet: those of side 0 with those of side 1, or all with each other.
LEFT, RIGHT, ALL = 0, 1, 2


def alike(rows: DataFrame, least: int, similarity: float) -> DataFrame:
    """a, b of the pairs of a meeting in different components that are similar, each from the first bucket that it shares.

    rows: bucket, band, meeting, side, id, component, sketch, keys, short. They have to lie together by bucket and meeting and be sorted by them. least: bytes of two sketches that have to agree.
    """

    def compare(band: int, held: list[tuple]) -> pa.RecordBatch:
        side, ids, comps = (np.array([r[k] for r in held]) for k in (0, 1, 2))
        sketch = np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(len(held), -1)
        keys = np.array([r[4] for r in held], np.int64)[:, :band]
        sets = [np.frombuffer(r[5], "<u4") for r in held]
        size = np.array([len(x) for x in sets])
        first = np.cumsum(size) - size
        place, mark, a, b = None, None, [], []
        for i in np.flatnonzero(side != RIGHT):
            j = np.flatnonzero((comps != comps[i]) & ((side == RIGHT) if side[i] == LEFT else (ids > ids[i])))
            j = j[(sketch[j] == sketch[i]).sum(axis=1) >= least]
            j = j[~(keys[j] == keys[i]).any(axis=1)]
            if not len(j):
                continue
            if place is None:  # elements of all sets, one after another, as numbers from 0 on
                distinct, place = np.unique(np.concatenate(sets), return_inverse=True)
                mark = np.zeros(len(distinct), bool)
            own = place[first[i] : first[i] + size[i]]
            mark[own] = True
            if len(j) * 8 > len(held):
                both = np.add.reduceat(mark[place], first, dtype=np.int64)[j]
            else:
                both = np.array([np.count_nonzero(mark[place[first[k] : first[k] + size[k]]]) for k in j])
            mark[own] = False
            # Elements may have met in 32 bits, in either set: the more, the larger the sets.
            lost = 3 + (np.maximum(size[i], size[j]) ** 2 >> 28)
            j = j[both + lost >= similarity * (size[i] + size[j] - both - lost)]
            a += np.minimum(ids[i], ids[j]).tolist()
            b += np.maximum(ids[i], ids[j]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for bucket, band, meeting, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "band", "meeting", "side", "id", "component", "sketch", "keys", "short")), strict=True):
                if (bucket, band, meeting) != key:
                    if len(held) > 1:
                        yield compare(key[1], held)
                    key, held = (bucket, band, meeting), []
                held.append(row)
        if len(held) > 1:
            yield compare(key[1], held)

    return rows.mapInArrow(each, "a bigint, b bigint")


def meetings(apart: DataFrame, hot: DataFrame) -> DataFrame:
    """bucket, band, id, component, meeting, side: which rows (bucket, band, id, size, component) of buckets with several components have to meet where; hot: the buckets with most rows."""
    parts = apart.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    parts = parts.groupBy("bucket").agg(F.max_by(F.struct("component", "n", "bytes"), F.struct("n", F.bitwise_not("component"))).alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("components"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    cut = parts.where("components > 1").select(
        "bucket", F.col("most.component").alias("largest"), (blocks(F.col("n"), F.col("bytes")) == 1).alias("whole"),
        blocks(F.col("most.n"), F.col("most.bytes")).alias("inner"), blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("outer"),
    )
    cut = written(cut, "cuts")
    rows = apart.join(F.broadcast(cut), "bucket") if cut.count() <= BROADCAST_IDS else spread_join(apart, cut, ["bucket"], hot=hot)
    inside = F.col("component") == F.col("largest")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.when(inside, F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    number = lambda kind, i, j: F.concat_ws(",", F.lit(kind), i.cast("string"), j.cast("string"))
    own, upto = F.col("own"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda meeting, side: F.struct(meeting.alias("meeting"), side.cast("int").alias("side"))
    # Blocks of the largest component meet those of the others, which also meet each other.
    inner = F.transform(upto("outer"), lambda j: place(number("x", own, j), F.lit(LEFT)))
    across = F.transform(upto("inner"), lambda i: place(number("x", i, own), F.lit(RIGHT)))
    others = F.transform(upto("outer"), lambda j: place(number("y", F.least(own, j), F.greatest(own, j)), F.when(own == j, F.lit(ALL)).when(own < j, F.lit(LEFT)).otherwise(F.lit(RIGHT))))
    to = F.when(F.col("whole"), F.array(place(F.lit(""), F.lit(ALL)))).when(inside, inner).otherwise(F.concat(across, others))
    return rows.withColumn("to", F.explode(to)).select("bucket", "band", "id", "component", "to.meeting", "to.side")


def links(members: DataFrame, about: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) that connect all rows which share a bucket and are similar; members: bucket, band, id, size; about: id, sketch, keys."""
    sizes = written(members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket", "n"), "buckets")
    # At most 256 buckets hold over a 256th of the rows each: their rows go to many tasks wherever they are joined.
    shared = sizes.agg(F.sum("n")).first()[0] or 0
    hot = written(sizes.where(F.col("n") * 256 > shared).select("bucket"), "hot-buckets")
    left = written(spread_join(members, sizes, ["bucket"], hot=hot), "members")
    company = left.groupBy("id").agg(F.sum("n").alias("company"))
    pivots = written(left.join(company, "id").groupBy("bucket").agg(F.max_by("id", F.struct("company", F.bitwise_not("id"))).alias("pivot")), "pivots")
    elements = written(bags(docs, left.select("id").distinct()), "bags")
    to_pivot = spread_join(left, pivots, ["bucket"], hot=hot).where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    tested = written(verified(written(to_pivot, "pairs"), elements), "links")
    near = tested.where(F.col("similarity") >= similarity).select("a", "b")
    # What is left: rows of buckets of three or more that lie in different components.
    found = written(components(near), "parts")
    apart = left.where("n > 2").join(found, "id", "left").select("bucket", "band", "id", (F.col("size") * 4).alias("size"), F.coalesce("class_id", "id").alias("component"))
    carried = about.join(elements.select("id", "short"), "id")
    rows = meetings(written(apart, "apart"), hot).join(carried, "id").select("bucket", "band", "meeting", "side", "id", "component", "sketch", "keys", "short").repartition("bucket", "meeting").sortWithinPartitions("bucket", "band", "meeting")
    slots = BANDS * ROWS
    least = int(slots * similarity - FAR * (slots * similarity * (1 - similarity)) ** 0.5)
    more = written(alike(rows, least, similarity).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "more")
    return near.unionByName(written(verified(more, elements), "links").where(F.col("similarity") >= similarity).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """id, class_id (least id of the connected component) for all ids of edges (a, b)."""
    own = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Joins each node's neighbours (larger ones, or smaller ones and itself) to the least of all."""
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else written(e, "large")
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")), "least")
        joined = spread_join(both, least, ["u"])  # a hub's neighbours are many
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(joined.select("u", F.col("least").alias("v")))
        return out.where("u <> v").distinct()

    mark = None
    while True:
        own = written(star(star(own, True), False), "small")
        now = tuple(own.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return own.groupBy("u").agg(F.min("v").alias("class_id")).withColumnRenamed("u", "id").unionByName(own.select(F.col("v").alias("id"), F.col("v").alias("class_id")).distinct())
        mark = now


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), class_size for each row of docs (doc_id, text)."""
    sketched = written(sketches(docs), "sketches")
    reps = sketched.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("size").alias("size"))
    reps = written(reps, "representatives")
    members = reps.select(F.posexplode("keys").alias("band", "bucket"), F.col("rep").alias("id"), "size")
    about = reps.select(F.col("rep").alias("id"), "sketch", "keys")
    found = written(components(links(members, about, docs, similarity)), "components")
    classes = reps.select("digest", F.col("rep").alias("id"), "copies").join(found, "id", "left").select("digest", F.coalesce("class_id", "id").alias("class_id"), "copies")
    classes = written(classes, "classes")
    sizes = written(classes.groupBy("class_id").agg(F.sum("copies").alias("class_size")).where("class_size > 1"), "sizes")
    groups = written(classes.join(sizes, "class_id").select("digest", "class_id", "class_size", "copies"), "groups")
    # At most 256 multisets can have over a 256th of the rows each: these may be broadcast.
    total = sketched.count()
    pick = lambda df, name: df.select(F.col("digest").alias(f"{name}_digest"), F.struct("class_id", "class_size").alias(f"{name}_class"))
    hot = pick(groups.where(F.col("copies") * 256 > total), "hot")
    cold = pick(groups.where(F.col("copies") * 256 <= total), "cold")
    rows = sketched.select("id", "digest").join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    key = F.when(F.col("hot_digest").isNull() & F.col("digest").isNotNull(), F.col("digest")).otherwise(F.col("id").cast("string").cast("binary"))
    rows = rows.withColumn("cold_digest", key).join(cold, "cold_digest", "left")
    rows = rows.withColumn("class", F.coalesce("hot_class", "cold_class", F.struct(F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))))
    out = rows.select(F.col("id").alias("doc_id"), "class.class_id", "class.class_size")
    nameless = narrow(docs).where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(nameless)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\t-\r ]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, shingle, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(5, len(ws)) - 1], ' '))) AS shingle FROM w WHERE len(ws) > 0) GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS overlap FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN t x ON a = x.doc_id JOIN t y ON b = y.doc_id WHERE 5 * overlap >= 4 * (x.n + y.n - overlap)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT reach.a, x.b FROM reach JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) x ON reach.b = x.a),
c AS (SELECT documents.doc_id, least(documents.doc_id, coalesce(min(b), documents.doc_id)) AS class_id FROM documents LEFT JOIN reach ON doc_id = a GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM c
"""
