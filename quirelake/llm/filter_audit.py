"""Filter interaction audit: what five filters remove in every order, from one pass over the documents.

A document's fate in any order depends only on the set of filters that it
fails, its mask. Documents are counted by part and mask, and by what their
labels say: at most 32 cells for each part. The subsets of filters are then
walked in Gray-code order: one filter is put in or taken out at a time, each
cell keeps how many filters that are in it fails, and the running survivors
change by the cells whose number leaves or comes back to zero. The survivors of
the 32 subsets are stored; each step of each of the 120 orders is a difference
of two of them.

The filters, as failures: A under 200 words; B distinct words fewer than half
of the words; C more than 3 A-Z characters for each 100 code points; D any of
the characters ``#$%&*|``; E a text that is also that of a document with a
smaller doc_id, whatever becomes of that one. Words are what lies between
spaces and the characters 9 to 13. Texts are equal if SHA-256 and length are.

A null text counts as empty, a null lang is the part of the empty string. A row
with a null doc_id has no smaller and is no other's smaller one: it never fails
E; nor do rows that share the smallest doc_id of their text. Repeated rows are
documents of their own. A document is good (toxic) if any row of labels with
its doc_id says so. Very long texts are cut into words block by block, so that
only their distinct words are held. A part without rows does not exist; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import narrow, table, written

FILTERS = "ABCDE"
WORDS, UPPER_PERCENT, SIGNS = 200, 3, b"#$%&*|"
UPPER, FOLLOWING = bytes(range(65, 91)), bytes(range(0x80, 0xC0))
#: Bytes of a text that are cut into words at a time.
BLOCK = 1 << 22
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)


def words_of(text: bytes) -> tuple[int, int]:
    """How many words, and how many distinct ones."""
    if len(text) <= BLOCK:
        words = text.split()
        return len(words), len(set(words))
    count, seen, left, view = 0, set(), b"", memoryview(text)
    for a in range(0, len(text), BLOCK):
        part = left + bytes(view[a : a + BLOCK])
        words, left = part.split(), b""
        # A last word that goes on in the next block waits for it.
        if words and not part[-1:].isspace():
            left = words.pop()
        count += len(words)
        seen.update(words)
    if left:
        count += 1
        seen.add(left)
    return count, len(seen)


def failures(text: bytes) -> int:
    """The mask of the filters A to D that a text (UTF-8) fails: 1 for A, 2 for B, 4 for C, 8 for D."""
    words, distinct = words_of(text)
    upper = len(text) - len(text.translate(None, UPPER))
    points = len(text.translate(None, FOLLOWING))
    signs = len(text.translate(None, SIGNS)) < len(text)
    return (words < WORDS) | (100 * distinct < 50 * words) << 1 | (100 * upper > UPPER_PERCENT * points) << 2 | signs << 3


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask of each row of docs (doc_id, text, lang); the mask is without E."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            digest = [hashlib.sha256(t).digest() + len(t).to_bytes(8, "big") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digest, pa.binary()), pa.array(map(failures, texts), pa.int32())], ["doc_id", "part", "digest", "mask"])

    docs = narrow(docs, F.coalesce("lang", F.lit("")).cast("string").alias("part"))
    docs = docs.select("doc_id", "part", F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, digest binary, mask int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (with E: 16), n, good, toxic: how many documents, by all that decides their fate."""
    # Repeated rows are counted before they meet anything; copies of a text are never brought together row by row.
    rows = judged(docs).groupBy("doc_id", "part", "digest").agg(F.first("mask").alias("mask"), F.count("*").alias("n"))
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = rows.join(said, "doc_id", "left")
    counted = told.select("doc_id", "part", "digest", "mask", "n", *(F.when(F.col(c) == 1, F.col("n")).otherwise(0).alias(c) for c in ("good", "toxic")))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    # Of each text in each part: all rows, those without an id, and those of the smallest id. Equal texts have equal masks.
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n", "good", "toxic"))).alias("least")
    none = [F.sum(F.when(F.col("doc_id").isNull(), F.col(c)).otherwise(0)).alias(f"none_{c}") for c in ("n", "good", "toxic")]
    texts = written(counted.groupBy("digest", "part").agg(F.first("mask").alias("mask"), *sums, *none, least), "audited")
    first = texts.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    # One row for each part that has the text.
    met = texts.join(first, "digest")
    own = lambda c: F.col(f"none_{c}") + F.when(F.col("least.doc_id") == F.col("first"), F.col(f"least.{c}")).otherwise(0)
    fine = met.select("part", "mask", *(own(c).alias(c) for c in ("n", "good", "toxic")))
    copies = met.select("part", F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), *((F.col(c) - own(c)).alias(c) for c in ("n", "good", "toxic")))
    return fine.unionByName(copies).where("n > 0").groupBy("part", "mask").agg(*sums)


def survivors(masks: np.ndarray, weights: np.ndarray, filters: int) -> np.ndarray:
    """For each subset of the filters, the sums of the rows of weights whose mask fails none of it, by a Gray-code walk."""
    stored = np.zeros((1 << filters, weights.shape[1]), np.int64)
    active, running, subset = np.zeros(len(masks), np.int64), weights.sum(axis=0), 0
    stored[0] = running
    for step in range(1, 1 << filters):
        f = (step & -step).bit_length() - 1  # the bit in which this Gray code differs from the one before
        subset ^= 1 << f
        fails = (masks >> f & 1).astype(bool)
        if subset >> f & 1:
            running = running - weights[fails & (active == 0)].sum(axis=0)
            active += fails
        else:
            active -= fails
            running = running + weights[fails & (active == 0)].sum(axis=0)
        stored[subset] = running
    return stored


def audit(cell_counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step: what is kept and lost there (see SCHEMA). names: a letter for each bit of a mask."""

    def steps(key: tuple, rows: pa.Table) -> pa.Table:
        masks = rows.column("mask").to_numpy().astype(np.int64)
        weights = np.column_stack([rows.column(c).to_numpy().astype(np.int64) for c in ("n", "good", "toxic")])
        kept = survivors(masks, weights, len(names))
        fails = [int(weights[masks >> f & 1 == 1, 0].sum()) for f in range(len(names))]
        unique = [int(weights[masks == 1 << f, 0].sum()) for f in range(len(names))]
        out, shares = [], [0] * len(names)
        for order in itertools.permutations(range(len(names))):
            subset = 0
            for step, f in enumerate(order, 1):
                before, subset = kept[subset], subset | 1 << f
                lost = before - kept[subset]
                shares[f] += int(lost[0])
                out.append(("".join(names[x] for x in order), step, f, int(kept[subset][0]), *map(int, lost)))
        order, step, which, left, gone, good, toxic = zip(*out, strict=True)
        columns = [left, gone, [fails[f] - g for f, g in zip(which, gone, strict=True)], [unique[f] for f in which], good, toxic, [shares[f] for f in which]]
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.string()), pa.array(order, pa.string()), pa.array(step, pa.int32()), *(pa.array(c, pa.int64()) for c in columns)], ["part", "filter_order", "step", *COUNTS])

    return cell_counts.groupBy("part").applyInArrow(steps, SCHEMA)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(cells(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
o(name, step, seen, f) AS (SELECT '', 0, 0, NULL::INT UNION ALL SELECT name || chr(65 + i::INT), step + 1, seen | (1 << i::INT), i::INT FROM o, range(5) r(i) WHERE seen & (1 << i::INT) = 0),
p AS (SELECT a.name AS filter_order, b.step, b.f, b.seen, b.seen & ~(1 << b.f) AS before FROM o a JOIN o b ON a.step = 5 AND b.step > 0 AND starts_with(a.name, b.name)),
s AS (SELECT part, filter_order, step, f, sum(n) FILTER (mask & seen = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & seen <> 0) AS removed, sum(n) FILTER (mask >> f & 1 = 1 AND mask & before <> 0) AS redundant,
  sum(n) FILTER (mask = 1 << f) AS unique_fails, sum(good) FILTER (mask & before = 0 AND mask & seen <> 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & seen <> 0) AS toxic_lost FROM c, p GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM s
"""
