"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame functions only.

Each input partition is a run of (digest, best row so far): it is sorted by
digest where it lies, and equal digests become one row there. Then runs whose
numbers differ only in their low bits exchange their rows: a round merges
2**bits runs (four), so R partitions take log R / bits rounds, as in a binomial
tree; within a merged run a digest lies in one place. Spark's sort aggregate
does the multiway merge; every level keeps one row for each digest: the best
one, the count, and the bounds of a second hash and of the normalised length,
by which a level verifies that all it merged are the same text. Rounds go on
until one run is left, which lies over all partitions by digest. No level holds
more than one row for a digest and run, so a digest with a third of all rows is
a handful of rows from the first merge on.

Nulls: a null text counts as empty. A null doc_id is a row like any other; it
loses ties to every doc_id, and stays (with a null keep_id) only where all its
equals have none or it is longest. An empty table gives no rows. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, narrow, table, written

#: The characters that equality ignores.
IGNORED = "[\\x20\\x09-\\x0D]+"
#: Runs merged at a time, as a power of two.
ROUND_BITS = 2
#: Dropped rows are broadcast up to this many (24 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, size (code points of the text), raw (a hash of it), digest (SHA-256 of the normalised text), second (another hash), bare (its length)."""
    bare = F.regexp_replace("text", IGNORED, "")
    return (
        narrow(docs)
        .select("doc_id", F.length("text").alias("size"), F.xxhash64("text").alias("raw"), bare.alias("bare_text"))
        .select("doc_id", "size", "raw", F.unhex(F.sha2("bare_text", 256)).alias("digest"), F.xxhash64("bare_text").alias("second"), F.length("bare_text").alias("bare"))
    )


def _best() -> Column:
    """Longest first, then smallest doc_id, null last, then the first copy of a row: the least of these structs is the best row."""
    return F.struct((-F.col("size")).alias("neg_size"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("copy").alias("copy"))


def merged(rows: DataFrame, runs: int, bits: int = ROUND_BITS) -> DataFrame:
    """One row for each digest of the runs (column run, 0 <= run < runs): best, copies."""
    level = rows.select("run", "digest", _best().alias("best"), F.lit(1).cast("long").alias("copies"), F.col("second").alias("low"), F.col("second").alias("high"), F.col("bare").alias("short"), F.col("bare").alias("long"))
    left = max(1, runs)
    while True:
        left = -(-left // (1 << bits))
        run = F.shiftright("run", bits) if left > 1 else F.lit(0)
        level = level.withColumn("run", run.cast("int")).groupBy("run", "digest").agg(F.min("best").alias("best"), F.sum("copies").alias("copies"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("short").alias("short"), F.max("long").alias("long"))
        same = (F.col("low") == F.col("high")) & (F.col("short") == F.col("long"))
        level = level.withColumn("copies", F.when(same, F.col("copies")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))))
        if left == 1:
            return level.select("digest", "best", "copies")


def exact_dedup(docs: DataFrame, bits: int = ROUND_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, raw for each row of docs.

    docs: doc_id, text. Of rows whose texts are equal without white space, the
    one with the most code points stays, then the one with the smallest doc_id;
    of full ties (the same doc_id twice) one copy of the row is marked kept.
    """
    rows = written(digests(docs).withColumn("run", F.spark_partition_id()).withColumn("copy", F.monotonically_increasing_id()), "digests")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    groups = merged(rows, runs, bits).select("digest", F.struct(F.col("best.doc_id").alias("keep_id"), F.col("best.copy").alias("copy"), F.col("copies").alias("size")).alias("group"))
    repeated = written(groups.where("group.size > 1"), "groups")
    # At most 256 groups can hold over a 256th of the rows each, so these may be broadcast; the others are small.
    share = F.col("group.size") * 256
    total = rows.count()
    hot = repeated.where(share > total).select(F.col("digest").alias("hot_digest"), F.col("group").alias("hot_group"))
    cold = repeated.where(share <= total).select(F.col("digest").alias("key"), F.col("group").alias("cold_group"))
    found = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    # A row of a hot group needs no second look-up: a key of its own keeps it from following the others into one task.
    own = F.col("copy").cast("string").cast("binary")
    found = found.withColumn("key", F.when(F.col("hot_digest").isNull(), F.col("digest")).otherwise(own)).join(cold, "key", "left")
    alone = F.struct(F.col("doc_id").alias("keep_id"), F.col("copy"), F.lit(1).cast("long").alias("size"))
    found = found.withColumn("group", F.coalesce("hot_group", "cold_group", alone))
    return found.select("doc_id", "group.keep_id", F.col("group.size").alias("group_size"), (F.col("copy") == F.col("group.copy")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "raw")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names and types.

    Of rows with the same doc_id and text one stays: the one whose columns, as JSON, come first.
    """
    found = written(exact_dedup(docs).select("doc_id", "raw", "kept"), "decisions")
    fate = written(found.groupBy("doc_id", "raw").agg(F.max("kept").alias("any_kept"), F.min("kept").alias("all_kept")).where("NOT all_kept"), "dropped")
    own_raw, gone_id, gone_raw, any_kept, row = fresh(docs, "own_raw", "gone_id", "gone_raw", "any_kept", "row")
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn(own_raw, F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = fate.select(F.col("doc_id").alias(gone_id), F.col("raw").alias(gone_raw), F.col("any_kept").alias(any_kept))
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own_raw) == F.col(gone_raw))
    by = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    stay = marked.join(by(gone), same, "left_anti").select(names)
    # Rows that occur more than once as a whole: one of them stays.
    whole = F.struct(*names)
    twice = marked.join(by(gone.where(F.col(any_kept))), same, "left_semi").groupBy("doc_id", own_raw).agg(F.min_by(whole, F.to_json(whole)).alias(row))
    return stay.unionByName(twice.select(f"{row}.*"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("raw")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
