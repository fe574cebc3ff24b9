"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in SHARE is hot; there are SHARE of them at most. Its rows go to COPIES tasks.
SHARE, COPIES = 256, 32
#: Rows that any task may have of one key: smaller tables are joined as they are.
FEW = 100_000


def sorted_if_large(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, which a join does not broadcast if it has over FEW rows (rows of them, if that is known).

    Spark goes by the size of files, and rows that are much alike take a twentieth of their memory there: the driver would
    have to hold them all. df should be a written table, as it is counted.
    """
    return df.hint("merge") if (df.count() if rows is None else rows) > FEW else df


def hot_keys(df: DataFrame, on: list[str], share: int = SHARE, few: int = FEW) -> DataFrame | None:
    """The keys of df with more than one row in share (share of them at most), or None."""
    total = df.count()
    if total <= few:
        return None
    rows = df.groupBy(*on).count().where(F.col("count") * share > total).select(*on).collect()
    return df.sparkSession.createDataFrame(rows, df.select(*on).schema) if rows else None


def spread_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", share: int = SHARE, copies: int = COPIES, few: int = FEW, hot: DataFrame | None = None) -> DataFrame:
    """left joined with right on columns of both (inner, left or left_anti; null keys meet nothing).

    Rows of left with a hot key are dealt over copies tasks, and the rows of right with that key are copied to each;
    right is taken to have few rows for each key. hot: the hot keys (columns on; no more than share of them), where they
    are known; otherwise they are counted.
    """
    hot = hot_keys(left, on, share, few) if hot is None else hot.select(*on)
    if hot is None:
        return left.join(right, on, how)
    hot = F.broadcast(hot.withColumn("_hot", F.lit(True)))  # at most share rows
    dealt = left.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(copies))).otherwise(0).cast("int")).drop("_hot")
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(hot, on, "left").withColumn("_salt", F.explode(each)).drop("_hot")
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")
