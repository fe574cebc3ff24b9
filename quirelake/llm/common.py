"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.tables import written  # noqa: F401 - the operators take it from here
from quirelake.sources.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def narrow(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text only (plus extra), null text as the empty text: columns with clashing names can't get in the way."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that a column of df has (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_rows(rows: DataFrame, most: int) -> list:
    """The rows (doc_id, text, ...; a few thousand) in the order of doc_id, without those beyond the first most bytes of text in the order of a hash of doc_id."""
    rows = written(rows, "sample")
    sizes = sorted((r.h, r.doc_id, r.n) for r in rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.octet_length("text").alias("n")).collect())
    fits, held = [], 0
    for _, doc_id, n in sizes:
        held += n
        if held > most:
            break
        fits.append(doc_id)
    if len(fits) < len(sizes):
        rows = rows.where(F.col("doc_id").isin(fits))
    return rows.orderBy("doc_id").collect()


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class BoundedCache(dict):
    """What make gives for a string: the latest MOST bytes of keys and values at least stay, and twice as many at most; long strings do not.

    With fresh (a list), what was made anew is put there.
    """

    MOST, LONGEST, EACH = 40 << 20, 256, 180

    def __init__(self, make: Callable[[str], bytes], fresh: list | None = None):
        super().__init__()
        self.make, self.fresh, self.older, self.held = make, fresh, {}, 0

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
            if self.fresh is not None:
                self.fresh.append((key, got))
        if len(key) <= self.LONGEST:
            if self.held > self.MOST:
                self.older, self.held = dict(self), 0
                self.clear()
            self.held += len(key) + len(got) + self.EACH
            self[key] = got
        return got
