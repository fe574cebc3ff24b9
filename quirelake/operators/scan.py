"""Scans over the ordered rows of keys, where one key may hold most of the rows.

A key that holds more than a fair share of the rows is cut into parts by its
order, at places taken from a sample, so that no task sorts more than a part.
Each part is scanned on its own; what it hands on (a carry) is one row, and the
carries of the parts before it complete its rows. Any cut is a right one: the
sample decides how even the parts are, never what comes out. Rows that tie in
all order columns stay in one part.

The rows are counted first, and those of hot keys sampled, so a costly input
should be a written table. Keys are compared with nulls as equal, and nulls
come first in the order, as in Spark's windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators.tables import written

#: Rows of a part at least; parts for each shuffle partition at most; sampled rows for each part.
FAIR_ROWS, PARTS_EACH, SAMPLED = 200_000, 8, 64


class Scan:
    """df with the part that each row of a key belongs to; windows within the parts, and carries between them."""

    PART = "_scan_part"

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], fair: int | None = None, total: int | None = None):
        """total: how many rows df has, if that is known."""
        self.keys, self.order, self.names = list(keys), list(order), list(df.columns)
        self.parts, self.total = 1, df.count() if total is None else total
        cuts = self._cuts(df, fair)
        if cuts is None:
            self.df = df.withColumn(self.PART, F.lit(0))
        else:
            self.df = self._dealt(df, cuts)
        by = Window.partitionBy(*self.keys, self.PART).orderBy(*self.order)
        self.window, self.running = by, by.rowsBetween(Window.unboundedPreceding, 0)

    def _cuts(self, df: DataFrame, fair: int | None) -> DataFrame | None:
        """For each hot key the order values (structs) that its parts start at, with every n-th of them apart."""
        total = self.total
        if fair is None:
            fair = max(FAIR_ROWS, total // (PARTS_EACH * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        if total <= fair:
            return None
        # At most total / fair keys hold more than fair rows.
        hot = df.groupBy(*self.keys).count().where(F.col("count") > fair).select(*self.keys).collect() if self.keys else [()]
        if not hot:
            return None
        step = max(1, fair // SAMPLED)
        some = df.select(*self.keys, F.struct(*self.order).alias("_at")).where(F.pmod(F.xxhash64("_at"), F.lit(step)) == 0)
        if self.keys:
            keys = df.sparkSession.createDataFrame(hot, df.select(*self.keys).schema)
            some = some.alias("s").join(F.broadcast(keys).alias("k"), self._same("s", "k"), "left_semi")
        every = max(1, -(-fair // step))
        numbered = some.distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*self.keys).orderBy("_at")))
        starts = F.array_sort(F.collect_list("_at"))
        cuts = numbered.where(F.col("_n") % every == 0).groupBy(*self.keys).agg(starts.alias("_starts"))
        rows = cuts.withColumn("_each", F.ceil(F.sqrt(F.size("_starts"))).cast("int")).withColumn("_coarse", F.filter("_starts", lambda _, i: i % F.col("_each") == 0)).collect()
        if not rows:
            return None
        self.parts = max(len(r["_starts"]) for r in rows) + 1
        schema = cuts.withColumn("_each", F.lit(1)).withColumn("_coarse", F.col("_starts")).schema
        return df.sparkSession.createDataFrame(rows, schema)

    def _dealt(self, df: DataFrame, cuts: DataFrame) -> DataFrame:
        """The number of starts up to a row: among every n-th of them first, then among the n that follow."""
        own = F.struct(*(F.col(f"d.`{c}`") for c in self.order))
        upto = F.size(F.filter("k._coarse", lambda c: c <= own))
        first = (upto - 1) * F.col("k._each")
        fine = F.size(F.filter(F.slice("k._starts", first + 1, F.col("k._each")), lambda c: c <= own))
        part = F.when(F.col("k._starts").isNull() | (upto == 0), 0).otherwise(first + fine).cast("int")
        left, right = df.alias("d"), F.broadcast(cuts).alias("k")
        return left.join(right, self._same("d", "k"), "left").select("d.*", part.alias(self.PART))

    def _same(self, a: str, b: str) -> Column:
        on = F.lit(True)
        for c in self.keys:
            on &= F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`"))
        return on

    def completed(self, rows: DataFrame, carry: Column, over: Callable[[Column, object], Column], name: str, merge: Callable[[Column, Column], Column]) -> DataFrame:
        """rows (with the part) with their column name completed by merge(what came before, own).

        carry is an aggregate of a part's rows; over makes of the carries (a column, in a window over the parts before)
        what came before. One part needs nothing.
        """
        if self.parts > 1:
            # Parts of keys that are not cut have nothing before them and need no row.
            cut = Window.partitionBy(*self.keys)
            before = Window.partitionBy(*self.keys).orderBy(self.PART).rowsBetween(Window.unboundedPreceding, -1)
            each = rows.groupBy(*self.keys, self.PART).agg(carry.alias("_carry"))
            each = each.withColumn("_last", F.max(self.PART).over(cut)).where("_last > 0").withColumn("_before", over(F.col("_carry"), before)).select(*self.keys, self.PART, "_before")
            on = self._same("d", "k") & (F.col(f"d.{self.PART}") == F.col(f"k.{self.PART}"))
            joined = rows.alias("d").join(F.broadcast(each).alias("k"), on, "left")  # at most two rows for each fair share of all rows
            rows = joined.select(*(F.col(f"d.`{c}`") if c != name else merge(F.col("k._before"), F.col(f"d.`{c}`")).alias(name) for c in rows.columns))
        return rows

    def done(self, rows: DataFrame, *names: str) -> DataFrame:
        return rows.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*self.names, *names])))

    def _with(self, rows: DataFrame, value: Column) -> DataFrame:
        """rows with the value to scan; written if its carries are taken from them too."""
        rows = rows.withColumn("_own", value)
        return written(rows, "scanned") if self.parts > 1 else rows

    # Each of these takes rows that have the part (df, or what another of these has made of it) and adds a column.

    def sum(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """The sum of value up to each row; nulls add nothing, and before the first number it is null."""
        rows = self._with(rows, value).withColumn(name, F.sum("_own").over(self.running))
        plus = lambda a, b: F.when(a.isNull() | b.isNull(), F.coalesce(a, b)).otherwise(a + b)
        return self.completed(rows, F.sum("_own"), lambda c, w: F.sum(c).over(w), name, plus).drop("_own")

    def min(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        rows = self._with(rows, value).withColumn(name, F.min("_own").over(self.running))
        return self.completed(rows, F.min("_own"), lambda c, w: F.min(c).over(w), name, lambda a, b: F.least(a, b)).drop("_own")

    def number(self, rows: DataFrame, name: str) -> DataFrame:
        """From 1 on within each key."""
        rows = (written(rows, "scanned") if self.parts > 1 else rows).withColumn(name, F.row_number().over(self.window).cast("long"))
        return self.completed(rows, F.count("*"), lambda c, w: F.sum(c).over(w), name, lambda a, b: F.coalesce(a, F.lit(0)) + b)

    def last(self, rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        """The last value that isn't null, up to each row, of each of the values by name."""
        rows = rows.select("*", *(c.alias(f"_own_{n}") for n, c in values.items()))
        rows = written(rows, "scanned") if self.parts > 1 else rows
        rows = rows.withColumns({n: F.last(f"_own_{n}", ignorenulls=True).over(self.running) for n in values})
        for n in values:
            latest = F.max_by(f"_own_{n}", F.when(F.col(f"_own_{n}").isNotNull(), F.struct(*self.order)))
            rows = self.completed(rows, latest, lambda c, w: F.last(c, ignorenulls=True).over(w), n, lambda a, b: F.coalesce(b, a))
        return rows.drop(*(f"_own_{n}" for n in values))

    def previous(self, rows: DataFrame, value: Column, name: str) -> DataFrame:
        """A struct with the value of the row before; null for the first row of a key."""
        rows = self._with(rows, F.struct(value.alias("value"))).withColumn(name, F.lag("_own").over(self.window))
        latest = F.max_by("_own", F.struct(*self.order))
        return self.completed(rows, latest, lambda c, w: F.last(c, ignorenulls=True).over(w), name, lambda a, b: F.coalesce(b, a)).drop("_own")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, fair: int | None = None) -> DataFrame:
    """The sum of value up to each row; nulls add nothing, and before the first number it is null."""
    s = Scan(df, keys, order, fair)
    return s.done(s.sum(s.df, value, name), name)


def running_min(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, fair: int | None = None) -> DataFrame:
    s = Scan(df, keys, order, fair)
    return s.done(s.min(s.df, value, name), name)


def row_number(df: DataFrame, keys: list[str], order: list[str], name: str, fair: int | None = None) -> DataFrame:
    """From 1 on within each key."""
    s = Scan(df, keys, order, fair)
    return s.done(s.number(s.df, name), name)


def last_known(df: DataFrame, keys: list[str], order: list[str], value: Column | dict[str, Column], name: str = "", fair: int | None = None) -> DataFrame:
    """The last value that isn't null, up to each row; of several values by name in one go, if value is a dict."""
    values = value if isinstance(value, dict) else {name: value}
    s = Scan(df, keys, order, fair)
    return s.done(s.last(s.df, values), *values)


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, fair: int | None = None) -> DataFrame:
    """A struct with the value of the row before; null for the first row of a key."""
    s = Scan(df, keys, order, fair)
    return s.done(s.previous(s.df, value, name), name)
