"""Scans, trees and stack machines against plain Python, with hot keys cut into parts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelake.functions import geometry
from quirelake.operators import graph, joins, machine, scan, state


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    some = [(None if r.random() < 0.02 else "hot" if r.random() < 0.6 else f"k{r.randint(0, 20)}", None if r.random() < 0.02 else r.randint(0, 5) if r.random() < 0.1 else i, i, r.choice([None, 1, 2, 3]), r.choice("abc")) for i in range(3000)]
    return spark.createDataFrame(some, "k string, t long, id long, v int, e string").repartition(5)


def window(running: bool = False):
    w = Window.partitionBy("k").orderBy("t", "id")
    return w.rowsBetween(Window.unboundedPreceding, 0) if running else w


SCANS = {
    "running_sum": (lambda df, fair: scan.running_sum(df, ["k"], ["t", "id"], F.col("v"), "s", fair), lambda: F.sum("v").over(window(True))),
    "running_min": (lambda df, fair: scan.running_min(df, ["k"], ["t", "id"], F.col("v"), "s", fair), lambda: F.min("v").over(window(True))),
    "last_known": (lambda df, fair: scan.last_known(df, ["k"], ["t", "id"], F.col("v"), "s", fair), lambda: F.last("v", True).over(window(True))),
    "row_number": (lambda df, fair: scan.row_number(df, ["k"], ["t", "id"], "s", fair), lambda: F.row_number().over(window())),
    "previous": (lambda df, fair: scan.previous(df, ["k"], ["t", "id"], F.col("v"), "s", fair).withColumn("s", F.col("s.value")), lambda: F.lag("v").over(window())),
    "without_keys": (lambda df, fair: scan.row_number(df, [], ["t", "id"], "s", fair), lambda: F.row_number().over(Window.orderBy("t", "id"))),
}


@pytest.mark.parametrize("name", SCANS)
def test_scans(rows, name):
    made, want = SCANS[name]
    values = lambda df: sorted(map(tuple, df.select("id", "s").collect()))
    for fair in (100, None):
        got = made(rows, fair)
        assert got.columns == [*rows.columns, "s"] and values(got) == values(rows.withColumn("s", want()))


def test_parts_are_fair(rows):
    s = scan.Scan(rows, ["k"], ["t", "id"], 100)
    largest = s.df.groupBy("k", s.PART).count().agg(F.max("count")).first()[0]
    assert s.parts > 10 and largest <= 250
    assert scan.Scan(rows.where("false"), ["k"], ["t"], 1).df.collect() == []
    # Rows that tie in the whole order can't be cut, but nothing is lost.
    tied = rows.withColumn("t", F.lit(1))
    assert scan.running_sum(tied, ["k"], ["t"], F.lit(1), "s", 100).groupBy("k").agg(F.max("s").alias("n")).agg(F.sum("n")).first()[0] == 3000


def test_islands_and_repeats_on_hot_keys(rows):
    whole, cut = (state.islands(rows, ["k"], ["t", "id"], F.col("e") == "c", F.col("id"), "ids", fair) for fair in (None, 100))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, cut.collect()))
    whole, cut = (state.without_repeats(rows, ["k"], ["t", "id"], "e", "v", fair=fair).select("id") for fair in (None, 100))
    assert sorted(whole.collect()) == sorted(cut.collect())


def test_spread_join(spark):
    left = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 50 != 1, F.col("id")).cast("long").alias("k"), F.col("id").alias("n"))
    right = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (None, "d")], "k long, v string")
    for how in ("inner", "left", "left_anti"):
        plain, spread = left.join(right, "k", how), joins.spread_join(left, right, ["k"], how, copies=8, few=10)
        assert spread.columns == plain.columns and sorted(map(repr, spread.collect())) == sorted(map(repr, plain.collect()))


def test_long_chain(spark, monkeypatch):
    n, rounds = 100_000, []
    made = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (rounds.append(name), made(df, name))[1])
    nodes = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = graph.climbed(nodes, "parent IS NULL").agg(F.count("*"), F.sum((F.col("depth") == F.col("id")).cast("int")), F.max("root")).first()
    assert tuple(got) == (n, n, 0) and rounds.count("climbed") == 17


def test_cycles_have_names(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, None), (7, 6), (8, 99), (9, 9)], "id long, parent long")
    assert sorted(map(tuple, graph.cycles(nodes).collect())) == [(1, 1), (2, 1), (3, 1), (9, 9)]
    assert graph.cycles(nodes.where("id > 5 AND id < 9")).collect() == []
    with pytest.raises(ValueError, match=r"roots \[1\]"):
        graph.climbed(nodes, "id = 1")
    with pytest.raises(ValueError, match="below a root"):
        graph.climbed(spark.createDataFrame([(1, None), (2, 1), (2, 3), (3, 2)], "id long, parent long"), "id = 1")


def test_document_order(spark):
    r = random.Random(4)
    parent = {0: None} | {i: r.randint(max(0, i - 4), i - 1) for i in range(1, 300)}
    place = {i: r.randint(0, 3) for i in parent}
    below: dict = {}
    for i, p in parent.items():
        below.setdefault(p, []).append(i)
    want, leaves = {}, []

    def walk(i: int, deep: int) -> None:
        first = len(leaves)
        if i not in below:
            leaves.append(i)
        for c in sorted(below.get(i, []), key=lambda c: (place[c], c)):
            walk(c, deep + 1)
        want[i] = (0, deep, first, len(leaves) - first)

    walk(0, 0)
    lost = [(900, 901, 0), (901, 900, 0), (950, 949, 1)]
    nodes = spark.createDataFrame([(i, p, place[i]) for i, p in parent.items()] + lost, "id long, parent long, place int")
    got = graph.document_order(nodes, "id = 0", ["place"], fair=20)
    assert {x.id: (x.root, x.depth, x.first, x.leaves) for x in got.collect()} == want


def test_graphics_state(spark):
    r, rows, want = random.Random(3), [], {}
    product = lambda m, n: (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])
    for doc, size in ((1, 1500), (2, 200), (3, 1), (None, 30)):
        stack, ctm, width = [], (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), None
        for i in range(size):
            op = r.choices([None, "q", "Q", "cm", "w"], [1, 4, 4, 3, 2])[0]
            m = [*map(float, r.choice([(0, 1, -1, 0), (1, 0, 0, 1)])), float(r.randint(-9, 9)), 1.0] if op == "cm" and i % 9 else None
            w = i if op == "w" else None
            if op == "q":
                stack.append((ctm, width))
            elif op == "Q" and stack:
                ctm, width = stack.pop()
            elif m:
                ctm = product(m, ctm)
            width = i if op == "w" else width
            rows.append((doc, i, op, m, w, "clash"))
            want[doc, i] = (len(stack), ctm, width)
    df = spark.createDataFrame(rows, "doc long, idx long, op string, m array<double>, w long, prefix string").repartition(3)
    got = machine.graphics_state(df, ["doc"], ["idx"], F.col("op"), geometry.array_matrix(F.col("m")), {"width": F.col("w")}, fair=150)
    assert got.columns == [*df.columns, "depth", "ctm", "width"]
    assert {(x.doc, x.idx): (x.depth, tuple(x.ctm), x.width) for x in got.collect()} == want
