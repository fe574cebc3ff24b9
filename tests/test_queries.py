"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from quirelake.kernel import document
from quirelake.kernel.text import page_text
from quirelake.plans import catalog, documents

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for name in os.listdir(D):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{D}/{name}'")
    return c


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    rows = lambda rs, names: sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rs), key=repr)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("keys,stay", [([1, 1, 3, None], [2, 5]), ([None], [1, 2, 3, 5, None]), ([], [1, 2, 3, 5, None])])
def test_orders_of_any_price_delete_their_customer(spark, tmp_path, keys, stay):
    """Orders far below and above 480,000, which were once the only ones read."""
    spark.createDataFrame([(k, f"c{k}") for k in (1, 2, 3, 5, None)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, k, 1.0 if i else 500_000.0) for i, k in enumerate(keys)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(r) for r in catalog.QUERIES["delete_by_key"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == set(con.sql(catalog.ORACLE_SQL["delete_by_key"]).fetchall()) == {(k, f"c{k}") for k in stay}


@pytest.mark.parametrize("kind", range(3))
def test_fonts_show_every_line(kind):
    every = "".join(chr(c) for c in range(256) if c != 10)
    for text in ("one\n\ntwo é\nthree", "\nsecond", every + "\nab", "", None):
        got = document.parse(documents._fonts(kind, text))
        assert [e.text for e in page_text(got, got.pages()[0]).elements] == [x for x in (text or "").split("\n") if x]


def test_operators_of_real_texts(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a\nb"), (1, 2, "bot", "c\n\nd"), (2, 1, "user", ""), (2, 2, "bot", None)], "conv_id long, turn long, role string, text string")
    assert {r.category: r.n for r in documents._categories(turns).collect()} == {"text_object": 8, "text_state": 8, "text_positioning": 4 + 3, "text_showing": 4}


@pytest.mark.parametrize("name,table", [("pdf_operator_categories_text", "conversations"), ("pdf_wrong_password", "documents")])
def test_files_hold_the_real_texts(spark, monkeypatch, name, table):
    seen = []
    for maker in ("turns_as_files", "documents_as_files"):
        made = getattr(documents.generated, maker)
        monkeypatch.setattr(documents.generated, maker, lambda rows, *a, made=made, **k: (seen.append(rows), made(rows, *a, **k))[1])
    documents.QUERIES[name](spark, D)
    texts = lambda df: sorted(r.text for r in df.select("text").collect())
    assert texts(seen[0]) == texts(spark.read.parquet(f"{D}/{table}.parquet"))
