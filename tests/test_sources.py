"""Files in folders: batch, stream, table functions, the data source, edits and the endpoint."""

from __future__ import annotations

import json
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quirelake.kernel import writer
from quirelake.operators import ranges, search, state
from quirelake.plans import relational
from quirelake.sources import datasource, edits, endpoint, generated, pdf
from quirelake.streaming import files as streaming


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    for i in range(4):
        b = writer.Builder()
        for k in range(i + 1):
            b.page(generated.lines_content(f"file {i} page {k}\nmore"))
        (top / f"f{i}.pdf").write_bytes(b.build(packed=bool(i % 2)))
    (top / "bad.pdf").write_bytes(b"%PDF-1.4 broken")
    (top / "note.txt").write_text("no file of ours")
    return str(top)


def test_folder(spark, folder):
    files = pdf.read_files(spark, folder)
    meta = pdf.relation(files, "documents_meta").collect()
    assert sorted(m.actual_page_count or 0 for m in meta) == [0, 1, 2, 3, 4] and sum(m.error_class is not None for m in meta) == 1
    texts = pdf.relation(files, "text_elements", pages={1})
    assert texts.count() == 6 and {r.page_index for r in texts.collect()} == {1}
    v = pdf.typed(pdf.relation(files, "objects")).select(F.try_variant_get("value", "$.Type", "string").alias("t"), "type")
    assert v.where("t = '/Page'").count() == 10 == v.where("type = 'Page'").count()
    assert pdf.relation(pdf.read_files(spark, folder, largest=1), "documents_meta").where("error_class = 'size'").count() == 5


def test_data_source(spark, folder):
    datasource.register(spark)
    df = spark.read.format("pdf").option("relation", "text_elements").load(folder)
    assert df.where("page_index = 1").count() == 6 and df.count() == 20
    assert spark.read.format("pdf").option("pages", "1,2").load(folder).count() == 10
    assert spark.read.format("pdf").option("relation", "pdf_pages").load(folder).count() == 10


def test_table_functions(spark, folder):
    endpoint.register(spark)
    files = pdf.read_files(spark, folder)
    got = spark.sql("SELECT t.op, count(*) AS n FROM {f} f, LATERAL pdf_instructions(f.content) t GROUP BY 1", f=files).collect()
    assert {r.op: r.n for r in got}["Tj"] == 20


def test_stream(spark, folder, tmp_path):
    files = streaming.stream_files(spark, folder, 2)
    q = streaming.stream_relation(files, "text_elements").writeStream.format("memory").queryName("texts").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("texts").count() == 20
    q = streaming.arrivals(streaming.stream_files(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("arrivals").agg(F.sum("files")).first()[0] == 5


def test_endpoint(folder):
    data = open(f"{folder}/f1.pdf", "rb").read()

    def ask(data, method, **params):
        response, data = endpoint.handle(data, json.dumps({"id": 7, "method": f"pdf/{method}", "params": params, "more": 1}))
        return json.loads(response), data

    assert ask(data, "getDocumentInfo")[0]["result"]["pageCount"] == 2
    assert ask(data, "getPages")[0]["result"]["pages"][0]["width"] == 612
    assert "Tj" in ask(data, "getPageContent", pageIndex=1)[0]["result"]["content"]
    assert ask(data, "getTextBlocks", pageIndex=1)[0]["result"]["blocks"][0]["text"] == "file 1 page 1more"
    done, after = ask(data, "updateText", pageIndex=0, oldText="file", newText="FILE")
    assert done["result"]["replaced"] == 1 and ask(after, "getTextBlocks")[0]["result"]["blocks"][0]["text"].startswith("FILE 1")
    done, after = ask(data, "addAnnotation", pageIndex=0, type="Highlight", x=1, y=2, x2=3, y2=4, content="hi")
    key = done["result"]["objectKey"]
    assert ask(after, "getObject", objectKey=key)[0]["result"]["object"]["Rect"] == [1, 2, 3, 4]
    done, after = ask(after, "updateObject", objectKey=key, value={"Contents": "ho"})
    assert ask(after, "getObject", objectKey=key)[0]["result"]["object"]["Contents"] == "ho"
    done, after = ask(after, "deleteObject", objectKey=key)
    assert done["result"]["success"] and "error" in ask(after, "getObject", objectKey=key)[0]
    assert ask(data, "nothing")[0]["error"]["code"] == -32601 and json.loads(endpoint.handle(data, "x")[0])["error"]["code"] == -32700
    assert "error" in ask(b"no file", "getPages")[0]


def test_edits_of_damaged_files(spark, folder):
    files = pdf.read_files(spark, folder)
    wanted = files.select(F.lit(1).alias("edit_id"), "doc_id", F.lit(0).alias("page_index"), F.lit("replace").alias("kind"), F.lit("more").alias("search"), F.lit("less").alias("replacement"))
    done = edits.apply_edits(files, wanted)
    assert sorted(r.changes for r in done.collect()) == [0, 1, 1, 1, 1] and done.where("error IS NOT NULL").count() == 1
    assert search.find_text(pdf.relation(done, "text_elements"), "less").count() == 4
    assert edits.rewritten(files).where("error IS NULL").count() == 4


def test_unknown_edits_are_error_rows(spark, folder):
    files = pdf.read_files(spark, folder).where("doc_id IS NOT NULL")
    row = lambda kind: files.select(F.lit(1).alias("edit_id"), "doc_id", F.lit(0).alias("page_index"), F.lit(kind).alias("kind"), F.lit(bytearray(b"\0\1")).alias("image"), F.lit(2).alias("width"), F.lit(1).alias("height"), F.array(*map(F.lit, (0.0, 0.0, 9.0, 9.0))).alias("numbers"))
    assert edits.apply_edits(files, row("turn_image")).where("error IS NULL").count() == 0
    done = edits.apply_edits(files, row("add_image"))
    assert done.where("error IS NULL").count() == 4 and pdf.relation(done, "images").where("width = 2 AND height = 1 AND position.width = 9").count() == 4


def test_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("b", 1, None), ("b", 2, None), (None, 1, 7)], "k string, i int, v int")
    got = {(r.k, r.i): r.c for r in state.carried(df, ["k"], ["i"], F.col("v"), "c").collect()}
    assert got == {("a", 1): None, ("a", 2): 5, ("a", 3): 5, ("b", 1): None, ("b", 2): None, (None, 1): 7}
    assert sorted((r.k or "", r.i) for r in state.without_repeats(df, ["k"], ["i"], "v").collect()) == [("", 1), ("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    t = spark.createDataFrame([(0, 9, "low"), (8, 40, "wide")], "lo int, hi int, label string")
    values = spark.createDataFrame([(5,), (9,), (41,), (None,)], "v int")
    assert sorted((r.v or -1, r.label or "") for r in ranges.range_lookup(values, "v", t, 4).collect()) == [(-1, ""), (5, "low"), (9, "low"), (9, "wide"), (41, "")]


def test_overlapping_pairs_of_one_table(spark):
    box = lambda i, *r: (i, dict(zip(("llx", "lly", "urx", "ury"), map(float, r), strict=True)))
    rows = [box(2, 0, 0, 1, 1), box(4, 1, 1, 2, 2), box(5, 0, 0, 2, 2), box(5, 0, 0, 1, 1), box(7, 8, 8, 9, 9), box(9, 9, 8, 9, 9), box(None, 0, 0, 9, 9)]
    df = spark.createDataFrame(rows, "id long, r struct<llx: double, lly: double, urx: double, ury: double>")
    # Even ids pair, odd ids pair, both rows of id 5 pair with others and not with each other.
    assert sorted(map(tuple, ranges.overlapping_pairs(df, 0.5).collect())) == [(2, 4), (2, 5), (2, 5), (4, 5), (4, 5), (7, 9)]


def test_literal_search(spark):
    df = spark.createDataFrame([("a.b A.B \\E $1",)], "t string")
    got = df.select(search.occurrences(F.col("t"), "a.b", True).alias("n"), search.replaced(F.col("t"), "A.b", "$0\\", True).alias("r"), search.occurrences(F.col("t"), "\\E").alias("e")).first()
    assert (got.n, got.r, got.e) == (2, "$0\\ $0\\ \\E $1", 1)


def test_numbers_shown(spark):
    values = [0.0, -0.0, None, -0.05, -3.0, 0.1, 10.0, 2.5]
    rows = spark.createDataFrame([(1, i, v, v) for i, v in enumerate(values)], "l_orderkey long, l_linenumber int, l_quantity double, l_discount double")
    rows.write.mode("overwrite").parquet(d := tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/lineitem.parquet")
    got = {r.l_linenumber: (r.q, r.dsc) for r in relational.number_format_all(spark, d.removesuffix("/lineitem.parquet")).collect()}
    want = ["0", "0", None, "-0.05", "-3", "0.1", "10", "2.5"]
    assert got == {i: (w, w) for i, w in enumerate(want)}
    sql = duckdb.sql(relational.ORACLE_SQL["number_format_all"].replace("FROM lineitem", f"FROM '{d}/*.parquet'")).fetchall()
    assert {r[1]: (r[2], r[3]) for r in sql} == got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
