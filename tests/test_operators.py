"""Trees, strings, geometry, the sink, the store and edits on small tables with nulls, ties and odd values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirelake.functions import codecs
from quirelake.operators import graph, ranges, store
from quirelake.sources import datasource, edits, endpoint, generated, pdf


def test_trees(spark):
    rows = [(0, None, "root"), *((i, i - 1, "mid" if i == 5 else None) for i in range(1, 12)), (50, 3, None), (60, 999, "lost"), (70, 71, None), (71, 70, None)]
    nodes = spark.createDataFrame(rows, "id long, parent long, value string")
    got = {r.id: (r.depth, r.path) for r in graph.expanded(nodes, "parent IS NULL").collect()}
    assert got == {i: (i, "/".join(map(str, range(i + 1)))) for i in range(12)} | {50: (4, "0/1/2/3/50")}
    values = {r.id: r.value for r in graph.inherited(nodes, "parent IS NULL").collect()}
    assert values == {i: "root" if i < 5 else "mid" for i in range(12)} | {50: "root"}
    assert graph.expanded(nodes.where("false"), "parent IS NULL").collect() == []
    with pytest.raises(ValueError, match="cycle"):
        graph.expanded(nodes, "id = 70")


def test_literals_and_names(spark):
    texts = ["", "plain", "a(b)\\c\n\r\t\b\f", "\u0001 \\n", "é 中 #20 /x", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for r in df.select(t.alias("a"), codecs.unescape_literal(codecs.escape_literal(t)).alias("b"), codecs.unescape_name(codecs.escape_name(t)).alias("c")).collect():
        assert r.a == r.b == r.c
    odd = spark.createDataFrame([("\\101\\12\\0053",), ("a\\\nb\\\r\nc\\x",), ("\\351",)], "t string").select(codecs.unescape_literal(F.col("t")).alias("x")).collect()
    assert [r.x for r in odd] == ["A\n\x053", "abcx", "é"]
    name = spark.createDataFrame([("caf#C3#A9",), ("#4",), ("a#ZZ",), ("#FF",)], "t string").select(codecs.unescape_name(F.col("t")).alias("x")).collect()
    assert [r.x for r in name] == ["café", "#4", "a#ZZ", "�"]


def test_predicates(spark):
    df = spark.createDataFrame([("a", "UniJIS-UTF16-H"), ("b\x07", "Own-H"), ("", "V"), (None, None)], "t string, m string")
    got = df.select(codecs.has_private_use(F.col("t")).alias("p"), codecs.has_special(F.col("t")).alias("s"), codecs.is_present(F.col("t")).alias("h"), codecs.predefined_map(F.col("m")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(True, False, True, True), (False, True, True, False), (False, False, False, True), (None, None, False, None)]


def test_wide_rectangles(spark):
    box = lambda i, *r: (i, dict(zip(("llx", "lly", "urx", "ury"), map(float, r), strict=True)))
    rows = [box(1, -5e5, -5e5, 5e5, 5e5), box(2, 0, 0, 0, 0), box(3, 0.2, 0.2, 300, 0.4), box(4, 299, 0, 300, 9), box(5, 1e6, 1e6, 1e6, 1e6), (6, None), box(7, float("nan"), 0, 1, 1), box(8, -0.1, -0.1, 0.05, 0.05)]
    df = spark.createDataFrame(rows, "id long, r struct<llx: double, lly: double, urx: double, ury: double>")
    fine = [(i, r) for i, r in rows if r and r["llx"] == r["llx"]]
    meet = lambda a, b: a["llx"] <= b["urx"] and b["llx"] <= a["urx"] and a["lly"] <= b["ury"] and b["lly"] <= a["ury"]
    for cell in (0.05, 7.0):
        assert sorted(map(tuple, ranges.overlapping(df, df, cell).collect())) == sorted((i, j) for i, a in fine for j, b in fine if meet(a, b))


def test_sink(spark, tmp_path):
    datasource.register(spark)
    files = generated.documents_as_files(spark.createDataFrame([(1, "one\ntwo"), (2, ""), (3, None)], "doc_id long, text string"))
    rows = files.select(F.concat(F.lit("d"), "doc_id", F.lit(".pdf")).alias("name"), "content")
    rows.write.format("pdf").mode("append").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["d1.pdf", "d2.pdf", "d3.pdf"]
    assert pdf.relation(pdf.read_files(spark, str(tmp_path / "out")), "text_elements").count() == 2
    rows.where("name = 'd1.pdf'").write.format("pdf").mode("overwrite").save(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".pdf") == ["d1.pdf"]
    with pytest.raises(Exception, match="no file can be made"):
        rows.withColumn("name", F.lit("a/b.pdf")).write.format("pdf").mode("append").save(str(tmp_path / "bad"))
    assert not [p for p in (tmp_path / "bad").iterdir() if p.suffix == ".pdf"]


def test_store(spark, tmp_path):
    s = store.DocumentStore(spark, str(tmp_path / "open"))
    assert s.files().collect() == []
    files = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"b"))], "doc_id long, content binary")
    s.put(files)
    s.put(files.where("doc_id = 2").withColumn("content", F.lit(bytearray(b"c"))))
    assert {r.doc_id: bytes(r.content) for r in s.files().collect()} == {1: b"a", 2: b"c"}
    s.close(files.where("doc_id = 1"))
    assert {r.doc_id for r in s.files().collect()} == {2}
    opened = spark.createDataFrame([("a", 3), ("b", 3), ("a", 1), (None, 9), ("c", None), ("d", 5)], "file string, opened long")
    assert [tuple(r) for r in store.recent(opened, 2).orderBy("rank").collect()] == [("d", 5, 1), ("a", 3, 2)]


def test_edits_of_sealed_files(spark):
    files = generated.documents_as_files(spark.createDataFrame([(1, "more"), (2, "more")], "doc_id long, text string"), encryption=True)
    wanted = spark.createDataFrame([(1, 1, 0, "replace", "more", "less"), (1, 2, 0, "replace", "more", "less")], "edit_id long, doc_id long, page_index int, kind string, search string, replacement string")
    done = edits.apply_edits(files.withColumn("password", F.concat(F.lit("u"), "doc_id")), wanted)
    assert [r.changes for r in done.collect()] == [1, 1] and [r.text for r in pdf.relation(done, "text_elements").collect()] == ["less", "less"]
    assert all("password" in r.error for r in edits.apply_edits(files, wanted).collect())
    open_file = generated.documents_as_files(spark.createDataFrame([(1, "more")], "doc_id long, text string"))
    assert "page_index" in edits.apply_edits(open_file, wanted.withColumn("page_index", F.lit(None).cast("int"))).first().error


def test_sessions(spark):
    files = generated.documents_as_files(spark.createDataFrame([(1, "one")], "doc_id long, text string"))
    ask = lambda m: '{"id": 1, "method": "pdf/%s", "params": {"oldText": "one", "newText": "two"}}' % m
    read = endpoint.sessions(files, [ask("getPages"), "no request"]).first()
    assert read.content is None and len(read.responses) == 2 and "-32700" in read.responses[1]
    wrote = endpoint.sessions(files, [ask("updateText"), ask("getTextBlocks")]).first()
    assert wrote.content is not None and "two" in wrote.responses[1]
    assert endpoint.sessions(files, []).first().responses == []


def test_content_rewritten(spark):
    files = generated.documents_as_files(spark.createDataFrame([(1, "one\ntwo"), (2, "three")], "doc_id long, text string"))
    done = edits.rewritten_content(files, lambda instructions: [i for i in instructions if i.op != "Tj" or b"o" not in i.args[0]])
    assert sorted(r.text for r in pdf.relation(done, "text_elements").collect()) == ["three"] and done.where("error IS NOT NULL").count() == 0
    assert pdf.relation(edits.rewritten_content(files, lambda i: [], {5}), "text_elements").count() == 3
    bad = files.withColumn("content", F.lit(None).cast("binary"))
    assert "no content" in pdf.relation(bad, "documents_meta").first().error
