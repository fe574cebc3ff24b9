"""What files have in common, or is asked for again, is worked out once."""

from __future__ import annotations

import time

from quirelake.kernel import calculator, content, crypto, filters, fonts, writer
from quirelake.kernel.document import parse
from quirelake.kernel.objects import Stream
from quirelake.kernel.text import page_text
from quirelake.plans import documents, formats
from quirelake.sources import generated, pdf


def counted(monkeypatch, module, name: str) -> list:
    calls, real = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda *a, **k: (calls.append(a), real(*a, **k))[1])
    return calls


ITEMS = [{"l_linenumber": n, "l_partkey": 1, "l_quantity": 7, "l_discount": 0.04, "l_tax": 0.02} for n in range(1, 41)]


def test_a_font_of_many_pages_is_read_once(monkeypatch):
    doc = parse(formats._text_state(1, ITEMS))
    calls = counted(monkeypatch, fonts, "read_font")
    found = [page_text(doc, p).elements for p in doc.pages()]
    assert len(calls) == 1 and [e.text for e in found[39]] == ["a b", "c", "d"] and len(found) == 40
    # An object that was replaced is read anew.
    page = doc.pages()[0]
    ref = doc.resources(page)["Font"]["F1"]
    doc.objects[ref.num] = (ref, doc.get(ref) | {"FirstChar": 97, "Widths": [1000]})
    assert page_text(doc, page).fonts["F1"].widths == {97: 1000.0}


def test_a_code_is_looked_up_once_in_its_font(monkeypatch):
    calls = counted(monkeypatch, fonts.Font, "text_of")
    doc = parse(generated.one_page(1, "\n".join(["abba"] * 100)))
    assert [e.text for e in page_text(doc, doc.pages()[0]).elements] == ["abba"] * 100 and len(calls) <= 2


def test_an_object_is_written_once(monkeypatch):
    b = writer.Builder()
    b.page(b"q Q")
    calls = counted(monkeypatch, writer, "write_value")
    assert parse(b.build()).declared_pages == 1
    assert len(calls) == len(b.objects) + 1  # and the trailer


def test_a_program_is_compiled_once(monkeypatch):
    b = writer.Builder()
    b.page(b"")
    f = b.add(Stream({"FunctionType": 4, "Domain": [0, 9], "Range": [0, 99]}, b"{ 7 mul 3 add dup 50 gt { 2 sub } if }"))
    doc = parse(b.build())
    calls = counted(monkeypatch, calculator, "compile_program")
    assert [calculator.evaluate(doc, f, [x])[0] for x in (0.0, 1.0, 8.0) * 5] == [3.0, 10.0, 57.0] * 5 and len(calls) == 1


def test_rounds_of_the_same_key_are_worked_out_once(monkeypatch):
    one = generated.one_page(2, "text", [], False, ("rc4-128", "u", "own"))
    calls = counted(monkeypatch, crypto, "keystream")
    for _ in range(5):
        assert page_text(doc := parse(one, "own"), doc.pages()[0]).elements[0].text == "text"
    assert len(calls) < 80


def test_blocks_of_aes_there_and_back():
    key = bytes(range(32))
    for n in (0, 15, 16, 400, 511, 512, 5000):
        data = bytes(i * 7 & 255 for i in range(n))
        assert crypto.aes_decrypt(key, crypto.aes_encrypt(key, data, key[:16])) == data
    began, data = time.time(), bytes(2_000_000)
    assert crypto.Aes(key).uncbc(data, bytes(16))[:16] == crypto.Aes(key).unblock(bytes(16))
    assert time.time() - began < 2


def test_predictors_and_lzw_of_much_data():
    data, began = bytes(i * i >> 5 & 255 for i in range(2_000_000)), time.time()
    coded = formats.predicted(data, 15, 100)
    assert time.time() - began < 3
    assert len(coded) == 2_020_000 and filters.unpredicted(coded[: 101 * 500], {"Predictor": 15, "Columns": 100}) == data[:50_000]
    for text in (b"", b"a", b"abc" * 40_000, data[:70_000]):
        assert filters.lzw(filters.lzw_encode(text)) == text


def test_only_the_columns_that_are_asked_for(spark):
    files = spark.createDataFrame([(1, bytearray(generated.one_page(1, "a\nb")))], "doc_id long, content binary")
    got = pdf.relation(files, "text_elements", columns=["doc_id", "elem_idx", "text"])
    assert got.columns == ["doc_id", "elem_idx", "text"] and {tuple(r) for r in got.collect()} == {(1, 0, "a"), (1, 1, "b")}
    assert documents._texts(files).columns == ["doc_id", "page_index", "elem_idx", "text"]
    assert [i.op for i in content.parse_content(b"BT (x) Tj ET")] == ["BT", "Tj", "ET"]
