"""The kernel alone: codecs, ciphers, parsing, fonts, state machines, edits."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.kernel import bilevel, calculator, content, crypto, document, edit, encodings, fax, filters, fonts, graphics, text, writer
from quirelake.kernel.lexer import Lexer
from quirelake.kernel.objects import Name, PdfError, Ref, Str, Stream, plain, show_number, show_text


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_filters_round_trip(data):
    for name, decode in (("FlateDecode", filters.flate), ("LZWDecode", filters.lzw), ("ASCII85Decode", filters.ascii85), ("ASCIIHexDecode", filters.ascii_hex), ("RunLengthDecode", filters.run_length)):
        assert decode(filters.ENCODERS[name](data)) == data
    assert filters.lzw(filters.lzw_encode(data, 0), 0) == data


def test_long_lzw():
    rnd = random.Random(2)
    data = bytes(rnd.choice(b"abcab\0\xff") for _ in range(70_000))
    assert filters.lzw(filters.lzw_encode(data)) == data and filters.lzw(filters.lzw_encode(data, 0), 0) == data


def test_predictors():
    rows = [[1, 2, 3, 4], [2, 3, 4, 250], [9, 9, 9, 9]]
    assert filters.unpredicted(bytes([0, *rows[0]]), {"Predictor": 15, "Columns": 4}) == bytes(rows[0])
    assert filters.unpredicted(bytes([1, 1, 1, 1, 1, 2, 1, 1, 1, 1]), {"Predictor": 15, "Columns": 4}) == bytes([1, 2, 3, 4, 2, 3, 4, 5])
    assert filters.unpredicted(bytes([0, 10, 20, 30, 40, 3, 1, 1, 1, 1]), {"Predictor": 12, "Columns": 4}) == bytes([10, 20, 30, 40, 6, 14, 23, 32])
    assert filters.unpredicted(bytes([0, 10, 20, 4, 1, 1]), {"Predictor": 14, "Columns": 2}) == bytes([10, 20, 11, 21])
    assert filters.unpredicted(bytes([1, 1, 1, 5, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3, 5, 6, 7])


def test_damaged_flate_gives_what_it_can():
    import zlib

    data = zlib.compress(b"x" * 5000 + bytes(range(256)) * 8)
    assert filters.flate(data[: len(data) // 2]).startswith(b"x" * 100)
    assert filters.flate(zlib.compress(b"raw")[2:-4]) == b"raw"


def test_fax():
    rnd = random.Random(1)
    for _ in range(60):
        w, rows = rnd.choice([1, 7, 8, 9, 31, 64, 200, 1728, 3000]), []
        for _ in range(rnd.randint(1, 5)):
            row, black = [], rnd.random() < 0.5
            while len(row) < w:
                row += [black] * rnd.choice([1, 2, 3, 10, 70, 700])
                black = not black
            rows.append(list(rows[-1]) if rows and rnd.random() < 0.4 else row[:w])
        got = fax.decode_fax(fax.encode_g4(rows, w), {"K": -1, "Columns": w, "Rows": len(rows), "BlackIs1": True})
        size = (w + 7) // 8
        assert [[bool(got[y * size + x // 8] >> (7 - x % 8) & 1) for x in range(w)] for y in range(len(rows))] == rows


class Coder:
    """The arithmetic encoder, for tests."""

    def __init__(self):
        self.code, self.span, self.left, self.out = 0, 0x8000, 12, bytearray(b"\0")

    def _put(self):
        if self.out[-1] == 0xFF:
            self.out.append(self.code >> 20 & 255)
            self.code, self.left = self.code & 0xFFFFF, 7
            return
        if self.code & 0x8000000:
            self.out[-1] += 1
            self.code &= 0x7FFFFFF
            if self.out[-1] == 0xFF:
                self.out.append(self.code >> 20 & 255)
                self.code, self.left = self.code & 0xFFFFF, 7
                return
        self.out.append(self.code >> 19 & 255)
        self.code, self.left = self.code & 0x7FFFF, 8

    def bit(self, contexts, k, d):
        state, likely = contexts[k]
        p, more, less, swap = bilevel.STATES[state]
        self.span -= p
        if d == likely:
            if self.span & 0x8000:
                self.code += p
                return
            if self.span < p:
                self.span = p
            else:
                self.code += p
            contexts[k] = (more, likely)
        else:
            if self.span < p:
                self.code += p
            else:
                self.span = p
            contexts[k] = (less, 1 - likely if swap else likely)
        while not self.span & 0x8000:
            self.span <<= 1
            self.code <<= 1
            self.left -= 1
            if not self.left:
                self._put()

    def done(self):
        top = self.code + self.span
        self.code |= 0xFFFF
        if self.code >= top:
            self.code -= 0x8000
        for _ in range(2):
            self.code <<= self.left
            self._put()
        return bytes(self.out[1:]) + b"\xff\xac"


def test_bilevel():
    # The standard's own sequence for its coder.
    coder, one = bilevel.Arithmetic(bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")), [(0, 0)]
    bits = [coder.bit(one, 0) for _ in range(256)]
    assert int("".join(map(str, bits)), 2).to_bytes(32, "big").hex().upper() == "00020051000000C0035287 2AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF".replace(" ", "")
    rnd = random.Random(3)
    for template, adaptive in ((0, [(3, -1), (-3, -1), (2, -2), (-2, -2)]), (1, [(3, -1)]), (2, [(2, -1)]), (3, [(2, -1)])):
        w, h = 37, 9
        image = [[int(rnd.random() < 0.3 or x % 7 == y) for x in range(w)] for y in range(h)]
        enc, pixels = Coder(), bilevel.context_pixels(template, adaptive)
        contexts = [(0, 0)] * (1 << len(pixels))
        at = lambda x, y: image[y][x] if 0 <= y and 0 <= x < w else 0  # noqa: E731, B023
        for y in range(h):
            for x in range(w):
                k = 0
                for dx, dy in pixels:
                    k = k << 1 | at(x + dx, y + dy)
                enc.bit(contexts, k, image[y][x])
        body = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes(8) + bytes([0, template << 1]) + bytes(v & 255 for p in adaptive for v in p) + enc.done()
        page = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes(11)
        data = b"".join(n.to_bytes(4, "big") + bytes([kind, 0, 1]) + len(d).to_bytes(4, "big") + d for n, kind, d in ((0, 48, page), (1, 38, body)))
        got = bilevel.decode_bilevel(data)
        size = (w + 7) // 8
        assert [[1 - (got[y * size + x // 8] >> (7 - x % 8) & 1) for x in range(w)] for y in range(h)] == image
    with pytest.raises(PdfError):
        bilevel.decode_bilevel(b"\0\0\0\0\6\0\1\0\0\0\0")


def test_cipher_vectors():
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypto.Aes(bytes(range(16))).block(block).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    c = crypto.Aes(bytes(range(32))).block(block)
    assert c.hex() == "8ea2b7ca516745bfeafc49904b496089" and crypto.Aes(bytes(range(32))).unblock(c) == block
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert crypto.aes_decrypt(b"k" * 16, crypto.aes_encrypt(b"k" * 16, b"hello", b"i" * 16)) == b"hello"


@pytest.mark.parametrize(
    ("source", "value"),
    [(b"12", 12), (b"-1.5", -1.5), (b".5", 0.5), (b"+5", 5), (b"--5", -5), (b"4.", 4.0), (b"true", True), (b"null", None), (b"/A#20b", Name("A b")), (b"(a(b)c\\)\\101\\n\\\r\nx)", Str(b"a(b)c)A\nx")), (b"(\\53a\\7)", Str(b"+a\x07")), (b"<48 65 6>", Str(b"He`")), (b"[1 2 0 R (x)]", [1, Ref(2), Str(b"x")]), (b"<</A 1/B[/C]%c\n/D<</E 2 1 R>>>>", {"A": 1, "B": [Name("C")], "D": {"E": Ref(2, 1)}})],
)
def test_lexer(source, value):
    assert Lexer(source).next() == value


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=60), st.text(alphabet=st.characters(min_codepoint=33, max_codepoint=255), max_size=12))
def test_values_round_trip(raw, name):
    value = {"A": Str(raw), "B": [Name(name), 1.5, -3, True, None, Ref(4, 2)]}
    assert Lexer(content.write_value(value)).next() == value


def sample(packed=False, encryption=None):
    b = writer.Builder()
    c = writer.ContentBuilder().begin_text().font("F1", 12).move(10, 20).show(b"Hello caf\xe9 the the").next_line().op("TJ", [Str(b"ab"), -200, Str(b"cd")]).end_text().fill_rgb(1, 0, 0).rectangle(1, 2, 3, 4).fill()
    b.page(c.build(), ["FlateDecode"])
    branch = b.branch(MediaBox=[0, 0, 10, 20], Rotate=90)
    b.page([b"BT /F1 9 Tf (a", b") Tj ET"], box=None, parent=branch)
    b.info(Title="T中", Author="me")
    return b.build(packed, encryption)


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("scheme", [None, "rc4-40", "rc4-128", "aes-128", "aes-256-r5", "aes-256"])
def test_files_round_trip(packed, scheme):
    data = sample(packed, (scheme, "u", "o") if scheme else None)
    for password in ("u", "o") if scheme else ("",):
        d = document.parse(data, password)
        pages = d.pages()
        assert len(pages) == d.declared_pages == 2 and not d.errors and show_text(d.info["Title"]) == "T中"
        assert d.box(pages[1]) == (0, 0, 10, 20) == d.box(pages[1], "CropBox") and d.rotation(pages[1]) == 90
        assert [e.text for e in text.page_text(d, pages[0]).elements] == ["Hello café the the", "ab", "cd"]
        assert [e.text for e in text.page_text(d, pages[1]).elements] == ["a\n"]
    if scheme:
        with pytest.raises(PdfError, match="wrong"):
            document.parse(data, "bad")


def test_revisions_hide_freed_objects():
    data = sample()
    d = document.parse(data)
    n = max(d.objects) + 1
    data = writer.append_revision(data, {n: (0, {"A": 1})}, [], d.trailer, d.start, n)
    d = document.parse(data)
    assert d.objects[n][1] == {"A": 1}
    data = writer.append_revision(data, {}, [n], d.trailer, d.start, n + 1)
    assert n not in document.parse(data).objects


def test_hostile_files():
    data, rnd = sample(), random.Random(4)
    for k in range(200):
        bad = bytearray(data)
        for _ in range(rnd.randint(1, 20)):
            bad[rnd.randrange(len(bad))] = rnd.randrange(256)
        cut = bytes(bad[: rnd.randint(0, len(bad))] if k % 2 else bad)
        try:
            d = document.parse(cut)
            for p in d.pages():
                text.page_text(d, p)
        except (PdfError, EOFError, ValueError, TypeError, AttributeError, RecursionError, KeyError, IndexError, OverflowError):
            pass
    b = writer.Builder()
    b.objects[b.tree.num]["Kids"].append(b.tree)
    b.page(b"")
    assert len(document.parse(b.build()).pages()) == 1
    with pytest.raises(PdfError):
        document.parse(b"%PDF-1.4 short")


def test_long_and_wrong_lengths():
    b = writer.Builder()
    b.page(b"BT (" + b"x" * 200_000 + b") Tj ET")
    d = document.parse(b.build())
    assert len(text.page_text(d, d.pages()[0]).elements[0].text) == 200_000
    d = document.parse(sample().replace(b"/Length ", b"/Length 9"))
    assert [e.text for e in text.page_text(d, d.pages()[0]).elements][0] == "Hello café the the"


def test_inline_images_and_unknown_operators():
    got = content.parse_content(b"q BI /W 2 /H 2 /BPC 8 /CS /G ID \x01EI\x02 EI Q 1 2 zz (x) Tj")
    assert [i.op for i in got] == ["q", "BI", "Q", "zz", "Tj"]
    assert got[1].args[0].raw == b"\x01EI\x02" and got[1].args[0].dict["ColorSpace"] == "DeviceGray"
    assert content.parse_content(content.serialize(got)) == got


def test_kerning_moves_and_blocks():
    c = b"BT /F1 10 Tf 14 TL 1 0 0 1 50 700 Tm [(ab) -200 (cd)] TJ (e) ' 2 1 (x y) \" ET"
    m = text.TextMachine({"F1": fonts.Font(default_width=500)}, gap=-100)
    m.run(content.parse_content(c))
    assert [(e.text, round(e.x, 6), e.y) for e in m.elements] == [("ab", 50, 700), ("cd", 62, 700), ("e", 50, 686), ("x y", 50, 672)]
    assert round(m.elements[-1].width, 6) == 15 + 3 * 1 + 2 and m.blocks[0][0] == "ab cdex y"


def test_fonts():
    cmap = fonts.parse_cmap(b"1 begincodespacerange <00> <7F> endcodespacerange 1 begincodespacerange <8000> <FFFF> endcodespacerange 2 beginbfrange <8041> <8043> <0061> <8050> <8051> [<0078> <00790079>] endbfrange 1 beginbfchar <01> <D83DDE00> endbfchar 1 begincidrange <8000> <80FF> 7 endcidrange 1 beginnotdefrange <00> <7F> 1 endnotdefrange")
    assert cmap.split(b"\x01\x80\x41\x80\x51") == [b"\x01", b"\x80\x41", b"\x80\x51"]
    assert [cmap.text_of(c) for c in (b"\x01", b"\x80\x43", b"\x80\x51")] == ["😀", "c", "yy"] and cmap.cid_of(b"\x80\x05") == 12 and cmap.cid_of(b"\x02") == 1
    f = fonts.Font("Type0", cmap=fonts.predefined("90ms-RKSJ-H"))
    assert f.decode("日本abc".encode("cp932")) == "日本abc" and f.encode("日本") == "日本".encode("cp932")
    assert fonts.Font("Type0", cmap=fonts.predefined("UniGB-UCS2-H")).decode("中".encode("utf-16-be")) == "中"
    assert encodings.glyph("eacute") == "é" and encodings.glyph("alpha") == "α" and encodings.glyph("uni20AC") == "€" and encodings.glyph("f_i") == "fi" and encodings.glyph("seven") == "7" and encodings.glyph("nonsense") is None
    assert encodings.table("WinAnsiEncoding")[0x80] == "€" and encodings.table("StandardEncoding")[0xE1] == "Æ" and encodings.private_use("") == "α"
    assert fonts.script_of("MS-Mincho") == "japanese" and fonts.is_cjk("GB1") and not fonts.is_cjk("Identity")


def test_paths():
    got = graphics.paths(content.parse_content(b"1 0 0 rg 2 w -5 -5 m -1 -2 l f* q 0 0 1 RG 0 0 m 1 1 2 2 v S Q 0 0 0 1 k 1 2 3 4 re b 9 9 m n 1 2 3 4 re B"))
    assert [p.bounds() for p in got] == [(-5, -5, -1, -2), (0, 0, 2, 2), (1, 2, 4, 6), (1, 2, 4, 6)]
    assert got[0].fill == (1, 0, 0) and got[1].stroke == (0, 0, 1) and got[2].fill == (0, 0, 0) and got[2].stroke == (0, 0, 0) and got[3].line_width == 2


def test_pixels():
    import numpy as np

    assert graphics.samples(b"\xa0", 3, 1, 1, 1).ravel().tolist() == [1, 0, 1] and graphics.samples(b"\x12\x34", 1, 1, 1, 16).ravel().tolist() == [0x1234]
    assert graphics.rgb(np.array([[0, 255, 0, 0], [0, 0, 0, 255]], np.uint8)).tolist() == [[255, 0, 255], [0, 0, 0]]
    d = document.parse(sample())
    im = graphics.Image("I", 2, 1, 8, "Indexed", None, Stream({"ColorSpace": [Name("Indexed"), Name("DeviceRGB"), 1, Str(b"\1\2\3\4\5\6")]}, b"\1\0"))
    assert graphics.pixels(d, im) == b"\4\5\6\1\2\3"


def test_functions():
    d = document.parse(sample())
    run = lambda x, *v: calculator.evaluate(d, x, list(v))
    two = {"FunctionType": 2, "Domain": [0, 1], "C0": [0, 1], "C1": [1, 0], "N": 2}
    assert run(two, 0.5) == [0.25, 0.75] and run(two, 7) == [1, 0]
    stitched = {"FunctionType": 3, "Domain": [0, 1], "Functions": [two, two], "Bounds": [0.5], "Encode": [0, 1, 1, 0]}
    assert run(stitched, 0.25) == [0.25, 0.75] and run(stitched, 0.5) == [1, 0]
    grid = Stream({"FunctionType": 0, "Domain": [0, 1, 0, 1], "Range": [0, 255], "Size": [2, 2], "BitsPerSample": 8}, bytes([0, 100, 200, 255]))
    assert run(grid, 0, 0) == [0] and run(grid, 1, 0) == [100] and run(grid, 0.5, 0.5) == [138.75]
    program = lambda p, *v: calculator.run_program(calculator.compile_program(p), list(v))
    assert program(b"{ dup mul exch 2 gt {1} {0} ifelse }", 3.0, 4.0) == [16, 1]
    assert program(b"{ 1 2 3 3 1 roll }") == [3, 1, 2] and program(b"{ 1 2 3 3 -1 roll 2 copy 1 index }") == [2, 3, 1, 3, 1, 3]
    assert [round(x, 6) for x in program(b"{ 90 sin 180 cos 1 0 atan 7 2 idiv -7 3 mod 5 0 div 1 3 bitshift 8 -2 bitshift 6 3 and 6 3 xor 2.5 round -2.5 truncate 100 log true not }")] == [1, -1, 90, 3, -1, 0, 8, 2, 2, 5, 3, -2, 2, 0]
    with pytest.raises(PdfError):
        program(b"{ pop pop }", 1.0)


def test_edits():
    data = sample()
    d = document.parse(data)
    changed, counts = edit.apply_edits(d, [{"kind": "replace", "page_index": 0, "search": "THE", "replacement": "a", "ignore_case": True}, {"kind": "add", "page_index": 0, "replacement": "new", "x": 1, "y": 2}, {"kind": "delete", "page_index": 0, "search": "abcd"}, {"kind": "modify", "page_index": 1, "font_name": "F1", "search": "a\n", "replacement": "b"}, {"kind": "replace", "page_index": 9, "search": "x"}])
    assert counts == [2, 1, 1, 1, 0]
    for again in (edit.revised(data, d, changed), edit.rewritten(d)):
        got = document.parse(again)
        assert [[e.text for e in text.page_text(got, p).elements] for p in got.pages()] == [["Hello café a a", "new"], ["b"]]
    assert edit.revised(data, d, changed).startswith(data)


def test_edits_of_instructions():
    i = content.parse_content(b"1 0 0 rg 1 0 0 rg q q Q 1 0 0 rg 0 g Q 1 0 0 rg 2 w 2 w q 1 0 0 1 0 0 cm /Im1 Do Q (x) Tj")
    assert [x.op for x in edit.optimize(i)] == ["rg", "q", "g", "Q", "w", "q", "cm", "Do", "Q", "Tj"]
    assert [x.op for x in edit.without_image(i, "Im1")][-2:] == ["w", "Tj"]
    new = [content.Instruction("n")]
    at = lambda where, k=0: [x.op for x in edit.insert(i[:2], new, where, k)].index("n")
    assert (at("start"), at("end"), at("before", 1), at("after", 0), at("after", 1)) == (0, 2, 1, 1, 2)
    c = content.parse_content(b"BT (a) Tj ET BT (b) Tj (c) Tj ET")
    got, n = edit.replace_in_object(c, 1, b"z")
    assert n == 1 and [x.args[0] for x in got if x.op == "Tj"] == [b"a", b"z", b"c"]
    assert len(content.parse_content(content.serialize(graphics.drawn("ellipse", [0, 0, 1, 1], fill=(0, 0, 0))))) == 11


def test_edits_of_images_and_objects():
    b = writer.Builder()
    im = b.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 1, "Height": 1, "BitsPerComponent": 8, "ColorSpace": Name("DeviceGray")}, b"\x07"))
    shared = b.add({"XObject": {"Im1": im}, "Font": {"F1": b.default_font()}})
    for _ in range(2):
        b.page(b"2 0 0 2 0 0 cm BT /F1 9 Tf (a) Tj ET BT (b) Tj (c) Tj ET q 5 0 0 5 1 1 cm /Im1 Do Q", resources=shared)
    data = b.build()
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x03\x00\x04\x03" + bytes(9) + b"\xff\xd9"
    rows = [
        {"kind": "replace_image", "page_index": 0, "search": "Im1", "image": bytes(range(12)), "width": 2, "height": 2},
        {"kind": "replace_image", "page_index": 0, "search": "Im9", "image": b"x", "width": 1, "height": 1},
        {"kind": "add_image", "page_index": 1, "image": jpeg, "numbers": [10, 20, 30, 40]},
        {"kind": "replace_in_object", "page_index": 1, "index": 1, "replacement": "é"},
        {"kind": "replace_in_object", "page_index": 1, "index": 5, "replacement": "z"},
    ]
    d = document.parse(data)
    changed, counts = edit.apply_edits(d, rows)
    assert counts == [1, 0, 1, 1, 0]
    for again in (edit.revised(data, d, changed), edit.rewritten(d)):
        got = document.parse(again)
        found = [{i.name: i for i in graphics.images(got, p, content.parse_content(got.page_content(p)))} for p in got.pages()]
        assert [sorted(x) for x in found] == [["Im1"], ["Im1", "Im2"]]
        assert (found[1]["Im1"].width, found[1]["Im1"].height, got.content(found[0]["Im1"].stream)) == (2, 2, bytes(range(12)))
        assert (found[1]["Im2"].width, found[1]["Im2"].height, tuple(found[1]["Im2"].position), found[1]["Im2"].stream.raw) == (4, 3, (10, 20, 30, 40), jpeg)
        assert [[e.text for e in text.page_text(got, p).elements] for p in got.pages()] == [["a", "b", "c"], ["a", "é", "c"]]
    for bad in ({"kind": "turn_image"}, {}, {"kind": "add_image", "image": b"abc", "width": 2, "height": 2, "numbers": [0, 0, 1, 1]}, {"kind": "add_image", "image": b"\xff\xd8\xff\xd9", "numbers": [0, 0, 1, 1]}):
        with pytest.raises(PdfError):
            edit.apply_edits(document.parse(data), [{"page_index": 0} | bad])


def test_shown_values():
    assert [show_number(x) for x in (1.0, 0.5, -2, 1 / 3, 1e-9, True)] == ["1", "0.5", "-2", "0.333333", "0", "true"]
    assert plain({"A": Name("B"), "C": [Ref(1, 2), Str(b"\xfe\xff\x4e\x2d"), 2.0], "D": Stream({}, b"xy")}) == {"A": "/B", "C": ["1 2 R", "中", 2], "D": {"type": "stream", "dictionary": {}, "dataLength": 2}}
