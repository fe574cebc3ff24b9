"""Queries over what a file's format has beyond plain text: every operator and state, colours, predictors, fax, ciphers, relations, edits, sinks."""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions import codecs, geometry, numeric
from quirelake.operators import store
from quirelake.operators.tables import shared_folder, written
from quirelake.plans.documents import ROUND_TRIP, _read_back, _texts, request
from quirelake.plans.relational import read
from quirelake.sources import datasource, edits, endpoint, generated, pdf
from quirelake.streaming import files as streaming

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: A page that has every operator of the format.
EVERY = (
    "q 1 0 0 1 0 0 cm 2 w 1 J 1 j 4 M [3 1] 0 d /Perceptual ri 1 i /G1 gs 0 0 m 5 5 l 1 2 3 4 5 6 c 1 2 3 4 v 1 2 3 4 y h S "
    "0 0 9 9 re s 0 0 9 9 re f 0 0 9 9 re F 0 0 9 9 re f* 0 0 9 9 re B 0 0 9 9 re B* 0 0 9 9 re b 0 0 9 9 re b* 0 0 9 9 re W n 0 0 9 9 re W* n "
    "BT /F1 10 Tf 1 Tc 1 Tw 90 Tz 12 TL 0 Tr 1 Ts 5 5 Td 0 -5 TD 1 0 0 1 3 3 Tm T* (a) Tj [(a) -20 (c)] TJ (a) ' 1 2 (a) \" ET "
    "/DeviceRGB CS /DeviceRGB cs 1 0 0 SC 1 0 0 SCN 0 1 0 sc 0 1 0 scn 0.5 G 0.5 g 1 0 0 RG 1 0 0 rg 0 0 0 1 K 0 0 0 1 k /S1 sh /X1 Do "
    "/M MP /M /P DP /M BMC EMC /M /P BDC EMC BX EX Q"
)
_TIMES = Counter(t for t in EVERY.split() if re.fullmatch(r"[A-Za-z]+\*?|'|\"|'|T\*", t))
_CATEGORY = {
    "graphics_state": "q Q cm w J j M d ri i gs", "path_construction": "m l c v y h re", "path_painting": "S s f F f* B B* b b* n", "clipping_path": "W W*", "text_object": "BT ET", "text_state": "Tc Tw Tz TL Tf Tr Ts",
    "text_positioning": "Td TD Tm T*", "text_showing": "Tj TJ ' \"", "color": "CS cs SC SCN sc scn G g RG rg K k", "shading": "sh", "external_object": "Do", "marked_content": "MP DP BMC BDC EMC", "compatibility": "BX EX",
}
_ROWS = ", ".join(f"('{op.replace(chr(39), chr(39) * 2)}', '{c}', {_TIMES[op]})" for c, ops in _CATEGORY.items() for op in ops.split())


def _every(doc_id, items):
    from quirelake.kernel.writer import Builder

    b = Builder()
    for item in items:
        # The turn's own lines are shown too.
        shown = " ".join(f"<{line.encode('latin-1', 'replace').hex()}> Tj" for line in (item["text"] or "").split("\n"))
        b.page(f"{EVERY} BT /F1 9 Tf {shown} ET".encode(), ["FlateDecode"])
    return b.build()


@query(f"SELECT conv_id AS doc_id, op, category, (p * (k + CASE WHEN op IN ('BT', 'ET', 'Tf') THEN 1 ELSE 0 END) + CASE WHEN op = 'Tj' THEN lines ELSE 0 END)::BIGINT AS n FROM (SELECT conv_id, count(*) AS p, sum(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1) AS lines FROM conversations GROUP BY 1), (VALUES {_ROWS}) v(op, category, k)")
def pdf_every_operator(spark, d):
    """Every operator of the format, and a Tj for each line of each turn."""
    files = generated.made(generated.gathered(read(spark, d, "conversations"), "conv_id", ["turn", "role"], "text"), _every, "items")
    return pdf.relation(files, "instructions").groupBy("doc_id", "op", "category").agg(F.count("*").alias("n"))


LINE_ROWS = "(SELECT l_orderkey AS doc_id, l_linenumber AS n, l_quantity AS q, l_discount AS d, l_tax AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount, l_tax) - 1 AS k FROM lineitem)"


def _of_lines(spark, d, build) -> DataFrame:
    """A file for each order, a page for each of its lines."""
    return generated.made(generated.gathered(read(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], "l_quantity", "l_discount", "l_tax"), build, "items")


def _pages(contents: list[bytes]) -> bytes:
    from quirelake.kernel.writer import Builder

    b = Builder()
    for c in contents:
        b.page(c, ["FlateDecode"])
    return b.build()


def _text_state(doc_id, items):
    page = lambda n, q: f"BT /F1 10 Tf {n} Tc {q % 5} Tw {50 + 10 * n} Tz {n % 3} Tr {n} Ts 20 TL 50 700 Td (a b) Tj 5 -30 TD (c) Tj T* (d) Tj ET"
    return _pages([page(int(i["l_linenumber"]), int(i["l_quantity"])).encode() for i in items])


@query(f"""SELECT doc_id, k::INT AS page_index, j AS elem_idx, s AS text, x::DOUBLE AS x, (y + n)::DOUBLE AS y, n % 3 AS render_mode, n::DOUBLE AS char_spacing, (q::INT % 5)::DOUBLE AS word_spacing, round((5 + n) * (0.5 + n / 10) * len(s) + CASE j WHEN 0 THEN (q::INT % 5) * (0.5 + n / 10) ELSE 0 END, 3) AS width
FROM {LINE_ROWS}, LATERAL (VALUES (0, 'a b', 50, 700), (1, 'c', 55, 670), (2, 'd', 55, 640)) v(j, s, x, y)""")
def pdf_text_state(spark, d):
    """Spacing, scale, rise, mode and leading."""
    e = pdf.relation(_of_lines(spark, d, _text_state), "text_elements", columns=["doc_id", "page_index", "elem_idx", "text", "x", "y", "render_mode", "char_spacing", "word_spacing", "width"])
    real = lambda c: F.round(F.col(c).cast("double"), 3).alias(c)
    return e.select("doc_id", "page_index", "elem_idx", "text", real("x"), real("y"), "render_mode", real("char_spacing"), real("word_spacing"), real("width"))


PAINTS = ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n")


def _paint(doc_id, items):
    page = lambda n, q: f"{n} w 0 0 m 10 {q} l 20 20 30 30 v 40 40 50 50 y {PAINTS[(int(doc_id) + n) % 10]} 0 0 1 1 re W n"
    return _pages([page(int(i["l_linenumber"]), int(i["l_quantity"])).encode() for i in items])


@query(f"""SELECT doc_id, k::INT AS page_index, 0 AS elem_idx, CASE WHEN op IN ('s', 'b', 'b*') THEN 5 ELSE 4 END AS n_segments, op NOT IN ('f', 'F', 'f*') AS stroked, op NOT IN ('S', 's') AS filled, n::DOUBLE AS line_width, 50.0::DOUBLE AS urx, greatest(50, q::INT)::DOUBLE AS ury
FROM (SELECT *, (['S', 's', 'f', 'F', 'f*', 'B', 'B*', 'b', 'b*', 'n'])[((doc_id + n) % 10 + 1)::INT] AS op FROM {LINE_ROWS}) WHERE op <> 'n'""")
def pdf_paints(spark, d):
    """Every painting operator, curves with one control point, and clips that paint nothing."""
    g = pdf.relation(_of_lines(spark, d, _paint), "graphics_elements")
    return g.select("doc_id", "page_index", "elem_idx", F.size("segments").alias("n_segments"), F.col("stroke").isNotNull().alias("stroked"), F.col("fill").isNotNull().alias("filled"), F.col("line_width").cast("double").alias("line_width"), F.col("bounds.urx").cast("double").alias("urx"), F.col("bounds.ury").cast("double").alias("ury"))


def _colours(doc_id, items):
    def page(n: int, d: float, t: float) -> str:
        up = ("{d} G", "{d} {t} 0.5 RG", "{d} {t} 0 0.5 K", "/DeviceRGB CS {d} {t} 0.25 SC", "/DeviceGray CS {t} SCN")[n % 5]
        low = ("{t} g", "{t} {d} 0.5 rg", "{t} {d} 0 0.5 k", "/DeviceRGB cs {t} {d} 0.25 sc", "/DeviceGray cs {d} scn")[n % 5]
        return f"q 1 1 1 RG {up} {low} 0 0 1 1 re B Q 2 2 1 1 re B".format(d=d, t=t)

    return _pages([page(int(i["l_linenumber"]), float(i["l_discount"]), float(i["l_tax"])).encode() for i in items])


def _colour_sql(a: str, b: str) -> str:
    return f"round(CASE n % 5 WHEN 0 THEN {a} WHEN 1 THEN {a} WHEN 2 THEN (1 - {a}) * 0.5 WHEN 3 THEN {a} ELSE {b} END, 5)", f"round(CASE n % 5 WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN (1 - {b}) * 0.5 WHEN 3 THEN {b} ELSE {b} END, 5)", f"round(CASE n % 5 WHEN 0 THEN {a} WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 ELSE {b} END, 5)"


_S, _F = _colour_sql("d", "t"), _colour_sql("t", "d")


@query(f"""SELECT doc_id, k::INT AS page_index, j AS elem_idx, CASE j WHEN 0 THEN {_S[0]} ELSE 0 END::DOUBLE AS s0, CASE j WHEN 0 THEN {_S[1]} ELSE 0 END::DOUBLE AS s1, CASE j WHEN 0 THEN {_S[2]} ELSE 0 END::DOUBLE AS s2,
CASE j WHEN 0 THEN {_F[0]} ELSE 0 END::DOUBLE AS f0, CASE j WHEN 0 THEN {_F[1]} ELSE 0 END::DOUBLE AS f1, CASE j WHEN 0 THEN {_F[2]} ELSE 0 END::DOUBLE AS f2 FROM {LINE_ROWS}, (VALUES (0), (1)) v(j)""")
def pdf_colours(spark, d):
    """Gray, RGB and CMYK, and colours of named spaces; the state comes back after Q."""
    g = pdf.relation(_of_lines(spark, d, _colours), "graphics_elements", columns=["doc_id", "page_index", "elem_idx", "stroke", "fill"])
    each = [F.round(F.get(c, F.lit(i)).cast("double"), 5).alias(f"{c[0]}{i}") for c in ("stroke", "fill") for i in range(3)]
    return g.select("doc_id", "page_index", "elem_idx", *each)


@query("""WITH c AS (SELECT conv_id AS doc_id, count(*) AS p, ceil(count(*) / 3)::BIGINT AS b FROM conversations GROUP BY 1)
SELECT doc_id, kind, n FROM (SELECT doc_id, 'used' AS kind, CASE WHEN doc_id % 2 = 0 THEN 3 + b + 2 * p ELSE p + ceil((3 + b + p) / 100)::BIGINT + 1 END AS n FROM c UNION ALL SELECT doc_id, 'packed', 3 + b + p FROM c WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 'free', 1 FROM c)""")
def pdf_xref(spark, d):
    """Entries of tables and of cross-reference streams by kind."""
    x = pdf.relation(generated.turns_as_files(read(spark, d, "conversations")), "xref")
    return x.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS page_index, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS l, string_split(coalesce(text, ''), chr(10)) AS a FROM conversations)
SELECT doc_id, page_index, 0 AS block_idx, md5(array_to_string(l, '')) AS text_md5, 36.0::DOUBLE AS x, (756 - 12 * (list_position(a, l[1]) - 1))::DOUBLE AS y, 'F1' AS font, 10.0::DOUBLE AS font_size FROM t WHERE len(l) > 0""")
def pdf_blocks(spark, d):
    """A block for each text object."""
    b = pdf.relation(generated.turns_as_files(read(spark, d, "conversations")), "text_blocks")
    return b.select("doc_id", "page_index", "block_idx", F.md5("text").alias("text_md5"), F.col("x").cast("double").alias("x"), F.round(F.col("y").cast("double"), 3).alias("y"), "font", F.col("font_size").cast("double").alias("font_size"))


@query("SELECT conv_id AS doc_id, 'F1' AS res_name, 'Type1' AS subtype, 'Helvetica' AS base_font, 'WinAnsiEncoding' AS encoding, NULL::VARCHAR AS embedded, count(*) AS pages FROM conversations GROUP BY 1")
def pdf_font_table(spark, d):
    f = pdf.relation(generated.turns_as_files(read(spark, d, "conversations")), "fonts")
    return f.groupBy("doc_id", "res_name", "subtype", "base_font", "encoding", "embedded").agg(F.count("*").alias("pages"))


def _crops(doc_id, items):
    from quirelake.kernel.writer import Builder

    b = Builder()
    for i in items:
        key = int(i["c_custkey"])
        b.page(b"", box=[0, 0, 100 + key % 7, 200], resources={"ProcSet": key}, **({"CropBox": [5, 5, 50 + key % 11, 60]} if key % 2 else {}))
    return b.build()


@query("""SELECT c_nationkey::BIGINT AS doc_id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS page_index, CASE WHEN c_custkey % 2 = 1 THEN 50 + c_custkey % 11 ELSE 100 + c_custkey % 7 END::DOUBLE AS crop_right, (100 + c_custkey % 7)::DOUBLE AS media_right, c_custkey AS proc FROM customer""")
def pdf_crop_boxes(spark, d):
    """Crop boxes, which are the media box where there is none, and resources as JSON."""
    rows = read(spark, d, "customer").withColumn("doc", F.col("c_nationkey").cast("long"))
    p = pdf.relation(generated.made(generated.gathered(rows, "doc", ["c_custkey"]), _crops, "items"), "pdf_pages")
    return p.select("doc_id", "page_index", F.col("crop_box.urx").cast("double").alias("crop_right"), F.col("media_box.urx").cast("double").alias("media_right"), F.get_json_object("resources_json", "$.ProcSet").cast("long").alias("proc"))


def predicted(data: bytes, predictor: int, columns: int) -> bytes:
    """data with a row predictor: 2 (differences of bytes), or 10 to 15 (PNG: 15 takes another kind for each row); data is filled up with spaces."""
    data = data.ljust(-(-len(data) // columns) * columns)
    rows = np.frombuffer(data, np.uint8).reshape(-1, columns).astype(np.int16)
    left, before, corner = (np.zeros_like(rows) for _ in range(3))
    left[:, 1:], before[1:], corner[1:, 1:] = rows[:, :-1], rows[:-1], rows[:-1, :-1]
    if predictor == 2:
        return (rows - left).astype(np.uint8).tobytes()
    to_left, to_before, to_corner = abs(before - corner), abs(left - corner), abs(left + before - 2 * corner)
    near = np.where((to_left <= to_before) & (to_left <= to_corner), left, np.where(to_before <= to_corner, before, corner))
    kinds = np.arange(len(rows)) % 5 if predictor == 15 else np.full(len(rows), predictor - 10)
    guesses = np.choose(kinds[:, None], [np.zeros_like(rows), left, before, (left + before) // 2, near])
    return np.hstack([kinds[:, None], rows - guesses]).astype(np.uint8).tobytes()


def _predictors(doc_id, text):
    """Content behind one of seven predictors, under Flate or LZW."""
    from quirelake.kernel.filters import encode
    from quirelake.kernel.objects import Name, Ref, Stream
    from quirelake.kernel.writer import Builder

    n = int(doc_id)
    predictor, columns, name = (2, 10, 11, 12, 13, 14, 15)[n % 7], 20 + n % 13, ("FlateDecode", "LZWDecode")[n // 7 % 2]
    b = Builder()
    page = b.objects[b.page(b"").num]
    raw = encode(predicted(generated.lines_content(text or ""), predictor, columns), [name])
    b.objects[page["Contents"].num] = Stream({"Filter": Name(name), "DecodeParms": {"Predictor": predictor, "Columns": columns, "Colors": 1, "BitsPerComponent": 8}}, raw)
    assert isinstance(page["Contents"], Ref)
    return b.build()


@query(ROUND_TRIP)
def pdf_predictors(spark, d):
    return _read_back(generated.made(read(spark, d, "documents"), _predictors, "text"))


def _fax(doc_id, embedding):
    """The signs of the vector's values, eight to a row, as a Group 4 image."""
    from quirelake.kernel.fax import encode_g4
    from quirelake.kernel.objects import Name, Stream
    from quirelake.kernel.writer import Builder

    rows = [[v < 0 for v in embedding[i : i + 8]] for i in range(0, len(embedding), 8)]
    b = Builder()
    parms = {"K": -1, "Columns": 8, "Rows": len(rows)}
    image = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 8, "Height": len(rows), "BitsPerComponent": 1, "ColorSpace": Name("DeviceGray"), "Filter": Name("CCITTFaxDecode"), "DecodeParms": parms}
    b.page(b"q 8 0 0 8 1 1 cm /Im1 Do Q", resources={"XObject": {"Im1": b.add(Stream(image, encode_g4(rows, 8)))}})
    return b.build()


@query("""SELECT vec_id AS doc_id, 8 AS width, len(embedding)::INT // 8 AS height, md5(array_to_string(list_transform(embedding, lambda v: CASE WHEN v < 0 THEN '000000' ELSE 'FFFFFF' END), '')) AS pixels_md5 FROM embeddings""")
def pdf_fax(spark, d):
    """Bilevel images: black is 0."""
    files = generated.made(read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), _fax, "embedding")
    return pdf.relation(files, "images", pixels=True).select("doc_id", "width", "height", F.md5(F.hex("pixels")).alias("pixels_md5"))


def _owned(doc_id, text):
    scheme = ("rc4-40", "rc4-128", "aes-128", "aes-256-r5")[int(doc_id) % 4]
    return generated.one_page(int(doc_id), text, ["FlateDecode"], bool(int(doc_id) % 2), (scheme, "user", f"o{int(doc_id)}"))


@query(ROUND_TRIP)
def pdf_owner_password(spark, d):
    """Four ciphers, opened by the owner, packed objects among them."""
    files = generated.made(read(spark, d, "documents"), _owned, "text")
    return _read_back(files.withColumn("password", F.concat(F.lit("o"), F.col("doc_id").cast("string"))))


def _newest_cipher(doc_id, name):
    return generated.one_page(int(doc_id), name, ["FlateDecode"], bool(int(doc_id) % 2), ("aes-256", f"u{int(doc_id)}", f"o{int(doc_id)}"))


@query("SELECT r_regionkey::BIGINT AS doc_id, 1::BIGINT AS n_lines, md5(r_name) AS text_md5 FROM region")
def pdf_newest_cipher(spark, d):
    """Revision 6, opened by the user or the owner. Its key costs some hundred rounds of hashing and AES in Python for each file."""
    rows = read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), "r_name")
    files = generated.made(rows, _newest_cipher, "r_name")
    who = F.when(F.col("doc_id") % 3 == 0, F.lit("o")).otherwise(F.lit("u"))
    return _read_back(files.withColumn("password", F.concat(who, F.col("doc_id").cast("string"))))


def _palette(doc_id, embedding):
    """An indexed image of 4 bits over a CMYK palette of 16 colours."""
    from quirelake.kernel.objects import Name, Str, Stream
    from quirelake.kernel.writer import Builder

    each = [min(15, int(abs(v) * 15)) for v in embedding]
    each = each[: len(each) // 2 * 2]
    raw = bytes(a << 4 | b for a, b in zip(each[::2], each[1::2], strict=True))
    b = Builder()
    space = [Name("Indexed"), Name("DeviceCMYK"), 15, Str(bytes(x for k in range(16) for x in (0, 255, 17 * k, 0)))]
    image = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 2, "Height": len(raw), "BitsPerComponent": 4, "ColorSpace": space}
    b.page(b"/Im1 Do", resources={"XObject": {"Im1": b.add(Stream(image, raw))}})
    return b.build()


@query("""SELECT vec_id AS doc_id, 2 AS width, len(embedding)::INT // 2 AS height, 4 AS bpc, 'Indexed' AS color_space,
md5(array_to_string(list_transform(embedding, lambda v: 'FF00' || printf('%02X', 255 - 17 * least(15, trunc(abs(v::DOUBLE) * 15)::INT))), '')) AS pixels_md5 FROM embeddings""")
def pdf_palettes(spark, d):
    """Indexed colours over CMYK, at 4 bits a pixel."""
    files = generated.made(read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), _palette, "embedding")
    return pdf.relation(files, "images", pixels=True).select("doc_id", "width", "height", "bpc", "color_space", F.md5(F.hex("pixels")).alias("pixels_md5"))


def _inline(doc_id, embedding):
    """An inline image of the vector's bytes (with an end mark among them), then a text."""
    raw = bytes(min(255, int(abs(v) * 255)) for v in embedding)[:-3] + b" EI"
    return _pages([b"q BI /W 1 /H %d /BPC 8 /CS /G ID " % len(raw) + raw + b" EI Q BT /F1 10 Tf (after) Tj ET"])


@query("SELECT vec_id AS doc_id, n, op, op = 'BI' AS image FROM embeddings, (VALUES ('q', 1), ('BI', 1), ('Q', 1), ('BT', 1), ('Tf', 1), ('Tj', 1), ('ET', 1)) v(op, n)")
def pdf_inline_images(spark, d):
    files = generated.made(read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), _inline, "embedding")
    i = pdf.relation(files, "instructions").groupBy("doc_id", "op").agg(F.count("*").cast("int").alias("n"), F.bool_or(F.coalesce(F.get("operands", F.lit(0))["kind"] == "stream", F.lit(False))).alias("image"))
    return i.select("doc_id", "n", "op", "image")


@query("""WITH t AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS p, replace(text, chr(10), ' ') AS text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT doc_id, (len(text) - len(replace(text, 'the', ''))) // 3 AS replaced, md5(replace(text, 'the', 'THE')) AS block_md5, 'ho' AS note, true AS deleted, -32602 AS missing, true AS shown FROM t WHERE p = 0 AND text <> ''""")
def pdf_endpoint_writes(spark, d):
    """Three requests to each file in one pass, then five about the object that they made, each seeing what those before it wrote."""
    turns = read(spark, d, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    got = lambda k, path: F.get_json_object(F.get("responses", F.lit(k)), path)
    first = [request("pdf/updateText", pageIndex=0, oldText="the", newText="THE"), request("pdf/getTextBlocks", pageIndex=0), request("pdf/addAnnotation", pageIndex=0, type="Text", x=1, y=2, x2=3, y2=4, content="hi")]
    made = written(endpoint.sessions(generated.turns_as_files(turns), first), "sessions")
    about = made.select("doc_id", "content", got(0, "$.result.replaced").cast("long").alias("replaced"), got(1, "$.result.blocks[0].text").alias("block"), got(2, "$.result.objectKey").alias("key")).where("block IS NOT NULL")
    keyed = lambda m, **p: F.replace(F.lit(request(m, objectKey="KEY", **p)), F.lit("KEY"), F.col("key"))
    then = [keyed("pdf/updateObject", value={"Contents": "ho"}), keyed("pdf/getObject"), keyed("pdf/deleteObject"), keyed("pdf/getObject"), F.lit(request("pdf/getPageContent", pageIndex=0))]
    done = endpoint.sessions(about, F.array(*then)).select(
        "doc_id", got(1, "$.result.object.Contents").alias("note"), (got(2, "$.result.known") == "true").alias("deleted"), got(3, "$.error.code").cast("int").alias("missing"), got(4, "$.result.content").contains("Tj").alias("shown"),
    )
    return about.select("doc_id", "replaced", F.md5("block").alias("block_md5")).join(done, "doc_id")


_PS = {
    "add": "q + d", "sub": "q - d", "mul": "q * d", "div": "CASE WHEN d = 0 THEN 0 ELSE q / d END", "idiv": "trunc(q / n)", "mod": "fmod(q, n)", "neg": "-q", "abs": "abs(d - 0.05)", "ceiling": "ceil(q * d)", "floor": "floor(q * d)", "round": "floor(q * d + 0.5)", "truncate": "trunc((d - 0.05) * 30)",
    "sqrt": "sqrt(q)", "sin": "sin(radians(q))", "cos": "cos(radians(q))", "atan": "CASE WHEN atan2(d - 0.05, q - 25) < 0 THEN degrees(atan2(d - 0.05, q - 25)) + 360 ELSE degrees(atan2(d - 0.05, q - 25)) END", "exp": "pow(q, d)", "ln": "ln(q)", "log": "log10(q)",
    "eq": "CASE WHEN n = 3 THEN 1 ELSE 0 END", "ne": "CASE WHEN n <> 3 THEN 1 ELSE 0 END", "gt": "CASE WHEN n > 3 THEN 1 ELSE 0 END", "ge": "CASE WHEN n >= 3 THEN 1 ELSE 0 END", "lt": "CASE WHEN n < 3 THEN 1 ELSE 0 END", "le": "CASE WHEN n <= 3 THEN 1 ELSE 0 END",
    "and": "q::BIGINT & 6", "or": "q::BIGINT | 6", "xor": "xor(q::BIGINT, 6)", "not": "CASE WHEN n > 3 THEN 0 ELSE 1 END", "bitshift_left": "q::BIGINT * 8", "bitshift_right": "q::BIGINT // 4", "true": "1", "false": "0",
    "pop": "q", "exch": "d - q", "dup": "q * q", "copy": "q + d + q * d", "index": "q + d + q", "roll": "(q - d) * n", "if": "CASE WHEN n > 3 THEN -q ELSE q END", "ifelse": "CASE WHEN n > 3 THEN q ELSE d END",
}
_PS_PROGRAMS = {
    "add": "pop add", "sub": "pop sub", "mul": "pop mul", "div": "pop div", "idiv": "exch pop idiv", "mod": "exch pop mod", "neg": "pop pop neg", "abs": "pop exch pop 0.05 sub abs", "ceiling": "pop mul ceiling", "floor": "pop mul floor", "round": "pop mul round", "truncate": "pop exch pop 0.05 sub 30 mul truncate",
    "sqrt": "pop pop sqrt", "sin": "pop pop sin", "cos": "pop pop cos", "atan": "pop 0.05 sub exch 25 sub atan", "exp": "pop exp", "ln": "pop pop ln", "log": "pop pop log",
    "eq": "3 eq", "ne": "3 ne", "gt": "3 gt", "ge": "3 ge", "lt": "3 lt", "le": "3 le", "and": "pop pop 6 and", "or": "pop pop 6 or", "xor": "pop pop 6 xor", "not": "3 gt not", "bitshift_left": "pop pop 3 bitshift", "bitshift_right": "pop pop -2 bitshift", "true": "true", "false": "false",
    "pop": "pop pop", "exch": "pop exch sub", "dup": "pop pop dup mul", "copy": "pop 2 copy mul add add", "index": "pop 1 index add add", "roll": "3 1 roll sub mul", "if": "3 gt { pop neg } { pop } ifelse", "ifelse": "3 gt { pop } { exch pop } ifelse",
}


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(f'round(({sql})::DOUBLE, 6) AS op_{op}' for op, sql in _PS.items())} FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_linenumber AS n FROM lineitem)")
def ps_operators(spark, d):
    """Every operator of the calculator, on quantity, discount and number of each line."""
    inputs = [F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_linenumber")]
    value = lambda op: F.round(numeric.program("{ " + _PS_PROGRAMS[op] + " }", *inputs)[-1], 6) + 0.0
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(value(op).alias(f"op_{op}") for op in _PS))


def _calculator(doc_id, items):
    """The same programs, run by the kernel as functions of a file."""
    from quirelake.kernel.calculator import evaluate
    from quirelake.kernel.document import parse
    from quirelake.kernel.objects import Stream
    from quirelake.kernel.writer import Builder

    b = Builder()
    b.page(b"")
    refs = {op: b.add(Stream({"FunctionType": 4, "Domain": [-1000, 1000] * 3, "Range": [-(10**9), 10**9]}, ("{ " + p + " }").encode())) for op, p in _PS_PROGRAMS.items() if op in ("add", "idiv", "atan", "roll", "copy", "index", "ifelse", "exp")}
    doc = parse(b.build())
    rows = [[round(evaluate(doc, ref, [float(i["l_quantity"]), float(i["l_discount"]), float(i["l_linenumber"])])[0], 6) for ref in refs.values()] for i in items]
    return json.dumps(rows).encode()


@query(f"SELECT doc_id, k::INT AS k, round(q + d, 6) AS op_add, round({_PS['atan']}, 6) AS op_atan, round((q - d) * n, 6) AS op_roll, round({_PS['ifelse']}, 6) AS op_ifelse FROM {LINE_ROWS}")
def pdf_functions(spark, d):
    """Calculator functions of a file, evaluated where the file is."""
    made = _of_lines(spark, d, _calculator)
    rows = F.from_json(F.col("content").cast("string"), "array<array<double>>")
    at = {"add": 0, "atan": 2, "roll": 6, "ifelse": 7}
    names = [op for op in _PS_PROGRAMS if op in ("add", "idiv", "atan", "roll", "copy", "index", "ifelse", "exp")]
    each = made.select("doc_id", F.posexplode(rows).alias("k", "v"))
    return each.select("doc_id", "k", *(F.get("v", F.lit(names.index(op))).alias(f"op_{op}") for op in at))


@query(ROUND_TRIP)
def pdf_folder(spark, d):
    """Files written to a folder by the sink, and read from there."""
    folder = _in_folder(spark, generated.documents_as_files(read(spark, d, "documents"), "flate"))
    found = pdf.read_files(spark, folder).withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long"))
    return _read_back(found)


@query("SELECT user_id AS file, ts AS opened, rank::INT AS rank FROM (SELECT user_id, max(ts) AS ts, row_number() OVER (ORDER BY max(ts) DESC, user_id) AS rank FROM events GROUP BY 1) WHERE rank <= 20")
def recent_files(spark, d):
    """The files opened last, each once: a list of twenty is what is kept."""
    return store.recent(read(spark, d, "events").select(F.col("user_id").alias("file"), F.col("ts").alias("opened")))


EDITED = """WITH t AS (SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS page_index, replace(text, chr(10), ' ') AS text FROM conversations)"""


def _edit_rows(turns: DataFrame, *rows: dict) -> DataFrame:
    ids = turns.select(F.col("conv_id").alias("doc_id")).distinct()
    made = [[F.lit(k).cast("long").alias("edit_id"), "doc_id", *(F.lit(row.get(c)).cast(t).alias(c) if c != "numbers" else F.array(*map(F.lit, row.get(c, []))).cast(t).alias(c) for c, t in edits.COLUMNS.items() if c not in ("edit_id", "color", "image")), F.lit(row.get("image")).cast("binary").alias("image")] for k, row in enumerate(rows)]
    out = ids.select(*made[0])
    for m in made[1:]:
        out = out.unionByName(ids.select(*m))
    return out


@query(f"""{EDITED} SELECT doc_id, page_index, string_agg(s, chr(10) ORDER BY j) AS texts FROM t, LATERAL (VALUES (0, CASE WHEN page_index = 0 THEN 'first' END), (1, CASE WHEN text = '' THEN NULL WHEN page_index = 0 THEN CASE WHEN contains(text, 'e') THEN text[1:instr(text, 'e') - 1] || 'E' || text[instr(text, 'e') + 1:] ELSE text END ELSE text END), (2, CASE WHEN page_index = 0 THEN 'last' END)) v(j, s) WHERE s IS NOT NULL AND page_index <> 1 GROUP BY ALL""")
def pdf_edit_instructions(spark, d):
    """Instructions put in, taken out and replaced, and only the first match replaced."""
    turns = read(spark, d, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    wanted = _edit_rows(
        turns, {"page_index": 0, "kind": "replace_first", "search": "e", "replacement": "E"},
        {"page_index": 0, "kind": "insert_instructions", "search": "start", "replacement": "BT /F1 9 Tf 1 1 Td (frist) Tj ET"}, {"page_index": 0, "kind": "replace_instructions", "numbers": [3.0, 1.0], "replacement": "(first) Tj"},
        {"page_index": 0, "kind": "insert_instructions", "search": "end", "replacement": "BT /F1 9 Tf (last) Tj ET BT (gone) Tj ET"}, {"page_index": 0, "kind": "decompress"}, {"page_index": 1, "kind": "remove_instructions", "numbers": [0.0, 100.0]}, {"page_index": 2, "kind": "compress"},
    )
    done = edits.apply_edits(generated.turns_as_files(turns), wanted)
    e = _texts(done).where("text <> 'gone'")
    item = F.array_sort(F.collect_list(F.struct("elem_idx", "text")))
    return e.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(item, lambda x: x["text"]), "\n").alias("texts"))


@query(f"""{EDITED} SELECT doc_id, page_index, name, width, height, x::DOUBLE AS x, y::DOUBLE AS y, hex FROM t, (VALUES ('Im1', 2, 1, 10.0, 20.0, '0A0A0AFAFAFA'), ('Im2', 1, 1, 0.0, 0.0, '010203')) v(name, width, height, x, y, hex) WHERE page_index = 0""")
def pdf_edit_images(spark, d):
    """Images added, replaced and deleted, with a text modified beside them."""
    turns = read(spark, d, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    add = {"page_index": 0, "kind": "add_image"}
    wanted = _edit_rows(
        turns, add | {"image": bytearray([10, 20]), "width": 2, "height": 1, "numbers": [10.0, 20.0, 5.0, 5.0]}, add | {"image": bytearray([1, 2, 3]), "width": 1, "height": 1, "numbers": [0.0, 0.0, 1.0, 1.0]},
        {"page_index": 0, "kind": "replace_image", "search": "Im1", "image": bytearray([10, 250]), "width": 2, "height": 1}, {"page_index": 0, "kind": "replace_in_object", "index": 0, "replacement": "new"},
        # A third image comes and goes.
        add | {"image": bytearray([9]), "width": 1, "height": 1, "numbers": [3.0, 3.0, 1.0, 1.0]}, {"page_index": 0, "kind": "delete_image", "search": "Im3"},
    )
    i = pdf.relation(edits.apply_edits(generated.turns_as_files(turns), wanted), "images", pixels=True)
    real = lambda c: F.col(f"position.{c}").cast("double").alias(c)
    # An image that is deleted is drawn nowhere.
    return i.where("position IS NOT NULL").select("doc_id", "page_index", "name", "width", "height", real("x"), real("y"), F.hex("pixels").alias("hex"))


@query("""SELECT p_partkey, p_size % 3 = 0 AS math, p_size % 5 = 0 AS identity, p_size % 7 = 0 AS predefined, p_size % 2 = 0 AS cjk, round((p_size + p_retailprice) / 2, 4) AS mean0, round(abs(p_retailprice - p_size), 4) AS width, CASE WHEN p_size < 26 THEN 'CMR' ELSE 'CMEX' END AS maths, p_size < 20 AS is_identity, p_size < 30 AS is_predefined, p_size < 40 AS is_cjk, p_size < 10 AS is_private FROM part""")
def font_predicates(spark, d):
    """Predicates on names of fonts and maps and on characters, means and measures."""
    p, size = read(spark, d, "part"), F.col("p_size")
    pick_if = lambda case, yes, no: F.when(case, F.lit(yes)).otherwise(F.lit(no))
    pick = lambda limit, yes, no: pick_if(size < limit, yes, no)
    box = geometry.rect(size.cast("double"), F.lit(0.0), F.col("p_retailprice"), F.lit(1.0))
    a, b = (F.array(c.cast("double"), F.lit(0.0), F.lit(0.0)) for c in (size, F.col("p_retailprice")))
    return p.select(
        "p_partkey", codecs.math_encoding(F.concat(pick_if(size % 3 == 0, "CMSY", "CSMY"), size.cast("string"))).isNotNull().alias("math"), codecs.identity_map(F.concat(F.lit("Identity-"), pick_if(size % 5 == 0, "H", "h"))).alias("identity"),
        codecs.predefined_map(F.concat(F.lit("UniJIS-UCS2-"), pick_if(size % 7 == 0, "V", "W"))).alias("predefined"), codecs.cjk_font(F.concat(F.lit("ABCDEF+MS "), pick_if(size % 2 == 0, "Gothic", "Gothik"))).alias("cjk"),
        F.round(F.get(geometry.mean_color(a, b), F.lit(0)), 4).alias("mean0"), F.round(geometry.width(box), 4).alias("width"), codecs.math_encoding(pick(26, "ABCDEF+CMR10", "cmex10")).alias("maths"), codecs.identity_map(pick(20, "Identity-V", "UniGB-UCS2-H")).alias("is_identity"),
        codecs.predefined_map(pick(30, "90ms-RKSJ-H", "Own-H")).alias("is_predefined"), codecs.cjk_font(pick(40, "MS-Mincho", "Helvetica")).alias("is_cjk"), codecs.has_private_use(pick(10, "a", "a")).alias("is_private"),
    )


def _fax_rows(doc_id, embedding):
    """The signs of the vector's values as rows of runs (K 0), or of runs behind end-of-line codes (K 4)."""
    from quirelake.kernel.fax import END_OF_LINE, run_codes
    from quirelake.kernel.objects import Name, Stream
    from quirelake.kernel.writer import Builder

    codes = [{n: format(v, f"0{w}b") for (w, v), n in run_codes(black).items()} for black in (False, True)]
    rows, mixed = [[v < 0 for v in embedding[i : i + 8]] for i in range(0, len(embedding), 8)], int(doc_id) % 2
    text = ""
    for row in rows:
        text += (END_OF_LINE + "1") * mixed
        at = black = 0
        while at < 8:
            n = next((i for i in range(at, 8) if row[i] != black), 8) - at
            text += codes[black][n]
            at, black = at + n, 1 - black
    text += "0" * (-len(text) % 8)
    b = Builder()
    image = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 8, "Height": len(rows), "BitsPerComponent": 1, "ColorSpace": Name("DeviceGray"), "Filter": Name("CCITTFaxDecode"), "DecodeParms": {"K": 4 * mixed, "Columns": 8, "Rows": len(rows), "EndOfLine": bool(mixed), "EndOfBlock": False}}
    b.page(b"/Im1 Do", resources={"XObject": {"Im1": b.add(Stream(image, int(text, 2).to_bytes(len(text) // 8, "big")))}})
    return b.build()


@query(ORACLE_SQL["pdf_fax"])
def pdf_fax_rows(spark, d):
    """The same pictures in one dimension, with and without end-of-line codes."""
    files = generated.made(read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), _fax_rows, "embedding")
    return pdf.relation(files, "images", pixels=True).select("doc_id", "width", "height", F.md5(F.hex("pixels")).alias("pixels_md5"))


@query("SELECT conv_id AS doc_id, page_index, md5(replace(text, chr(10), ' ')) AS text_md5 FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS page_index FROM conversations) WHERE page_index IN (0, 2) AND replace(text, chr(10), '') <> ''")
def pdf_some_pages(spark, d):
    """Pages by their index: the kernel decodes no others."""
    turns = read(spark, d, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    e = _texts(generated.turns_as_files(turns), pages={0, 2})
    return e.groupBy("doc_id", "page_index").agg(F.md5(F.first("text")).alias("text_md5"))


@query("SELECT doc_id, v.op, v.n::BIGINT AS n FROM (SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '')) AS shown, len(string_split(coalesce(text, ''), chr(10))) - 1 AS moves FROM documents), LATERAL (VALUES ('BT', 1), ('Tf', 1), ('TL', 1), ('Td', 1), ('ET', 1), ('Tj', shown), ('T*', moves)) v(op, n) WHERE v.n > 0")
def pdf_instruction_udtf(spark, d):
    endpoint.register(spark)
    files = generated.documents_as_files(read(spark, d, "documents"))
    rows = spark.sql("SELECT f.doc_id, t.op FROM {files} f, LATERAL pdf_instructions(f.content) t", files=files)
    return rows.groupBy("doc_id", "op").agg(F.count("*").alias("n"))


def _in_folder(spark, files: DataFrame) -> str:
    """The folder that files (doc_id, content) were written to, each named by its doc_id."""
    import uuid

    datasource.register(spark)
    folder = f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    files.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), "content").write.format("pdf").mode("append").save(folder)
    return folder


@query(ROUND_TRIP.replace("FROM documents", "FROM (SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY 1)"))
def stream_texts(spark, d):
    """Files that come into a folder, read as a stream and gathered by file."""
    folder = _in_folder(spark, generated.turns_as_files(read(spark, d, "conversations")))
    rows = streaming.stream_relation(streaming.stream_files(spark, folder, 10_000).withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long")), "text_elements")
    q = rows.select("doc_id", "page_index", "elem_idx", "text").writeStream.format("parquet").option("path", f"{folder}-texts").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    e = spark.read.parquet(f"{folder}-texts")
    item = F.array_sort(F.collect_list(F.struct("page_index", "elem_idx", "text")))
    return e.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.md5(F.array_join(F.transform(item, lambda x: x["text"]), "\n")).alias("text_md5"))


@query("SELECT count(*) AS pages, count(DISTINCT conv_id) AS files FROM conversations")
def pdf_data_source(spark, d):
    """format("pdf") over a folder."""
    folder = _in_folder(spark, generated.turns_as_files(read(spark, d, "conversations")))
    pages = spark.read.format("pdf").option("relation", "pdf_pages").load(folder.removeprefix("file://").removeprefix("file:"))
    return pages.agg(F.count("*").alias("pages"), F.countDistinct("doc_id").alias("files"))


@query("SELECT p AS page_index, count(*) AS pages FROM (SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations) WHERE p IN (1, 3) GROUP BY 1")
def pdf_picked_pages(spark, d):
    """Two pages of each file of a folder: the reader decodes no others."""
    folder = _in_folder(spark, generated.turns_as_files(read(spark, d, "conversations")))
    pages = datasource.picked(spark, folder.removeprefix("file://").removeprefix("file:"), "pdf_pages", page_index=[1, 3])
    return pages.groupBy(F.col("page_index").cast("long").alias("page_index")).agg(F.count("*").alias("pages"))


@query("""WITH t AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS p, replace(text, chr(10), ' ') AS text FROM conversations)
SELECT doc_id, sum(CASE p WHEN 0 THEN (len(text) - len(replace(lower(text), 'an', ''))) // 2 WHEN 1 THEN CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END ELSE 0 END)::INT + 3 AS changes FROM t GROUP BY 1""")
def pdf_edit_counts(spark, d):
    """How much edits changed: matches of any case, strings deleted, shapes drawn."""
    turns = read(spark, d, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    shape = {"page_index": 0, "numbers": [1.0, 2.0, 3.0, 4.0]}
    wanted = _edit_rows(turns, {"page_index": 0, "kind": "replace", "search": "an", "replacement": "-", "ignore_case": True}, {"page_index": 1, "kind": "delete", "search": "the"}, *(shape | {"kind": k} for k in ("rectangle", "line", "ellipse")), {"page_index": 999, "kind": "optimize"})
    return edits.apply_edits(generated.turns_as_files(turns), wanted).select("doc_id", "changes")


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents), p AS (SELECT *, list_position(l, l[-1]) AS k FROM l WHERE len(l) > 0)
SELECT doc_id, len(l)::BIGINT AS n_lines, md5(array_to_string(list_concat(list_concat(l[:k - 1], ['new']), l[k + 1:]), chr(10))) AS text_md5 FROM p""")
def pdf_edit_modify(spark, d):
    """The first string with this text in this font: the first line that equals the last one."""
    docs = read(spark, d, "documents")
    files = generated.documents_as_files(docs)
    last = F.element_at(F.filter(F.split("text", "\n"), lambda x: x != ""), -1)
    wanted = docs.where(F.regexp_replace("text", "\n", "") != "").select(F.lit(1).cast("long").alias("edit_id"), "doc_id", F.lit(0).alias("page_index"), F.lit("modify").alias("kind"), last.alias("search"), F.lit("new").alias("replacement"), F.lit("F1").alias("font_name"))
    e = _texts(edits.apply_edits(files, wanted)).where("text <> ''")
    item = F.array_sort(F.collect_list(F.struct("elem_idx", "text")))
    return e.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.md5(F.array_join(F.transform(item, lambda x: x["text"]), "\n")).alias("text_md5"))


def _numeric_functions(doc_id, items):
    """Sampled, exponential and stitched functions of a file at each item's discount and tax."""
    from quirelake.kernel.calculator import evaluate
    from quirelake.kernel.document import parse
    from quirelake.kernel.objects import Stream
    from quirelake.kernel.writer import Builder

    b = Builder()
    b.page(b"")
    grid = b.add(Stream({"FunctionType": 0, "Domain": [0, 1, 0, 1], "Range": [0, 255], "Size": [2, 2], "BitsPerSample": 8}, bytes([0, 100, 200, 255])))
    power = b.add({"FunctionType": 2, "Domain": [0, 1], "C0": [0.1], "C1": [0.9], "N": 2})
    line = b.add({"FunctionType": 2, "Domain": [0, 1], "C0": [0], "C1": [1], "N": 1})
    both = b.add({"FunctionType": 3, "Domain": [0, 1], "Functions": [power, line], "Bounds": [0.05], "Encode": [0, 1, 1, 0]})
    doc = parse(b.build())
    rows = [[evaluate(doc, grid, [10 * float(i["l_discount"]), 10 * float(i["l_tax"])])[0], evaluate(doc, power, [float(i["l_discount"])])[0], evaluate(doc, both, [float(i["l_discount"])])[0]] for i in items]
    return json.dumps([[round(v, 6) for v in row] for row in rows]).encode()


@query(f"""SELECT doc_id, k::INT AS k, round(100 * x * (1 - y) + 200 * (1 - x) * y + 255 * x * y, 6) AS sampled, round(0.1 + 0.8 * d * d, 6) AS exponential, round(CASE WHEN d < 0.05 THEN 0.1 + 0.8 * pow(d / 0.05, 2) ELSE 1 - (d - 0.05) / 0.95 END, 6) AS stitched FROM (SELECT *, least(1, d * 10) AS x, least(1, t * 10) AS y FROM {LINE_ROWS})""")
def pdf_numeric_functions(spark, d):
    made = _of_lines(spark, d, _numeric_functions)
    each = made.select("doc_id", F.posexplode(F.from_json(F.col("content").cast("string"), "array<array<double>>")).alias("k", "v"))
    return each.select("doc_id", "k", *(F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("sampled", "exponential", "stitched"))))


def _encoded(doc_id, text):
    """The text in a font of one of three encodings, by doc_id; what an encoding has not is a question mark."""
    from quirelake.kernel.content import Instruction, serialize
    from quirelake.kernel.objects import Name, Str
    from quirelake.kernel.writer import Builder

    b, n = Builder(), int(doc_id) % 2
    font = b.add({"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name("Own"), "Encoding": Name(("WinAnsiEncoding", "MacRomanEncoding")[n])})
    lines = [x for x in (text or "").split("\n") if x]
    shown = [Instruction("Tj", [Str(x.encode(("cp1252", "mac_roman")[n], "replace"))]) for x in lines]
    b.page(serialize([Instruction("BT"), Instruction("Tf", [Name("F1"), 10]), *shown, Instruction("ET")]), ["FlateDecode"], resources={"Font": {"F1": font}})
    return b.build()


@query(ROUND_TRIP)
def pdf_encodings(spark, d):
    return _read_back(generated.made(read(spark, d, "documents"), _encoded, "text"))


@query("SELECT doc_id, n_lines, text_md5, 10.0::DOUBLE AS font_size FROM (" + ROUND_TRIP + ")")
def pdf_operands(spark, d):
    """Typed operands of filtered instructions: strings shown, and the size that is set."""
    i = pdf.relation(generated.documents_as_files(read(spark, d, "documents")), "instructions").where(F.col("op").isin("Tj", "Tf"))
    shown = F.when(F.col("op") == "Tj", F.get("operands", F.lit(0))["str"])
    size = F.when(F.col("op") == "Tf", F.get("operands", F.lit(1))["num"])
    rows = i.select("doc_id", "page_index", "instr_idx", shown.alias("text"), size.alias("size"))
    item = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page_index", "instr_idx", "text"))))
    out = rows.groupBy("doc_id").agg(F.count("text").alias("n_lines"), F.md5(F.array_join(F.transform(item, lambda x: x["text"]), "\n")).alias("text_md5"), F.max("size").alias("font_size"))
    return out.where("n_lines > 0")


@query("SELECT doc_id, 1 AS obj, 'dictionary' AS kind, 'Catalog' AS type, 'Info' AS what, 'Document ' || doc_id AS title FROM documents")
def pdf_object_lookup(spark, d):
    """An object by its number, and one by what it holds."""
    o = pdf.relation(generated.documents_as_files(read(spark, d, "documents")), "objects", raw=False)
    title = F.get_json_object("value_json", "$.Title")
    info = o.where(title.isNotNull()).select("doc_id", F.lit("Info").alias("what"), title.alias("title"))
    return o.where("obj = 1").select("doc_id", "obj", "kind", "type").join(info, "doc_id")


def _bilevel(doc_id, embedding):
    """The signs of the vector's values as a JBIG2 page with one generic region in modified modified READ code."""
    from quirelake.kernel.fax import encode_g4
    from quirelake.kernel.objects import Name, Stream
    from quirelake.kernel.writer import Builder

    rows = [[v < 0 for v in embedding[i : i + 8]] for i in range(0, len(embedding), 8)]
    four = lambda *n: b"".join(int(x).to_bytes(4, "big") for x in n)
    segment = lambda number, kind, data: four(number) + bytes([kind, 0, 1]) + four(len(data)) + data
    page = segment(0, 48, four(8, len(rows), 0, 0) + bytes(3))
    region = segment(1, 38, four(8, len(rows), 0, 0) + bytes([0, 1]) + encode_g4(rows, 8))
    b = Builder()
    image = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 8, "Height": len(rows), "BitsPerComponent": 1, "ColorSpace": Name("DeviceGray"), "Filter": Name("JBIG2Decode")}
    b.page(b"/Im1 Do", resources={"XObject": {"Im1": b.add(Stream(image, page + region))}})
    return b.build()


@query(ORACLE_SQL["pdf_fax"])
def pdf_bilevel(spark, d):
    """Pages of generic regions."""
    files = generated.made(read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), _bilevel, "embedding")
    return pdf.relation(files, "images", pixels=True).select("doc_id", "width", "height", F.md5(F.hex("pixels")).alias("pixels_md5"))


def _many_streams(doc_id, items):
    from quirelake.kernel.writer import Builder

    b = Builder()
    b.page([f"{int(i['l_linenumber'])} {float(i['l_quantity']):g} m".encode() for i in items], ["FlateDecode"])
    return b.build(packed=bool(int(doc_id) % 2))


@query(f"SELECT doc_id, 0 AS page_index, k::INT AS stream_idx, n || ' ' || q::INT || ' m' AS content FROM {LINE_ROWS}")
def pdf_page_streams(spark, d):
    """A page's content streams in order."""
    s = pdf.relation(_of_lines(spark, d, _many_streams), "page_streams", columns=["doc_id", "page_index", "stream_idx", "content"])
    return s.select("doc_id", "page_index", "stream_idx", F.col("content").cast("string").alias("content"))
