"""Queries over files generated from the driver's tables: bytes are written, read back, and compared with SQL over the rows they came from."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import search
from quirelake.operators.tables import written
from quirelake.plans.relational import read
from quirelake.sources import edits, endpoint, generated, pdf

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Lines of a text that a file shows: empty ones are no string.
LINES = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _texts(files: DataFrame, **options) -> DataFrame:
    return pdf.relation(files, "text_elements", columns=["doc_id", "page_index", "elem_idx", "text"], **options)


def request(method: str, **params) -> str:
    return json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})


def _read_back(files: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, text_md5."""
    e = _texts(files, **options)
    item = F.array_sort(F.collect_list(F.struct("page_index", "elem_idx", "text")))
    return e.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.md5(F.array_join(F.transform(item, lambda x: x["text"]), "\n")).alias("text_md5"))


ROUND_TRIP = f"SELECT doc_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS text_md5 FROM (SELECT doc_id, {LINES} AS l FROM documents) WHERE len(l) > 0"


@query(f"SELECT doc_id, n FROM (SELECT doc_id, len(list_filter({LINES}, lambda x: contains(lower(x), 'the'))) AS n FROM documents) WHERE n > 0")
def pdf_find(spark, d):
    files = generated.documents_as_files(read(spark, d, "documents"))
    return search.find_text(_texts(files), "the", True).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(ROUND_TRIP)
def pdf_roundtrip_text(spark, d):
    return _read_back(generated.documents_as_files(read(spark, d, "documents")))


@query(ROUND_TRIP)
def pdf_filters(spark, d):
    return _read_back(generated.documents_as_files(read(spark, d, "documents"), "cycled"))


@query(ROUND_TRIP)
def pdf_packed(spark, d):
    return _read_back(generated.documents_as_files(read(spark, d, "documents"), "flate", packed=True))


@query(ROUND_TRIP)
def pdf_decrypt(spark, d):
    files = generated.documents_as_files(read(spark, d, "documents"), "flate", encryption=True)
    return _read_back(files.withColumn("password", F.concat(F.lit("u"), F.col("doc_id").cast("string"))))


@query("SELECT doc_id, 'password' AS error_class FROM documents")
def pdf_wrong_password(spark, d):
    files = generated.documents_as_files(read(spark, d, "documents"), encryption=True)
    return pdf.relation(files, "documents_meta", password="wrong").select("doc_id", "error_class")


@query("SELECT doc_id, '1.7' AS version, 'Document ' || doc_id AS title, 6 AS object_count, 1 AS declared_page_count, 1 AS actual_page_count, NULL::VARCHAR AS error FROM documents")
def pdf_meta(spark, d):
    m = pdf.relation(generated.documents_as_files(read(spark, d, "documents")), "documents_meta")
    return m.select("doc_id", "version", "title", "object_count", "declared_page_count", "actual_page_count", "error")


@query("SELECT conv_id AS doc_id, count(*)::INT AS declared_page_count, count(*)::INT AS actual_page_count FROM conversations GROUP BY 1")
def pdf_page_count(spark, d):
    files = generated.turns_as_files(read(spark, d, "conversations"))
    return pdf.relation(files, "documents_meta").select("doc_id", "declared_page_count", "actual_page_count")


@query("SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INT AS page_index, md5(replace(text, chr(10), ' ')) AS text_md5 FROM conversations WHERE replace(text, chr(10), '') <> ''")
def pdf_page_text(spark, d):
    files = generated.turns_as_files(read(spark, d, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" "))))
    return search.page_text(_texts(files)).select("doc_id", "page_index", F.md5("text").alias("text_md5"))


def _objects_by_type(spark, d) -> DataFrame:
    return pdf.relation(generated.turns_as_files(read(spark, d, "conversations")), "objects", raw=False)


@query("SELECT conv_id AS doc_id, count(*) AS pages, ceil(count(*) / 3)::BIGINT + 1 AS nodes, count(*) AS streams FROM conversations GROUP BY 1")
def pdf_object_kinds(spark, d):
    o = _objects_by_type(spark, d)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    content = (F.col("kind") == "stream") & F.col("type").isNull()
    return o.groupBy("doc_id").agg(n(F.col("type") == "Page").alias("pages"), n(F.col("type") == "Pages").alias("nodes"), n(content).alias("streams"))


@query("""WITH t AS (SELECT conv_id, string_split(coalesce(text, ''), chr(10)) AS l FROM conversations), c AS (SELECT conv_id, count(*) AS p, sum(len(l) - 1) AS moves, sum(len(list_filter(l, lambda x: x <> ''))) AS shown FROM t GROUP BY 1)
SELECT conv_id AS doc_id, v.op, v.category, v.n::BIGINT AS n FROM c, LATERAL (VALUES ('BT', 'text_object', p), ('ET', 'text_object', p), ('Tf', 'text_state', p), ('TL', 'text_state', p), ('Td', 'text_positioning', p), ('T*', 'text_positioning', moves), ('Tj', 'text_showing', shown)) v(op, category, n) WHERE v.n > 0""")
def pdf_instruction_counts(spark, d):
    i = pdf.relation(generated.turns_as_files(read(spark, d, "conversations")), "instructions")
    return i.groupBy("doc_id", "op", "category").agg(F.count("*").alias("n"))


@query("SELECT doc_id, '1.7' AS version, true AS same_start FROM documents")
def pdf_header(spark, d):
    files = written(generated.documents_as_files(read(spark, d, "documents")), "files")
    native = files.select("doc_id", pdf.header_version(F.col("content")).alias("version"), pdf.start_offset(F.col("content")).alias("start"))
    parsed = pdf.relation(files, "documents_meta").select("doc_id", "start_xref")
    return native.join(parsed, "doc_id").select("doc_id", "version", (F.col("start") == F.col("start_xref")).alias("same_start"))


def _categories(turns: DataFrame) -> DataFrame:
    """category, n: operators of the turns' files."""
    i = pdf.relation(generated.turns_as_files(turns), "instructions").select("op")
    dim = pdf.operator_dim(turns.sparkSession)
    return i.join(F.broadcast(dim), "op").where("operand_count IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT string_split(coalesce(text, ''), chr(10)) AS l FROM conversations), c AS (SELECT count(*) AS p, sum(len(l) - 1) AS moves, sum(len(list_filter(l, lambda x: x <> ''))) AS shown FROM t)
SELECT v.op, v.category, v.n::BIGINT AS n FROM c, LATERAL (VALUES ('BT', 'text_object', p), ('ET', 'text_object', p), ('Td', 'text_positioning', p), ('T*', 'text_positioning', moves), ('Tf', 'text_state', p), ('TL', 'text_state', p), ('Tj', 'text_showing', shown)) v(op, category, n) WHERE v.n > 0""")
def pdf_operator_categories(spark, d):
    """By operator; pdf_operator_categories_text has the sums of categories."""
    i = pdf.relation(generated.turns_as_files(read(spark, d, "conversations")), "instructions").select("op")
    return i.groupBy("op").count().join(F.broadcast(pdf.operator_dim(spark)), "op").select("op", "category", F.col("count").alias("n"))


@query("""WITH t AS (SELECT string_split(coalesce(text, ''), chr(10)) AS l FROM conversations), c AS (SELECT count(*) AS p, sum(len(l) - 1) AS moves, sum(len(list_filter(l, lambda x: x <> ''))) AS shown FROM t)
SELECT v.category, v.n::BIGINT AS n FROM c, LATERAL (VALUES ('text_object', 2 * p), ('text_positioning', p + moves), ('text_state', 2 * p), ('text_showing', shown)) v(category, n) WHERE v.n > 0""")
def pdf_operator_categories_text(spark, d):
    return _categories(read(spark, d, "conversations"))


def _inherit(doc_id, items):
    from quirelake.kernel.writer import Builder

    b, branches = Builder(), {}
    for item in items:
        nation, key = int(item["c_nationkey"]), int(item["c_custkey"])
        if nation not in branches:
            more = {"Rotate": 90} if nation % 2 else {}
            branches[nation] = b.branch(MediaBox=[0, 0, 100 + nation, 200 + nation], **more)
        b.page(b"", box=[0, 0, 10, 20] if key % 4 == 0 else None, parent=branches[nation], **({"Rotate": 180} if key % 5 == 0 else {}))
    return b.build()


@query("SELECT c_nationkey::BIGINT AS doc_id, count(*) AS n, sum(CASE WHEN c_custkey % 4 = 0 THEN 10 ELSE 100 + c_nationkey END)::DOUBLE AS width, sum(CASE WHEN c_custkey % 5 = 0 THEN 180 WHEN c_nationkey % 2 = 1 THEN 90 ELSE 0 END)::BIGINT AS rotation FROM customer GROUP BY 1")
def pdf_inherit(spark, d):
    rows = read(spark, d, "customer").withColumn("doc", F.col("c_nationkey").cast("long"))
    files = generated.made(generated.gathered(rows, "doc", ["c_custkey", "c_nationkey"]), _inherit, "items")
    p = pdf.relation(files, "pdf_pages")
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("media_box.urx").cast("double")).alias("width"), F.sum("rotation").alias("rotation"))


def _revisions(doc_id, items):
    """A base file with an object for each event of the first kind, and a revision for each further event."""
    from quirelake.kernel.document import parse
    from quirelake.kernel.objects import Str
    from quirelake.kernel.writer import Builder, append_revision

    b, numbers = Builder(), {}
    b.page(b"")
    first = [i for i in items if i["event_type"] not in numbers and not numbers.update({i["event_type"]: None})]
    for i in first:
        numbers[i["event_type"]] = b.add({"Kind": Str(i["event_type"].encode()), "Event": int(i["event_id"])}).num
    data = b.build()
    rest = [i for i in items if i not in first]
    for k in range(0, len(rest), 20):
        doc = parse(data)
        changed = {numbers[i["event_type"]]: (0, {"Kind": Str(i["event_type"].encode()), "Event": int(i["event_id"])}) for i in rest[k : k + 20]}
        data = append_revision(data, changed, [], doc.trailer, doc.start, max(doc.objects) + 1)
    return data


@query("SELECT user_id AS doc_id, event_type AS kind, event_id AS event FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def pdf_revisions(spark, d):
    files = generated.made(generated.gathered(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type"), _revisions, "items")
    v = F.parse_json("value_json")
    o = pdf.relation(files, "objects", raw=False).select("doc_id", F.try_variant_get(v, "$.Kind", "string").alias("kind"), F.try_variant_get(v, "$.Event", "bigint").alias("event"))
    return o.where("kind IS NOT NULL AND event IS NOT NULL")


def _fonts(doc_id, text):
    """Every line of the text in one of three kinds of font, by doc_id; the table of codes has the letters of the whole text."""
    from quirelake.kernel.content import Instruction, serialize
    from quirelake.kernel.objects import Name, Str, Stream
    from quirelake.kernel.writer import Builder

    b, kind, lines = Builder(), int(doc_id) % 3, (text or "").split("\n")
    letters = sorted(set().union(*lines))
    code = {c: i for i, c in enumerate(letters, 1)}
    if kind < 2 and len(letters) > 255:
        raise ValueError(f"{len(letters)} letters for codes of one byte")
    if kind == 0:  # codes from 1 on, named by Differences
        font = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Own"), "Encoding": {"Type": Name("Encoding"), "Differences": [1, *(Name(f"uni{ord(c):04X}") for c in letters)]}}
        raw = lambda line: bytes(code[c] for c in line)
    elif kind == 1:  # codes from 1 on, mapped by ToUnicode, 100 to a block
        rows = [b"<%02X> <%04X>" % (i, ord(c)) for c, i in code.items()]
        blocks = [b"%d beginbfchar\n%s\nendbfchar" % (len(own), b"\n".join(own)) for k in range(0, len(rows), 100) for own in [rows[k : k + 100]]]
        cmap = b.add(Stream({}, b"\n".join([b"1 begincodespacerange <00> <FF> endcodespacerange", *blocks])))
        font = {"Type": Name("Font"), "Subtype": Name("TrueType"), "BaseFont": Name("Own"), "ToUnicode": cmap}
        raw = lambda line: bytes(code[c] for c in line)
    else:  # two-byte codes, mapped by ranges
        cmap = b.add(Stream({}, b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <00FF> <0000> endbfrange"))
        kid = b.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Own"), "CIDSystemInfo": {"Registry": Str(b"Adobe"), "Ordering": Str(b"Identity"), "Supplement": 0}, "DW": 500})
        font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Own"), "Encoding": Name("Identity-H"), "DescendantFonts": [kid], "ToUnicode": cmap}
        raw = lambda line: line.encode("utf-16-be")
    out = [Instruction("BT"), Instruction("Tf", [Name("F1"), 10]), Instruction("TL", [12]), Instruction("Td", [36, 756])]
    for i, line in enumerate(lines):
        out += [Instruction("T*")] * bool(i) + ([Instruction("Tj", [Str(raw(line))])] if line else [])
    b.page(serialize([*out, Instruction("ET")]), ["FlateDecode"], resources={"Font": {"F1": b.add(font)}})
    return b.build()


@query(f"SELECT doc_id, len(l) AS n_lines, list_sum(list_transform(l, lambda x: len(x)))::BIGINT AS n_letters FROM (SELECT doc_id, {LINES} AS l FROM documents) WHERE len(l) > 0")
def pdf_fonts(spark, d):
    """Lines and letters of all texts; pdf_fonts_lines compares what the lines say."""
    e = _texts(generated.made(read(spark, d, "documents"), _fonts, "text"))
    return e.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_letters"))


@query(ROUND_TRIP)
def pdf_fonts_lines(spark, d):
    return _read_back(generated.made(read(spark, d, "documents"), _fonts, "text"))


def _kerning(doc_id, items):
    from quirelake.kernel.objects import Str
    from quirelake.kernel.writer import Builder, ContentBuilder

    b = Builder()
    c = ContentBuilder().begin_text().font("F1", 10).leading(14).text_matrix(1, 0, 0, 1, 50, 700)
    for i in items:
        n = int(i["l_linenumber"])
        c.op("TJ", [Str(b"ab"), -100 * n, Str(b"cd")])
        c.op("'", Str(b"next"))
        c.op('"', 2, 1, Str(b"x y"))
        c.next_line()
    b.page(c.end_text().build(), resources={"Font": {"F1": b.default_font()}})
    return b.build()


@query("""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS k FROM lineitem),
e AS (SELECT doc_id, n, k, CASE WHEN k = 0 THEN 0 ELSE 1 END AS c FROM r)
SELECT doc_id, k * 4 + j AS elem_idx, s AS text, round(x, 3) AS x, (700 - 42 * k - dy)::DOUBLE AS y FROM e, LATERAL (VALUES (0, 'ab', 50.0, 0), (1, 'cd', 50.0 + 10 + 2 * c + n, 0), (2, 'next', 50.0, 14), (3, 'x y', 50.0, 28)) v(j, s, x, dy)""")
def pdf_kerning(spark, d):
    rows = read(spark, d, "lineitem")
    files = generated.made(generated.gathered(rows, "l_orderkey", ["l_linenumber", "l_partkey"]), _kerning, "items")
    e = pdf.relation(files, "text_elements", columns=["doc_id", "elem_idx", "text", "x", "y"])
    return e.select("doc_id", F.col("elem_idx").cast("long").alias("elem_idx"), "text", F.round(F.col("x").cast("double"), 3).alias("x"), F.round(F.col("y").cast("double"), 3).alias("y"))


def _graphics(doc_id, items):
    from quirelake.kernel.content import serialize
    from quirelake.kernel.graphics import drawn
    from quirelake.kernel.writer import Builder

    b, out = Builder(), []
    for i in items:
        q, n = float(i["l_quantity"]), int(i["l_linenumber"])
        shape = ("rectangle", "line", "ellipse")[n % 3]
        out += drawn(shape, [n, q, 10 + n, 20], (0, 0, 1), (1, 0, 0) if n % 2 else None, n)
    b.page(serialize(out), ["FlateDecode"])
    return b.build()


@query("""WITH r AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS elem_idx, l_linenumber AS n, l_quantity AS q FROM lineitem)
SELECT doc_id, elem_idx, CASE n % 3 WHEN 0 THEN 'rectangle' WHEN 1 THEN 'move' ELSE 'move' END AS first, CASE WHEN n % 3 = 2 THEN n - (10 + n) ELSE n END::DOUBLE AS llx, CASE n % 3 WHEN 0 THEN q WHEN 1 THEN least(q, 20) ELSE q - 20 END::DOUBLE AS lly,
 CASE n % 3 WHEN 0 THEN n + 10 + n WHEN 1 THEN 10 + n ELSE n + 10 + n END::DOUBLE AS urx, CASE n % 3 WHEN 0 THEN q + 20 WHEN 1 THEN greatest(q, 20) ELSE q + 20 END::DOUBLE AS ury, n::DOUBLE AS line_width, (n % 2 = 1 AND n % 3 <> 1) AS filled FROM r""")
def pdf_graphics(spark, d):
    files = generated.made(generated.gathered(read(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], "l_quantity"), _graphics, "items")
    g = pdf.relation(files, "graphics_elements", columns=["doc_id", "elem_idx", "segments", "fill", "line_width", "bounds"])
    side = [F.round(F.col(f"bounds.{c}").cast("double"), 3).alias(c) for c in ("llx", "lly", "urx", "ury")]
    return g.select("doc_id", F.col("elem_idx").cast("long").alias("elem_idx"), F.col("segments")[0]["kind"].alias("first"), *side, F.col("line_width").cast("double").alias("line_width"), F.col("fill").isNotNull().alias("filled"))


def _image(doc_id, embedding):
    """An 8 x 8 gray or 2 x 11 RGB image of all of the vector's bytes (filled up with zeros), drawn at a place that doc_id gives."""
    from quirelake.kernel.objects import Name, Stream
    from quirelake.kernel.writer import Builder, ContentBuilder

    b, kind, n = Builder(), int(doc_id) % 2, int(doc_id)
    raw = bytes(min(255, int(abs(v) * 255)) for v in embedding)
    space, w, h = (("DeviceGray", 8, 8), ("DeviceRGB", 2, 11))[kind]
    size = w * h * (1, 3)[kind]
    im = b.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": h, "BitsPerComponent": 8, "ColorSpace": Name(space)}, raw[:size].ljust(size, b"\0")))
    c = ContentBuilder().save().concat(w * 2, 0, 0, h * 2, n % 100, n % 50).draw("Im1").restore()
    b.page(c.build(), resources={"XObject": {"Im1": im}})
    return b.build()


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda v: least(255, trunc(abs(v::DOUBLE) * 255)::INT)) AS v FROM embeddings)
SELECT vec_id AS doc_id, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 2 END AS width, CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 11 END AS height, (vec_id % 100)::DOUBLE AS x, (vec_id % 50)::DOUBLE AS y,
 md5(array_to_string(list_transform(CASE WHEN vec_id % 2 = 0 THEN flatten(list_transform(v, lambda x: [x, x, x])) ELSE list_concat(v, [0, 0]) END, lambda x: printf('%02X', x)), '')) AS pixels_md5 FROM b""")
def pdf_images(spark, d):
    files = generated.made(read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), _image, "embedding")
    i = pdf.relation(files, "images", pixels=True)
    return i.select("doc_id", "width", "height", F.col("position.x").cast("double").alias("x"), F.col("position.y").cast("double").alias("y"), F.md5(F.hex("pixels")).alias("pixels_md5"))


def _first_lines(spark, d) -> DataFrame:
    c = read(spark, d, "conversations").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    return c


@query("""WITH t AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS p, replace(text, chr(10), ' ') AS text FROM conversations),
e AS (SELECT doc_id, p, CASE WHEN p = 0 THEN replace(text, 'the', 'THE') ELSE text END AS text FROM t)
SELECT doc_id, p::INT AS page_index, md5(text || CASE WHEN p = 0 THEN chr(10) || 'added' ELSE '' END) AS text_md5 FROM e WHERE NOT (p = 1 AND contains(lower(text), 'an')) AND text <> ''""")
def pdf_edits(spark, d):
    turns = _first_lines(spark, d)
    files = generated.turns_as_files(turns)
    # Ids come from the rows, not from the files, which so are built once.
    rows = turns.select(F.col("conv_id").alias("doc_id")).distinct()
    make = lambda i, page, kind, s, to, ci=False: rows.select(F.lit(i).cast("long").alias("edit_id"), "doc_id", F.lit(page).alias("page_index"), F.lit(kind).alias("kind"), F.lit(s).alias("search"), F.lit(to).alias("replacement"), F.lit(ci).alias("ignore_case"))
    wanted = make(1, 0, "replace", "the", "THE").unionByName(make(2, 1, "delete", "an", "", True)).unionByName(make(3, 0, "add", "", "added"))
    done = edits.apply_edits(files, wanted)
    return search.page_text(_texts(done)).select("doc_id", "page_index", F.md5("text").alias("text_md5"))


def _redundant(doc_id, items):
    from quirelake.kernel.writer import Builder, ContentBuilder

    b, c = Builder(), ContentBuilder()
    for i in items:
        c.line_width(len(i["event_type"])).save().restore().rectangle(0, 0, 1, 1).stroke()
    b.page(c.build(), ["FlateDecode"])
    return b.build()


@query("""WITH l AS (SELECT user_id AS doc_id, length(event_type) AS n, lag(length(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT doc_id, count(*) FILTER (n IS DISTINCT FROM before) + 2 * count(*) AS n_instructions FROM l GROUP BY 1""")
def pdf_optimize(spark, d):
    events = read(spark, d, "events")
    files = generated.made(generated.gathered(events, "user_id", ["ts", "event_id"], "event_type"), _redundant, "items")
    wanted = events.select(F.col("user_id").alias("doc_id")).distinct().select(F.lit(1).cast("long").alias("edit_id"), "doc_id", F.lit(0).alias("page_index"), F.lit("optimize").alias("kind"))
    return pdf.relation(edits.apply_edits(files, wanted), "instructions").groupBy("doc_id").agg(F.count("*").alias("n_instructions"))


@query("SELECT doc_id, true AS as_before FROM documents")
def pdf_rewrite(spark, d):
    docs = read(spark, d, "documents")
    files = written(generated.documents_as_files(docs, "flate", packed=True), "files")
    before, after = _read_back(files), _read_back(edits.rewritten(files)).withColumnsRenamed({"n_lines": "n2", "text_md5": "m2"})
    both = docs.select("doc_id").join(before, "doc_id", "left").join(after, "doc_id", "left")
    return both.select("doc_id", (F.col("text_md5").eqNullSafe(F.col("m2")) & F.col("n_lines").eqNullSafe(F.col("n2"))).alias("as_before"))


@query("SELECT conv_id AS doc_id, count(*) AS pages, count(*) AS listed FROM conversations GROUP BY 1")
def pdf_endpoint(spark, d):
    files = generated.turns_as_files(read(spark, d, "conversations"))
    done = endpoint.sessions(files, [request("pdf/getDocumentInfo"), request("pdf/getPages")])
    pages = F.get_json_object(F.col("responses")[0], "$.result.pageCount").cast("long")
    listed = F.size(F.from_json(F.get_json_object(F.col("responses")[1], "$.result.pages"), "array<string>")).cast("long")
    return done.select("doc_id", pages.alias("pages"), listed.alias("listed"))


def _hostile(doc_id, text):
    """A damaged file: cut short, its tail gone, its start gone, or noise."""
    data, n = generated.one_page(int(doc_id), text, ["FlateDecode"]), int(doc_id) % 4
    return (data[: len(data) // 2], data[:-60], data[15:], b"\0" * 100)[n]


@query("""SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 'read' ELSE 'header' END AS outcome, CASE WHEN doc_id % 4 = 1 THEN coalesce(md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10))), md5('')) END AS text_md5 FROM documents""")
def pdf_hostile(spark, d):
    """Files cut short or without an end are repaired, those without an end with all of their text; those without a start are errors."""
    files = generated.made(read(spark, d, "documents"), _hostile, "text")
    m = pdf.relation(files, "documents_meta").select("doc_id", F.coalesce("error_class", F.lit("read")).alias("outcome"))
    item = F.array_sort(F.collect_list(F.struct("page_index", "elem_idx", "text")))
    texts = pdf.relation(files, "text_elements").where("text <> ''").groupBy("doc_id").agg(F.md5(F.array_join(F.transform(item, lambda x: x["text"]), "\n")).alias("found"))
    whole = F.when(F.col("doc_id") % 4 == 1, F.coalesce("found", F.md5(F.lit(""))))
    return m.join(texts, "doc_id", "left").select("doc_id", "outcome", whole.alias("text_md5"))


@query(ROUND_TRIP)
def pdf_udtf(spark, d):
    endpoint.register(spark)
    files = generated.documents_as_files(read(spark, d, "documents"))
    rows = spark.sql("SELECT f.doc_id, t.* FROM {files} f, LATERAL pdf_text(f.content) t", files=files)
    item = F.array_sort(F.collect_list(F.struct("page_index", "elem_idx", "text")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.md5(F.array_join(F.transform(item, lambda x: x["text"]), "\n")).alias("text_md5"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return pdf_find(spark, d)
