"""Relations of page-description files. Bytes cross into Python once, in mapInArrow; everything else is columns.

files (doc_id, content) -> one relation each: documents_meta, xref, objects,
pdf_pages, page_streams, instructions, fonts, text_elements, text_blocks, graphics_elements,
images. A file that can't be read gives an error row in documents_meta and no
row elsewhere; it never fails a task.

At scale: files are split over tasks by Spark's own file splitting (or by
``spread`` where a table of few large rows holds them); a relation reads the
columns doc_id and content alone, and options such as ``pages`` keep the kernel
from decoding what no one asked for.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from quirelake.sources.shipping import ship

BOX = "struct<llx: float, lly: float, urx: float, ury: float>"
SCHEMAS = {
    "documents_meta": "doc_id bigint, version string, start_xref bigint, trailer_json string, title string, author string, subject string, encrypted boolean, object_count int, declared_page_count int, actual_page_count int, damaged_objects int, error_class string, error string",
    "xref": "doc_id bigint, revision int, obj int, gen int, kind string, byte_offset bigint, next_free int, objstm int, idx int",
    "objects": "doc_id bigint, obj int, gen int, kind string, type string, subtype string, value_json string, raw binary",
    "pdf_pages": f"doc_id bigint, page_index int, obj int, gen int, media_box {BOX}, crop_box {BOX}, rotation int, resources_json string",
    "page_streams": "doc_id bigint, page_index int, stream_idx int, obj int, gen int, content binary",
    "instructions": "doc_id bigint, page_index int, stream_idx int, instr_idx int, op string, category string, operands array<struct<kind: string, num: double, str: string, bytes: binary, json: string>>",
    "fonts": "doc_id bigint, page_index int, res_name string, subtype string, base_font string, encoding string, ordering string, embedded string, code_map map<int, string>, widths map<int, int>, default_width int",
    "text_elements": "doc_id bigint, page_index int, elem_idx int, text string, x float, y float, width float, height float, font_name string, font_size float, render_mode int, char_spacing float, word_spacing float, matrix array<float>, raw_bytes binary",
    "text_blocks": "doc_id bigint, page_index int, block_idx int, text string, x float, y float, font string, font_size float",
    "graphics_elements": f"doc_id bigint, page_index int, elem_idx int, segments array<struct<kind: string, pts: array<float>>>, stroke array<float>, fill array<float>, line_width float, bounds {BOX}",
    "images": "doc_id bigint, page_index int, name string, width int, height int, bpc int, color_space string, position struct<x: float, y: float, width: float, height: float>, pixels binary, pixel_error string",
}


def _json(x) -> str:
    from quirelake.kernel.objects import plain

    return json.dumps(plain(x), ensure_ascii=False, allow_nan=False, default=str)


def _meta(doc_id, doc, options):
    from quirelake.kernel.objects import show_text

    info = doc.info
    text = lambda k: show_text(bytes(v)) if isinstance(v := doc.get(info.get(k)), bytes) else None
    yield (doc_id, doc.version, doc.start, _json(doc.trailer), text("Title"), text("Author"), text("Subject"), doc.security is not None, len(doc.objects), doc.declared_pages, len(doc.pages()), len(doc.errors), None, None)


def _xref(doc_id, doc, options):
    for e in doc.entries:
        yield (doc_id, e.revision, e.num, e.gen, e.kind, e.offset if e.kind == "used" else None, e.offset if e.kind == "free" else None, e.offset if e.kind == "packed" else None, e.index if e.kind == "packed" else None)


def _objects(doc_id, doc, options):
    from quirelake.kernel.objects import Stream, kind_of

    for num, (ref, value) in sorted(doc.objects.items()):
        d = doc.dict_of(value) if isinstance(value, (dict, Stream)) else {}
        name = lambda k: str(v) if isinstance(v := doc.get(d.get(k)), str) else None
        yield (doc_id, num, ref.gen, kind_of(value), name("Type"), name("Subtype"), _json(value), value.raw if isinstance(value, Stream) and options.get("raw", True) else None)


def _box(b):
    return dict(zip(("llx", "lly", "urx", "ury"), map(float, b), strict=True)) if b else None


def _chosen(doc, options):
    wanted = options.get("pages")
    return [p for p in doc.pages() if wanted is None or p.index in wanted]


def _pages(doc_id, doc, options):
    for p in _chosen(doc, options):
        yield (doc_id, p.index, p.ref.num if p.ref else None, p.ref.gen if p.ref else None, _box(doc.box(p)), _box(doc.box(p, "CropBox")), doc.rotation(p), _json(doc.resources(p)))


def _streams(doc_id, doc, options):
    """The content streams of each page in order, decoded."""
    from quirelake.kernel.objects import Ref, Stream

    for p in _chosen(doc, options):
        named = p.dict.get("Contents")
        own = doc.get(named)
        for k, ref in enumerate(own if isinstance(own, list) else [named]):
            if isinstance(x := doc.get(ref), Stream):
                yield (doc_id, p.index, k, *((ref.num, ref.gen) if isinstance(ref, Ref) else (None, None)), doc.content(x))


def operand(x) -> dict:
    from quirelake.kernel.objects import kind_of, number, show_text

    kind = kind_of(x)
    return {"kind": kind, "num": number(x) if kind == "number" else None, "str": str(x) if kind == "name" else show_text(bytes(x)) if kind == "string" else None, "bytes": bytes(x) if kind == "string" else None, "json": _json(x)}


def _instructions(doc_id, doc, options):
    from quirelake.kernel.content import OPERATORS, parse_content

    for p in _chosen(doc, options):
        for i, x in enumerate(parse_content(doc.page_content(p))):
            yield (doc_id, p.index, 0, i, x.op, OPERATORS.get(x.op, ("unknown",))[0], [operand(a) for a in x.args])


def _fonts(doc_id, doc, options):
    from quirelake.kernel.fonts import page_fonts

    for p in _chosen(doc, options):
        for name, f in page_fonts(doc, p).items():
            codes = {int.from_bytes(c, "big"): t for c, t in f.to_unicode.text.items()} if f.to_unicode else {}
            yield (doc_id, p.index, name, f.subtype, f.base, f.encoding, f.ordering or None, f.embedded, f.codes | codes, {k: int(w) for k, w in f.widths.items()}, int(f.default_width))


def _text(doc_id, doc, options):
    from quirelake.kernel.text import page_text

    for p in _chosen(doc, options):
        for i, e in enumerate(page_text(doc, p, bool(options.get("forms"))).elements):
            yield (doc_id, p.index, i, e.text, e.x, e.y, e.width, e.height, e.font, e.size, e.mode, e.char_space, e.word_space, list(e.matrix), e.raw)


def _blocks(doc_id, doc, options):
    from quirelake.kernel.text import page_text

    for p in _chosen(doc, options):
        for i, b in enumerate(page_text(doc, p, gap=options.get("gap", -100.0)).blocks):
            yield (doc_id, p.index, i, *b)


def _graphics(doc_id, doc, options):
    from quirelake.kernel.content import parse_content
    from quirelake.kernel.graphics import paths

    for p in _chosen(doc, options):
        for i, g in enumerate(paths(parse_content(doc.page_content(p)))):
            yield (doc_id, p.index, i, [{"kind": k, "pts": list(map(float, v))} for k, v in g.segments], list(g.stroke) if g.stroke else None, list(g.fill) if g.fill else None, g.line_width, _box(g.bounds()))


def _images(doc_id, doc, options):
    from quirelake.kernel.content import parse_content
    from quirelake.kernel.graphics import images, pixels
    from quirelake.kernel.objects import PdfError

    for p in _chosen(doc, options):
        for im in images(doc, p, parse_content(doc.page_content(p))):
            raw = error = None
            if options.get("pixels"):
                try:
                    raw = pixels(doc, im)
                except (PdfError, ValueError, IndexError) as e:
                    error = str(e)
            place = dict(zip(("x", "y", "width", "height"), map(float, im.position), strict=True)) if im.position else None
            yield (doc_id, p.index, im.name, im.width, im.height, im.bits, im.space, place, raw, error)


READERS = {"documents_meta": _meta, "xref": _xref, "objects": _objects, "pdf_pages": _pages, "page_streams": _streams, "instructions": _instructions, "fonts": _fonts, "text_elements": _text, "text_blocks": _blocks, "graphics_elements": _graphics, "images": _images}
#: Rows of one data frame handed back to Spark, at most.
ROWS = 5_000


def rows_of(relation: str, doc_id, data: bytes, password: str = "", options: dict | None = None) -> Iterator[tuple]:
    """Rows of a relation of one file; a file that can't be read is an error row of documents_meta."""
    from quirelake.kernel.document import parse
    from quirelake.kernel.objects import PdfError

    try:
        if data is None:
            raise PdfError("size", "no content: it is null, or larger than the bound of read_files")
        yield from list(READERS[relation](doc_id, parse(data, password), options or {}))
    except Exception as e:  # noqa: BLE001 - whatever a hostile file does becomes a row
        if relation == "documents_meta":
            kind = e.kind if isinstance(e, PdfError) else type(e).__name__
            yield (doc_id, None, None, None, None, None, None, None, None, None, None, None, kind, str(e)[:500])


def relation(files: DataFrame, name: str, password: str = "", columns: list[str] | None = None, **options) -> DataFrame:
    """A relation of files (doc_id, content), of all its columns or those named. A column password in files overrides the argument."""
    spark = files.sparkSession
    ship(spark)
    schema = SCHEMAS[name]
    kinds = to_arrow_schema(spark.createDataFrame([], schema).schema)
    own = "password" in files.columns
    # What is not asked for isn't handed to Spark.
    places = [kinds.get_field_index(c) for c in columns] if columns else list(range(len(kinds)))
    kinds = pa.schema([kinds.field(i) for i in places])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        held = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(held[i], f.type) for i, f in zip(places, kinds, strict=True)], schema=kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            words = batch.column("password").to_pylist() if own else [password] * batch.num_rows
            # One file's bytes at a time: a batch may hold many.
            for doc_id, data, word in zip(batch.column("doc_id").to_pylist(), batch.column("content"), words, strict=True):
                for row in rows_of(name, doc_id, data.as_py(), word or "", options):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return files.select("doc_id", "content", *(["password"] if own else [])).mapInArrow(read, from_arrow_schema(kinds))


def typed(df: DataFrame) -> DataFrame:
    """JSON columns as VARIANT."""
    for c in [c for c in df.columns if c.endswith("_json")]:
        df = df.withColumn(c.removesuffix("_json"), F.parse_json(c)).drop(c)
    return df


def read_files(spark: SparkSession, path: str, largest: int = 1 << 30) -> DataFrame:
    """Files of a folder with a doc_id each; larger ones than the bound have no content, and so become error rows."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("modificationTime").alias("modified"), "length", F.when(F.col("length") <= largest, F.col("content")).alias("content"))


def spread(files: DataFrame, each: int = 64 << 20) -> DataFrame:
    """files dealt out anew by size, for tables whose few partitions hold large files."""
    total = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, -(-total // each)), "doc_id")


def header_version(content) -> Column:
    """The version in a file's first 20 bytes, without Python; null if there is none."""
    head = F.decode(F.substring(content, 1, 20), "ISO-8859-1")
    return F.nullif(F.regexp_extract(head, r"%PDF-(\d+\.\d+)", 1), F.lit(""))


def start_offset(content) -> Column:
    """The last startxref within a file's last 1,024 bytes, without Python; null if there is none or no end mark."""
    tail = F.decode(F.substring(content, -1024, 1024), "ISO-8859-1")
    found = F.regexp_extract_all(tail, F.lit(r"startxref\s+(\d+)"), 1)
    return F.when(tail.contains("%%EOF") & (F.size(found) > 0), F.element_at(found, -1).cast("bigint"))


def operator_dim(spark: SparkSession) -> DataFrame:
    """op, category, operand_count (null: any) of all operators: 71 rows."""
    from quirelake.kernel.content import OPERATORS

    rows = [(op, category, n if n >= 0 else None) for op, (category, n) in OPERATORS.items()]
    return spark.createDataFrame(rows, "op string, category string, operand_count int")
