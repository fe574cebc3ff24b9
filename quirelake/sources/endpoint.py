"""JSON-RPC over files, table functions for SQL, and a data source: other ways into the same kernel."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.sources.shipping import ship

METHODS = ("pdf/getDocumentInfo", "pdf/getPages", "pdf/getPageContent", "pdf/getTextBlocks", "pdf/getObject", "pdf/deleteObject", "pdf/addAnnotation", "pdf/updateText", "pdf/updateObject")


def handle(data: bytes, request: str, password: str = "") -> tuple[str, bytes]:
    """The response to a request, and the file after it."""
    from quirelake.kernel import edit
    from quirelake.kernel.content import parse_content
    from quirelake.kernel.document import parse
    from quirelake.kernel.fonts import page_fonts
    from quirelake.kernel.objects import Name, Ref, Str, plain, show_text
    from quirelake.kernel.text import page_text

    ident = None

    def answer(**x) -> tuple[str, bytes]:
        return json.dumps({"jsonrpc": "2.0", "id": ident, **x}, ensure_ascii=False), data

    try:
        q = json.loads(request)
        ident, method, p = q.get("id"), q["method"], q.get("params") or {}
    except (ValueError, KeyError, AttributeError):
        return answer(error={"code": -32700, "message": "no request"})
    if method not in METHODS:
        return answer(error={"code": -32601, "message": f"unknown method {method}"})
    try:
        doc = parse(data, password)
        pages = doc.pages()
        page = lambda: pages[int(p.get("pageIndex", 0))]
        number = lambda: int(str(p["objectKey"]).split()[0])
        if method == "pdf/getDocumentInfo":
            text = lambda k: show_text(bytes(v)) if isinstance(v := doc.get(doc.info.get(k)), bytes) else None
            return answer(result={"version": doc.version, "pageCount": len(pages), "objectCount": len(doc.objects), "title": text("Title"), "author": text("Author"), "subject": text("Subject"), "encrypted": doc.security is not None})
        if method == "pdf/getPages":
            return answer(result={"pages": [{"index": x.index, "width": doc.box(x)[2] - doc.box(x)[0], "height": doc.box(x)[3] - doc.box(x)[1], "rotation": doc.rotation(x)} for x in pages]})
        if method == "pdf/getPageContent":
            return answer(result={"content": doc.page_content(page()).decode("latin-1")})
        if method == "pdf/getTextBlocks":
            return answer(result={"blocks": [dict(zip(("text", "x", "y", "font", "fontSize"), b, strict=True)) for b in page_text(doc, page(), gap=-100.0).blocks]})
        if method == "pdf/getObject":
            return answer(result={"object": plain(doc.objects[number()][1])}) if number() in doc.objects else answer(error={"code": -32602, "message": "no such object"})
        if method == "pdf/deleteObject":
            known = number() in doc.objects
            if known:
                data = edit.revised(data, doc, {}, [number()])
            return answer(result={"success": True, "known": known})
        if method == "pdf/addAnnotation":
            x = page()
            x1, y1, x2, y2 = (float(p.get(k, 0)) for k in ("x", "y", "x2", "y2"))
            top = max(doc.objects, default=0) + 1
            note = {"Type": Name("Annot"), "Subtype": Name(str(p.get("type", "Text"))), "Rect": [x1, y1, x2, y2], "Contents": Str(str(p.get("content", "")).encode("latin-1", "replace"))}
            x.dict["Annots"] = [*(doc.get(x.dict.get("Annots")) or []), Ref(top)]
            data = edit.revised(data, doc, {top: (0, note), x.ref.num: (x.ref.gen, x.dict)})
            return answer(result={"objectKey": f"{top} 0"})
        if method == "pdf/updateText":
            x = page()
            after, n = edit.replace_text(parse_content(doc.page_content(x)), page_fonts(doc, x), str(p["oldText"]), str(p["newText"]))
            if n:
                data = edit.revised(data, doc, edit.set_content(doc, x, after))
            return answer(result={"replaced": n})
        value = doc.objects[number()][1]
        value = {**doc.dict_of(value), **{k: Name(v[1:]) if isinstance(v, str) and v.startswith("/") else Str(v.encode()) if isinstance(v, str) else v for k, v in (p.get("value") or {}).items()}}
        data = edit.revised(data, doc, {number(): (0, value)})
        return answer(result={"success": True})
    except Exception as e:  # noqa: BLE001 - a request never fails a task
        return answer(error={"code": -32603, "message": str(e)[:300]})


def answers(files: DataFrame, request: Column | str) -> DataFrame:
    """doc_id, response, content (after the request) of a JSON-RPC request to each file (doc_id, content)."""
    ship(files.sparkSession)
    request = F.lit(request) if isinstance(request, str) else request

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [handle(c.as_py() or b"", q.as_py()) for c, q in zip(batch.column("content"), batch.column("request"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.binary())], ["doc_id", "response", "content"])

    return files.select("doc_id", "content", request.alias("request")).mapInArrow(each, "doc_id bigint, response string, content binary")


def sessions(files: DataFrame, requests: list[str] | Column, password: str = "") -> DataFrame:
    """doc_id, responses, content of several JSON-RPC requests to each file, answered in order in one pass.

    requests: the same for all files, or a column of arrays. A request sees what those before it wrote; content is the
    file after the last of them, null where none wrote.
    """
    ship(files.sparkSession)
    asked = requests if isinstance(requests, Column) else F.array(*map(F.lit, requests))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            responses, contents = [], []
            for held, own in zip(batch.column("content"), batch.column("requests"), strict=True):
                before = held.as_py() or b""
                data, said = before, []
                for q in own.as_py() or ():
                    answer, data = handle(data, q, password)
                    said.append(answer)
                responses.append(said)
                contents.append(data if data != before else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(responses, pa.list_(pa.string())), pa.array(contents, pa.binary())], ["doc_id", "responses", "content"])

    return files.select("doc_id", "content", asked.alias("requests")).mapInArrow(each, "doc_id bigint, responses array<string>, content binary")


class PdfText:
    """pdf_text(content): page_index, elem_idx, text, x, y."""

    def eval(self, content: bytes):
        from quirelake.sources.pdf import rows_of

        for r in rows_of("text_elements", 0, bytes(content or b"")):
            yield r[1], r[2], r[3], float(r[4]), float(r[5])


class PdfInstructions:
    """pdf_instructions(content): page_index, instr_idx, op, category, operands (JSON)."""

    def eval(self, content: bytes):
        from quirelake.sources.pdf import rows_of

        for r in rows_of("instructions", 0, bytes(content or b"")):
            yield r[1], r[3], r[4], r[5], json.dumps([o["json"] for o in r[6]])


def register(spark: SparkSession) -> None:
    """The table functions pdf_text and pdf_instructions, for LATERAL in SQL, and the data source format("pdf")."""
    ship(spark)
    spark.udtf.register("pdf_text", F.udtf(PdfText, returnType="page_index int, elem_idx int, text string, x double, y double"))
    spark.udtf.register("pdf_instructions", F.udtf(PdfInstructions, returnType="page_index int, instr_idx int, op string, category string, operands string"))


def as_base64(data: bytes) -> str:
    return base64.b64encode(data).decode()
