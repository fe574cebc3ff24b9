"""Edits of a page's instructions, and of a file by whole edit rows."""

from __future__ import annotations

import re

from .content import Instruction, parse_content, serialize
from .filters import encode
from .fonts import Font, page_fonts
from .graphics import drawn
from .objects import Name, PdfError, Ref, Str, Stream, number
from .writer import append_revision, write_file

SHOWING = ("Tj", "TJ", "'", '"')


def shown(i: Instruction) -> list[bytes]:
    """The strings that an instruction shows."""
    if i.op not in SHOWING or not i.args:
        return []
    x = i.args[-1]
    return [x] if isinstance(x, bytes) else [v for v in x if isinstance(v, bytes)] if isinstance(x, list) else []


def with_fonts(instructions: list[Instruction], fonts: dict[str, Font]):
    """Each instruction with the font in force."""
    font, stack = Font(), []
    for i in instructions:
        if i.op == "q":
            stack.append(font)
        elif i.op == "Q":
            font = stack.pop() if stack else font
        elif i.op == "Tf" and i.args:
            font = fonts.get(str(i.args[0]), Font())
        yield i, font


def replace_text(instructions: list[Instruction], fonts: dict[str, Font], search: str, to: str, ignore_case: bool = False, every: bool = True) -> tuple[list[Instruction], int]:
    """Replaces non-overlapping occurrences in all showing instructions; the strings of a TJ become one. Text that the font can't write stays as it is."""
    find = re.compile(re.escape(search), re.IGNORECASE if ignore_case else 0)
    out, total = [], 0
    for i, font in with_fonts(instructions, fonts):
        strings = shown(i)
        if strings and search and (every or not total):
            text = "".join(map(font.decode, strings))
            new, n = find.subn(lambda _: to, text, count=0 if every else 1)
            raw = font.encode(new) if n else None
            if raw is not None:
                total += n
                i = Instruction(i.op, [*i.args[:-1], [Str(raw)] if i.op == "TJ" else Str(raw)])
        out.append(i)
    return out, total


def delete_text(instructions: list[Instruction], fonts: dict[str, Font], search: str, ignore_case: bool = False) -> tuple[list[Instruction], int]:
    """Drops whole showing instructions whose text has the searched one."""
    low = (lambda t: t.lower()) if ignore_case else (lambda t: t)
    out, total = [], 0
    for i, font in with_fonts(instructions, fonts):
        if (strings := shown(i)) and low(search) in low("".join(map(font.decode, strings))):
            total += 1
        else:
            out.append(i)
    return out, total


def add_text(text: bytes, x: float, y: float, font: str, size: float, color: tuple | None = None) -> list[Instruction]:
    return [Instruction("q"), Instruction("BT"), *([Instruction("rg", list(color))] if color else []), Instruction("Tf", [Name(font), size]), Instruction("Tm", [1, 0, 0, 1, x, y]), Instruction("Tj", [Str(text)]), Instruction("ET"), Instruction("Q")]


def modify_first(instructions: list[Instruction], fonts: dict[str, Font], font_name: str, text: str, to: str) -> tuple[list[Instruction], int]:
    """Rewrites the first Tj in this font with just this text."""
    current, done, out = "", 0, []
    for i, font in with_fonts(instructions, fonts):
        if i.op == "Tf" and i.args:
            current = str(i.args[0])
        if not done and i.op == "Tj" and current == font_name and shown(i) and font.decode(shown(i)[0]) == text and (raw := font.encode(to)) is not None:
            i, done = Instruction("Tj", [Str(raw)]), 1
        out.append(i)
    return out, done


def replace_in_object(instructions: list[Instruction], index: int, raw: bytes) -> tuple[list[Instruction], int]:
    """Gives the first Tj of the index-th text object (from 0) a new string."""
    at, done, out = -1, 0, []
    for i in instructions:
        at += i.op == "BT"
        if not done and at == index and i.op == "Tj":
            i, done = Instruction("Tj", [Str(raw)]), 1
        out.append(i)
    return out, done


def insert(instructions: list[Instruction], new: list[Instruction], where: str = "end", index: int = 0) -> list[Instruction]:
    """where: start, end, before, after or at; index says of which instruction."""
    at = {"start": 0, "end": len(instructions), "before": index, "at": index, "after": index + 1}[where]
    at = max(0, min(at, len(instructions)))
    return instructions[:at] + new + instructions[at:]


#: Operators that set a value which an equal one before makes needless.
SETTERS = ("g", "G", "rg", "RG", "k", "K", "w")


def optimize(instructions: list[Instruction]) -> list[Instruction]:
    """Drops setters that repeat the value in force, for each operator and at each depth of q and Q, and empty pairs of q and Q."""
    out: list[Instruction] = []
    state: dict[str, list] = {}
    stack: list[dict] = []
    kinds = {"g": "fill", "rg": "fill", "k": "fill", "G": "stroke", "RG": "stroke", "K": "stroke", "w": "width", "cs": "fill", "sc": "fill", "scn": "fill", "CS": "stroke", "SC": "stroke", "SCN": "stroke", "gs": "width"}
    for i in instructions:
        if i.op in SETTERS:
            kind = kinds[i.op]
            if state.get(kind) == [i.op, *i.args]:
                continue
            state[kind] = [i.op, *i.args]
        elif i.op in kinds:
            state.pop(kinds[i.op], None)
        elif i.op == "q":
            stack.append(dict(state))
        elif i.op == "Q":
            state = stack.pop() if stack else {}
            if out and out[-1].op == "q":
                out.pop()
                continue
        out.append(i)
    return out


def without_image(instructions: list[Instruction], name: str) -> list[Instruction]:
    """Without the drawing of an image; a q ... Q around it that draws nothing else goes too."""
    out: list[Instruction] = []
    for i in instructions:
        if i.op == "Do" and i.args and str(i.args[0]) == name:
            continue
        out.append(i)
        if i.op == "Q":
            depth = at = 0
            for at in range(len(out) - 1, -1, -1):
                depth += (out[at].op == "Q") - (out[at].op == "q")
                if not depth:
                    break
            if not depth and all(x.op in ("q", "Q", "cm") for x in out[at:]) and len(out[at:]) < len(instructions):
                del out[at:]
    return out


def _replace_in_object(instructions: list[Instruction], fonts: dict[str, Font], index: int, to: str) -> tuple[list[Instruction], int]:
    """replace_in_object with text, written by the font in force there; text that it can't write changes nothing."""
    at = -1
    for i, font in with_fonts(instructions, fonts):
        at += i.op == "BT"
        if at == index and i.op == "Tj":
            raw = font.encode(to)
            return (instructions, 0) if raw is None else replace_in_object(instructions, index, raw)
    return instructions, 0


def _image(e: dict) -> Stream:
    """The image of an edit: a JPEG file as it is, or else rows of 8-bit gray, RGB or CMYK samples of its width and height."""
    data, w, h = bytes(e.get("image") or b""), int(number(e.get("width"))), int(number(e.get("height")))
    if data[:2] == b"\xff\xd8":
        w, h, n = _jpeg_size(data)
    else:
        n = len(data) // (w * h) if w > 0 and h > 0 else 0
        if n not in (1, 3, 4) or len(data) != w * h * n:
            raise PdfError("edit", f"{len(data)} bytes are no image of {w} x {h}")
    space = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}[n]
    jpeg = data[:2] == b"\xff\xd8"
    entries = {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": w, "Height": h, "BitsPerComponent": 8, "ColorSpace": Name(space), "Filter": Name("DCTDecode" if jpeg else "FlateDecode")}
    return Stream(entries, data if jpeg else encode(data, ["FlateDecode"]))


def _jpeg_size(data: bytes) -> tuple[int, int, int]:
    """Width, height and number of components by the frame header."""
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:  # fill
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w, n = int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 7 : at + 9], "big"), data[at + 9]
            if w and h and n in (1, 3, 4):
                return w, h, n
            break
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    raise PdfError("edit", "JPEG file without a frame of 1, 3 or 4 components")


def _closed(instructions: list[Instruction]) -> list[Instruction]:
    """instructions in a q ... Q of their own, so that what follows is placed on the page itself."""
    depth = 0
    for i in instructions:
        depth += (i.op == "q") - (i.op == "Q" and depth > 0)
    return [Instruction("q"), *instructions, *[Instruction("Q")] * (depth + 1)] if instructions else []


def replace_image(doc, page, name: str, image: Stream) -> tuple[int, dict[int, tuple[int, object]]]:
    """Puts image in the place of the page's image of this name, wherever that object is drawn. Returns how many, and changed objects."""
    objects = doc.get((doc.resources(page) or {}).get("XObject")) or {}
    ref = objects.get(name)
    old = doc.get(ref)
    if not isinstance(ref, Ref) or not isinstance(old, Stream) or doc.get(old.dict.get("Subtype")) != "Image":
        return 0, {}
    stale = ("Filter", "DecodeParms", "Decode", "Length", "ImageMask", "Mask", "Intent")
    new = Stream({k: v for k, v in old.dict.items() if k not in stale} | image.dict, image.raw)
    real = doc.objects[ref.num][0]
    doc.objects[ref.num] = (real, new)
    return 1, {ref.num: (real.gen, new)}


def add_image(doc, page, image: Stream) -> tuple[str, dict[int, tuple[int, object]]]:
    """Gives a page an image under a name that its resources don't have: the name, and changed objects."""
    resources = dict(doc.resources(page) or {})
    objects = dict(doc.get(resources.get("XObject")) or {})
    k = 1
    while f"Im{k}" in objects:
        k += 1
    top = max(doc.objects, default=0) + 1
    doc.objects[top] = (Ref(top), image)
    # The page gets resources of its own: shared ones would name the image on other pages too.
    page.dict["Resources"] = page.inherited["Resources"] = resources | {"XObject": objects | {f"Im{k}": Ref(top)}}
    changed: dict[int, tuple[int, object]] = {top: (0, image)}
    if page.ref is not None:
        changed[page.ref.num] = (page.ref.gen, page.dict)
    return f"Im{k}", changed


def set_content(doc, page, instructions: list[Instruction], compress: bool = True) -> dict[int, tuple[int, object]]:
    """Changed objects that give a page this content as one stream."""
    data = serialize(instructions)
    stream = Stream({"Filter": Name("FlateDecode")} if compress else {}, encode(data, ["FlateDecode"]) if compress else data)
    top = max(doc.objects, default=0) + 1
    page.dict["Contents"] = Ref(top)
    doc.objects[top] = (Ref(top), stream)
    changed: dict[int, tuple[int, object]] = {top: (0, stream)}
    if page.ref is not None:
        changed[page.ref.num] = (page.ref.gen, page.dict)
    return changed


#: Kinds of edit rows; any other is an error.
KINDS = ("replace", "replace_first", "insert_instructions", "remove_instructions", "replace_instructions", "compress", "decompress", "delete", "modify", "add", "rectangle", "line", "ellipse", "optimize", "delete_image", "replace_in_object", "replace_image", "add_image")


def apply_edits(doc, edits: list[dict]) -> tuple[dict[int, tuple[int, object]], list[int]]:
    """Applies edit rows in order. Returns the changed objects and how much each edit changed."""
    pages, changed, counts = doc.pages(), {}, []
    for e in edits:
        if e.get("kind") not in KINDS:
            raise PdfError("edit", f"no edit of kind {e.get('kind')!r}")
        if e.get("page_index") is None:
            raise PdfError("edit", "an edit has no page_index")
        page = pages[e["page_index"]] if 0 <= e["page_index"] < len(pages) else None
        if page is None:
            counts.append(0)
            continue
        fonts, before = page_fonts(doc, page), parse_content(doc.page_content(page))
        kind, search, to = e["kind"], e.get("search") or "", e.get("replacement") or ""
        if kind in ("replace", "replace_first"):
            after, n = replace_text(before, fonts, search, to, bool(e.get("ignore_case")), kind == "replace")
        elif kind in ("compress", "decompress"):
            changed |= set_content(doc, page, before, kind == "compress")
            counts.append(1)
            continue
        elif kind == "insert_instructions":
            new = parse_content(to.encode("latin-1"))
            after, n = insert(before, new, search or "end", int(number(e.get("index")))), len(new)
        elif kind in ("remove_instructions", "replace_instructions"):
            at, k = (max(0, int(v)) for v in e["numbers"])
            new = parse_content(to.encode("latin-1")) if kind == "replace_instructions" else []
            after, n = before[:at] + new + before[at + k :], len(before[at : at + k])
        elif kind == "delete":
            after, n = delete_text(before, fonts, search, bool(e.get("ignore_case")))
        elif kind == "modify":
            after, n = modify_first(before, fonts, e.get("font_name") or "", search, to)
        elif kind == "add":
            font = e.get("font_name") or next(iter(fonts), "F1")
            raw = (fonts.get(font) or Font()).encode(to)
            after, n = (insert(before, add_text(raw, number(e.get("x")), number(e.get("y")), font, number(e.get("font_size"), 12.0) or 12.0, e.get("color"))), 1) if raw is not None else (before, 0)
        elif kind in ("rectangle", "line", "ellipse"):
            after, n = insert(before, drawn(kind, e["numbers"], e.get("color") or (0, 0, 0))), 1
        elif kind == "optimize":
            after = optimize(before)
            n = len(before) - len(after)
        elif kind == "delete_image":
            after = without_image(before, search)
            n = len(before) - len(after)
        elif kind == "replace_in_object":
            after, n = _replace_in_object(before, fonts, int(number(e.get("index"))), to)
        elif kind == "replace_image":
            n, new = replace_image(doc, page, search, _image(e))
            changed |= new
            counts.append(n)
            continue
        else:  # add_image
            name, new = add_image(doc, page, _image(e))
            changed |= new
            x, y, w, h = e["numbers"]
            after, n = insert(_closed(before), [Instruction("q"), Instruction("cm", [w, 0, 0, h, x, y]), Instruction("Do", [Name(name)]), Instruction("Q")]), 1
        if n:
            changed |= set_content(doc, page, after)
        counts.append(n)
    return changed, counts


def rewritten(doc) -> bytes:
    """The file as a whole, without what is not referred to by number any more."""
    return write_file({n: (ref.gen, v) for n, (ref, v) in doc.objects.items() if not (isinstance(v, Stream) and v.dict.get("Type") in ("XRef", "ObjStm"))}, doc.trailer, doc.version or "1.7")


def revised(data: bytes, doc, changed: dict, freed: list[int] = ()) -> bytes:
    return append_revision(data, changed, list(freed), doc.trailer, doc.start, max([*doc.objects, 0]) + 1)
