"""Positioned text: the text state machine over a page's instructions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .content import Instruction, parse_content
from .fonts import Font, page_fonts, read_font
from .objects import IDENTITY, Stream, multiply, number, numbers, shifted, transform

DEEPEST_FORM = 12


@dataclass(slots=True)
class TextState:
    ctm: tuple = IDENTITY
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 100.0
    leading: float = 0.0
    font: str = ""
    size: float = 0.0
    mode: int = 0
    rise: float = 0.0


@dataclass(slots=True)
class TextElement:
    text: str
    x: float
    y: float
    width: float
    height: float
    font: str
    size: float
    mode: int
    char_space: float
    word_space: float
    matrix: tuple
    raw: bytes


@dataclass
class TextMachine:
    """Runs instructions; elements gets a row for each string shown, blocks the text of each text object."""

    fonts: dict[str, Font]
    forms: object = None  # gives the form that Do names: its instructions, fonts and matrix
    gap: float | None = None  # adjustments below it count as a space
    elements: list[TextElement] = field(default_factory=list)
    blocks: list[tuple[str, float, float, str, float]] = field(default_factory=list)

    def run(self, instructions: list[Instruction], state: TextState | None = None, depth: int = 0) -> None:
        s, stack = state or TextState(), []
        matrix = line = IDENTITY
        block: list | None = None
        none, steps = Font(), {}

        def show(raw: bytes) -> None:
            nonlocal matrix
            font = self.fonts.get(s.font) or none
            codes = font.split(raw)
            text = font.said(codes)
            scale = s.scale / 100
            here = multiply(matrix, s.ctm)
            at = transform(here, 0, s.rise)
            # How far each code goes on, worked out once for each that occurs with this state.
            state = (id(font), s.size, s.char_space, s.word_space, scale)
            forth = steps.get(state)
            if forth is None:
                forth = steps[state] = {}
            try:
                far = sum([forth[c] for c in codes])
            except KeyError:
                for c in set(codes):
                    forth[c] = (font.width(c) / 1000 * s.size + s.char_space + (s.word_space if c == b" " else 0)) * scale
                far = sum([forth[c] for c in codes])
            matrix = shifted(matrix, far, 0)
            if text:
                whole = multiply((s.size * scale, 0, 0, s.size, 0, s.rise), here)
                end = transform(multiply(matrix, s.ctm), 0, s.rise)
                width = ((end[0] - at[0]) ** 2 + (end[1] - at[1]) ** 2) ** 0.5
                height = abs(s.size) * (whole[2] ** 2 + whole[3] ** 2) ** 0.5 / max(abs(s.size), 1e-9)
                self.elements.append(TextElement(text, *at, width, height, s.font, s.size, s.mode, s.char_space, s.word_space, whole, raw))
                if block is not None:
                    if not block[0]:
                        block[1:] = [*at, s.font, s.size]
                    block[0] += text

        def next_line(x: float, y: float) -> None:
            nonlocal matrix, line
            line = matrix = shifted(line, x, y)

        for i in instructions:
            op, a = i.op, i.args
            if op == "q":
                stack.append((replace(s), matrix, line))
            elif op == "Q":
                if stack:
                    s, matrix, line = stack.pop()
            elif op == "cm":
                if (m := numbers(a, 6)) is not None:
                    s.ctm = multiply(m, s.ctm)
            elif op == "BT":
                matrix = line = IDENTITY
                block = ["", 0.0, 0.0, "", 0.0]
            elif op == "ET":
                if block is not None and block[0]:
                    self.blocks.append(tuple(block))
                block = None
            elif op == "Tf" and len(a) >= 2:
                s.font, s.size = str(a[0]) if isinstance(a[0], str) else "", number(a[1])
            elif op in ("Tc", "Tw", "Tz", "TL", "Ts", "Tr") and a:
                value = number(a[0])
                setattr(s, {"Tc": "char_space", "Tw": "word_space", "Tz": "scale", "TL": "leading", "Ts": "rise", "Tr": "mode"}[op], int(value) if op == "Tr" else value)
            elif op in ("Td", "TD") and len(a) >= 2:
                if op == "TD":
                    s.leading = -number(a[1])
                next_line(number(a[0]), number(a[1]))
            elif op == "Tm":
                if (m := numbers(a, 6)) is not None:
                    matrix = line = m
            elif op == "T*":
                next_line(0, -s.leading)
            elif op == "Tj":
                if a and isinstance(a[-1], bytes):
                    show(a[-1])
            elif op in ("'", '"'):
                if op == '"' and len(a) >= 3:
                    s.word_space, s.char_space = number(a[0]), number(a[1])
                next_line(0, -s.leading)
                if a and isinstance(a[-1], bytes):
                    show(a[-1])
            elif op == "TJ" and a and isinstance(a[-1], list):
                for x in a[-1]:
                    if isinstance(x, bytes):
                        show(x)
                    elif isinstance(x, (int, float)):
                        matrix = shifted(matrix, -x / 1000 * s.size * s.scale / 100, 0)
                        if self.gap is not None and x < self.gap and block is not None and block[0]:
                            block[0] += " "
            elif op == "Do" and self.forms is not None and a and depth < DEEPEST_FORM:
                form = self.forms(str(a[0]))
                if form is not None:
                    body, fonts, m = form
                    outer, self.fonts = self.fonts, self.fonts | fonts
                    self.run(body, replace(s, ctm=multiply(m, s.ctm)), depth + 1)
                    self.fonts = outer


def form_reader(doc, resources: dict):
    """What Do names, if it is a form."""

    def form(name: str):
        x = doc.get(doc.dict_of(resources.get("XObject")).get(name))
        if not isinstance(x, Stream) or x.dict.get("Subtype") != "Form":
            return None
        own = doc.dict_of(doc.dict_of(x.dict.get("Resources")).get("Font"))
        m = doc.get(x.dict.get("Matrix"))
        return parse_content(doc.content(x)), {k: read_font(doc, v) for k, v in own.items()}, numbers(m, 6) if isinstance(m, list) and numbers(m, 6) else IDENTITY

    return form


def page_text(doc, page, forms: bool = False, gap: float | None = None) -> TextMachine:
    machine = TextMachine(page_fonts(doc, page), form_reader(doc, doc.resources(page)) if forms else None, gap)
    machine.run(parse_content(doc.page_content(page)))
    return machine
