"""Code points of single-byte encodings and glyph names, from Python's codecs and rules where there is one."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Accents of glyph names, as combining characters.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
GREEK = ("Alpha", "Beta", "Gamma", "Delta", "Epsilon", "Zeta", "Eta", "Theta", "Iota", "Kappa", "Lambda", "Mu", "Nu", "Xi", "Omicron", "Pi", "Rho", "Sigma", "Tau", "Upsilon", "Phi", "Chi", "Psi", "Omega")
#: Glyph names that no rule gives. Fixed values.
NAMED = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "quoteleft": "‘", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~",
    "exclamdown": "¡", "cent": "¢", "sterling": "£", "fraction": "⁄", "yen": "¥", "florin": "ƒ", "section": "§", "currency": "¤", "quotedblleft": "“", "guillemotleft": "«", "guilsinglleft": "‹", "guilsinglright": "›", "fi": "ﬁ", "fl": "ﬂ", "endash": "–", "dagger": "†", "daggerdbl": "‡", "periodcentered": "·", "paragraph": "¶", "bullet": "•", "quotesinglbase": "‚", "quotedblbase": "„", "quotedblright": "”", "guillemotright": "»", "ellipsis": "…", "perthousand": "‰", "questiondown": "¿",
    "grave": "`", "acute": "´", "circumflex": "ˆ", "tilde": "˜", "macron": "¯", "breve": "˘", "dotaccent": "˙", "dieresis": "¨", "ring": "˚", "cedilla": "¸", "hungarumlaut": "˝", "ogonek": "˛", "caron": "ˇ", "emdash": "—", "AE": "Æ", "ordfeminine": "ª", "Lslash": "Ł", "Oslash": "Ø", "OE": "Œ", "ordmasculine": "º", "ae": "æ", "dotlessi": "ı", "lslash": "ł", "oslash": "ø", "oe": "œ", "germandbls": "ß", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ",
    "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "onehalf": "½", "onequarter": "¼", "threequarters": "¾", "multiply": "×", "divide": "÷", "minus": "−", "plusminus": "±", "logicalnot": "¬", "brokenbar": "¦", "copyright": "©", "registered": "®", "trademark": "™", "degree": "°", "mu": "µ", "Euro": "€", "nbspace": "\xa0", "sfthyphen": "\xad",
    "notequal": "≠", "infinity": "∞", "lessequal": "≤", "greaterequal": "≥", "partialdiff": "∂", "summation": "∑", "product": "∏", "integral": "∫", "radical": "√", "approxequal": "≈", "lozenge": "◊", "arrowleft": "←", "arrowup": "↑", "arrowright": "→", "arrowdown": "↓", "ff": "ﬀ", "ffi": "ﬃ", "ffl": "ﬄ", "apple": "\uf8ff", "sigma1": "ς", "theta1": "ϑ", "phi1": "ϕ", "omega1": "ϖ", "Upsilon1": "ϒ",
}
#: StandardEncoding from 0xA1 on: glyph names by code. Fixed values.
STANDARD_HIGH = {0xA1: "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl", 0xB1: "endash dagger daggerdbl periodcentered", 0xB6: "paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand", 0xBF: "questiondown", 0xC1: "grave acute circumflex tilde macron breve dotaccent dieresis", 0xCA: "ring cedilla", 0xCD: "hungarumlaut ogonek caron emdash", 0xE1: "AE", 0xE3: "ordfeminine", 0xE8: "Lslash Oslash OE ordmasculine", 0xF1: "ae", 0xF5: "dotlessi", 0xF8: "lslash oslash oe germandbls"}
#: PDFDocEncoding where it differs from Latin-1. Fixed values.
PDFDOC = {0x18: "˘ˇˆ˙˝˛˚˜", 0x80: "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž", 0xA0: "€"}
#: Symbol: the Greek letters by Latin key, then the upper half. Fixed values; "\0" marks codes without a character.
SYMBOL_KEYS = dict(zip("ABGDEZHQIKLMNXOPRSTUFCYW", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", strict=True)) | dict(zip("abgdezhqiklmnxoprstufcyw", "αβγδεζηθικλμνξοπρστυφχψω", strict=True)) | dict(zip("JVjvJ", "ϑςϕϖϑ", strict=True)) | {'"': "∀", "$": "∃", "'": "∋", "*": "∗", "-": "−", "@": "≅", "\\": "∴", "^": "⊥"}
SYMBOL_HIGH = "€ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…⏐⎯↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈®©™∑⎛⎜⎝⎡⎢⎣⎧⎨⎩⎪\0〉∫⌠⎮⌡⎞⎟⎠⎤⎥⎦⎫⎬⎭"


def _sparse(base: dict[int, str], more: dict[int, str]) -> dict[int, str]:
    return base | {start + i: c for start, run in more.items() for i, c in enumerate(run)}


def _codec(name: str) -> dict[int, str]:
    out = {}
    for b in range(32, 256):
        c = bytes([b]).decode(name, "ignore")
        if c and not ("\x7f" <= c <= "\x9f"):
            out[b] = c
    return out


@lru_cache(maxsize=None)
def table(name: str) -> dict[int, str]:
    """Characters by code."""
    ascii_codes = {b: chr(b) for b in range(32, 127)}
    if name == "WinAnsiEncoding":
        return {b: "•" for b in range(0x7F, 0x100)} | _codec("cp1252") | {0xA0: " ", 0xAD: "-"}
    if name == "MacRomanEncoding":
        return _codec("mac_roman") | {0xCA: " "}
    if name == "PDFDocEncoding":
        return _sparse(_codec("latin-1"), PDFDOC)
    if name == "Symbol":
        return {b: SYMBOL_KEYS.get(c, c) for b, c in ascii_codes.items()} | {0xA0 + i: c for i, c in enumerate(SYMBOL_HIGH) if c != "\0"}
    if name == "ZapfDingbats":
        return {32: " "} | {b: chr(0x2700 + b - 0x20) for b in range(0x21, 0x7F)} | {b: chr(0x2761 + b - 0xA1) for b in range(0xA1, 0xA8)} | {b: chr(0x2460 + b - 0xAC) for b in range(0xAC, 0xB6)} | {b: chr(0x2776 + b - 0xB6) for b in range(0xB6, 0xD4)} | {b: chr(0x2794 + b - 0xD4) for b in range(0xD4, 0xFF)}
    own = ascii_codes | {0x27: "’", 0x60: "‘"}
    return own | {start + i: NAMED[g] for start, run in STANDARD_HIGH.items() for i, g in enumerate(run.split())}


@lru_cache(maxsize=4096)
def glyph(name: str) -> str | None:
    """Text of a glyph name."""
    base = name.split(".")[0] if not name.startswith(".") else name
    if base in NAMED:
        return NAMED[base] or None
    if len(base) == 1:
        return base
    if base in DIGITS:
        return str(DIGITS.index(base))
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", base):
        return bytes.fromhex(m[1]).decode("utf-16-be", "replace")
    if m := re.fullmatch(r"u([0-9A-F]{4,6})", base):
        return chr(int(m[1], 16)) if int(m[1], 16) <= 0x10FFFF else None
    if base.capitalize() in GREEK:
        c = unicodedata.lookup(f"GREEK CAPITAL LETTER {'LAMDA' if base.lower() == 'lambda' else base.upper()}")
        return c if base[0].isupper() else c.lower()
    if base[0].isalpha() and base[1:] in ACCENTS:
        return unicodedata.normalize("NFC", base[0] + ACCENTS[base[1:]])
    if "_" in base:
        parts = [glyph(p) for p in base.split("_")]
        return "".join(parts) if all(parts) else None
    return None


def private_use(text: str) -> str:
    """U+F000 to U+F0FF, where symbol fonts put their codes, as Symbol has them."""
    if not any("\uf000" <= c <= "\uf0ff" for c in text):
        return text
    symbol = table("Symbol")
    return "".join(symbol.get(ord(c) - 0xF000, c) if "\uf000" <= c <= "\uf0ff" else c for c in text)
