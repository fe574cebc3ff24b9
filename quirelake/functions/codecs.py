"""Strings, names, hex, keys, numbers and labels of files as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPES = (("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))


def escape_literal(text: Column) -> Column:
    for raw, written in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape_literal(text: Column) -> Column:
    """Undoes escapes of a literal string in one pass: letters, octal codes, line continuations; a backslash before anything else goes."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\(?:[0-7]{1,3}|\r\n|.)|[^\\]+"), F.lit(0))

    def plain(part: Column) -> Column:
        rest = F.substring(part, 2, 3)
        out = F.when(~part.startswith("\\"), part).when(rest.rlike("^[0-7]"), F.chr(F.conv(rest, 8, 10).cast("bigint")))
        for raw, written in ESCAPES[3:]:
            out = out.when(rest == written[1:], F.lit(raw))
        return out.when(rest.isin("\n", "\r", "\r\n"), F.lit("")).otherwise(rest)

    return F.array_join(F.transform(parts, plain), "")


def escape_name(text: Column) -> Column:
    """#xx for bytes that a name can't have."""
    special = "#()<>[]{}/% \t\n\r\f"
    out = text
    for c in special:
        out = F.replace(out, F.lit(c), F.lit(f"#{ord(c):02X}"))
    return out


def unescape_name(text: Column) -> Column:
    """Undoes #xx byte by byte, so that names in UTF-8 come back whole; bytes that are no UTF-8 become the replacement character."""
    parts = F.regexp_extract_all(text, F.lit("(?s)#[0-9A-Fa-f]{2}|#|[^#]+"), F.lit(0))
    each = F.transform(parts, lambda p: F.when(p.rlike("^#[0-9A-Fa-f]{2}$"), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8"))))
    return F.make_valid_utf8(F.unhex(F.array_join(each, "")).cast("string"))


def from_hex(text: Column) -> Column:
    """Bytes of hex digits; others are passed over, a single last digit counts as followed by 0."""
    digits = F.regexp_replace(text, "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def big_endian(data: Column) -> Column:
    return F.conv(F.hex(data), 16, 10).cast("decimal(20,0)")


def latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def latin1_bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def utf16(data: Column) -> Column:
    return F.decode(data, "UTF-16BE")


def key(num: Column, gen: Column) -> Column:
    return F.concat_ws(" ", num.cast("string"), gen.cast("string"))


def key_parts(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, " ")
    return F.try_element_at(parts, F.lit(1)).cast("int"), F.try_element_at(parts, F.lit(2)).cast("int")


def show_number(x: Column) -> Column:
    """Whole numbers without a point, others with six digits at most; null stays null."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull(), None).when(whole, x.cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", x), "\\.?0+$", ""))


def soft_number(text: Column) -> Column:
    """What is no number is 0."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def file_size(n: Column) -> Column:
    """B, KB or MB, cut off."""
    shown = lambda v, unit: F.concat(v.cast("bigint").cast("string"), F.lit(f" {unit}"))
    return F.when(n < 1024, shown(n, "B")).when(n < 1024 * 1024, shown(F.floor(n / 1024), "KB")).otherwise(shown(F.floor(n / (1024 * 1024)), "MB"))


def date_string(ts: Column) -> Column:
    return F.date_format(ts, "'D:'yyyyMMddHHmmss")


def ucs2_map(ordering: Column) -> Column:
    """The map from a character collection to UCS-2."""
    return F.when(ordering.isin("GB1", "CNS1", "Japan1", "Korea1"), F.concat(F.lit("Adobe-"), ordering, F.lit("-UCS2")))


def symbol_font(name: Column) -> Column:
    return F.upper(name).rlike("WINGDING|WEBDING|DINGBAT|SYMBOL")


def math_encoding(name: Column) -> Column:
    """Encoding of the classic mathematical fonts by name."""
    up = F.regexp_replace(F.upper(name), "^[A-Z]{6}\\+", "")
    return F.when(up.rlike("^CMEX"), "CMEX").when(up.rlike("^(CMSY|CMBSY)"), "CMSY").when(up.rlike("^(CMMI|CMMIB)"), "CMMI").when(up.rlike("^(CMR|CMBX|CMTI|CMSS|CMTT)"), "CMR")


def identity_map(name: Column) -> Column:
    return name.isin("Identity-H", "Identity-V")


def predefined_map(name: Column) -> Column:
    """Names of the maps that the format defines, by their form: an encoding, and the direction of writing."""
    known = "GBpc-EUC|GB-EUC|GBK-EUC|GBKp-EUC|GBK2K|UniGB-(UCS2|UTF16)|B5pc|HKscs-B5|ETen-B5|ETenms-B5|CNS-EUC|UniCNS-(UCS2|UTF16)|83pv-RKSJ|90ms-RKSJ|90msp-RKSJ|90pv-RKSJ|Add-RKSJ|EUC|Ext-RKSJ|UniJIS-(UCS2|UTF16)|UniJIS-UCS2-HW|KSC-EUC|KSCms-UHC|KSCms-UHC-HW|KSCpc-EUC|UniKS-(UCS2|UTF16)|Identity"
    return name.rlike(f"^(({known})-[HV]|H|V)$")


def cjk_font(name: Column) -> Column:
    """Names of the usual Chinese, Japanese and Korean families."""
    return F.upper(F.regexp_replace(name, "[ -]", "")).rlike("SIMSUN|SIMHEI|KAITI|FANGSONG|MINGLIU|MSGOTHIC|MSMINCHO|MSPGOTHIC|MSPMINCHO|MEIRYO|BATANG|GULIM|DOTUM|MALGUN|HEITI|SONGTI|MINCHO|NOTOSANSCJK|SOURCEHAN")


def has_private_use(text: Column) -> Column:
    """Characters of the private use area."""
    return text.rlike("[\\x{E000}-\\x{F8FF}]")


def has_special(text: Column) -> Column:
    """Control characters, and the replacement character."""
    return text.rlike("[\\x{0000}-\\x{0008}\\x{000E}-\\x{001F}\\x{007F}-\\x{009F}\\x{FFFD}]")


def is_present(value: Column) -> Column:
    """Neither null nor empty nor the null of a file."""
    return F.coalesce((value != "") & (value != "null"), F.lit(False))


#: Classes of characters in order of priority.
CLASSES = (("cjk", "[\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}]"), ("kana", "[\\x{3040}-\\x{30FF}]"), ("hangul", "[\\x{AC00}-\\x{D7AF}]"), ("accented", "[\\x{00C0}-\\x{024F}]"), ("digits", "[0-9]"), ("letters", "[A-Za-z]"))


def character_counts(text: Column) -> dict[str, Column]:
    return {name: F.regexp_count(text, F.lit(pattern)) for name, pattern in CLASSES}


def character_label(text: Column, least: float = 0.05) -> Column:
    """The first class that makes up this share of the text, else other."""
    out, n = F, F.greatest(F.length(text), F.lit(1))
    for name, count in character_counts(text).items():
        out = out.when(count / n >= least, F.lit(name))
    return out.otherwise(F.lit("other"))


def fits_codespace(code: Column, low: bytes, high: bytes) -> Column:
    """Byte by byte, for codes as binary."""
    byte = lambda i: F.conv(F.hex(F.substring(code, i + 1, 1)), 16, 10).cast("int")
    out = F.octet_length(code) == len(low)
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        out &= byte(i).between(a, b)
    return out
