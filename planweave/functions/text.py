"""Formatting and parsing of quantities and labels, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INCH, FOOT2 = 0.0254, 0.09290304


def length_text(v: Column, units: str = "m") -> Column:
    """``3.20 m`` or feet and inches; 12 inches carry over."""
    if units != "ft":
        return F.format_string("%.2f m", F.bround(v, 2))
    total = v / INCH
    feet = F.floor(total / 12)
    inches = F.bround(total - feet * 12).cast("long")
    carry = inches == 12
    return F.format_string("%d'%d\"", feet + F.when(carry, 1).otherwise(0), F.when(carry, 0).otherwise(inches))


def area_text(v: Column, units: str = "m") -> Column:
    if units == "ft":
        return F.concat(F.bround(v / FOOT2).cast("long").cast("string"), F.lit(" ft²"))
    return F.format_string("%.2f m²", F.bround(v, 2))


def dms(deg: Column) -> Column:
    """Degrees, minutes and seconds; 60 seconds and 60 minutes carry over."""
    d = deg.cast("int")
    minutes = (deg - d) * 60
    m = minutes.cast("int")
    s = F.bround((minutes - m) * 60).cast("int")
    m2 = m + F.when(s == 60, 1).otherwise(0)
    d2 = d + F.when(m2 == 60, 1).otherwise(0)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(d2.cast("string"), F.lit("°"), two(F.when(m2 == 60, 0).otherwise(m2)), F.lit("'"), two(F.when(s == 60, 0).otherwise(s)), F.lit('"'))


def quantity(v: Column) -> Column:
    """Number of a text with an optional metre suffix, null where there is none."""
    s = F.replace(F.lower(F.trim(v.cast("string"))), F.lit(","), F.lit("."))
    return F.regexp_replace(s, r"( meters| metres| m|m)$", "").try_cast("double")


def whole(v: Column) -> Column:
    """Quantity rounded half to even."""
    return F.bround(quantity(v)).cast("long")


def parse_vector(v: Column, n: int = 3) -> Column:
    """``a,b,c`` or ``a;b;c``; null if the count or a number is wrong."""
    parts = F.transform(F.split(v, "[,;]"), lambda x: F.trim(x).try_cast("double"))
    return F.when((F.size(parts) == n) & F.forall(parts, lambda x: x.isNotNull()), parts)


def next_sheet(sheet: Column) -> Column:
    """The sheet after this one: the last run of digits plus one, zero padding kept."""
    head = F.regexp_extract(sheet, r"^(.*?)(\d+)(\D*)$", 1)
    digits = F.regexp_extract(sheet, r"^(.*?)(\d+)(\D*)$", 2)
    tail = F.regexp_extract(sheet, r"^(.*?)(\d+)(\D*)$", 3)
    number = (digits.try_cast("long") + 1).cast("string")
    padded = F.when(F.length(number) >= F.length(digits), number).otherwise(F.lpad(number, F.length(digits), F.lit("0")))
    return F.when(sheet.isNull() | (sheet == ""), "A-02").when(digits == "", F.concat(sheet, F.lit("-2"))).otherwise(F.concat(head, padded, tail))


def escape_markup(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


WINDS = {"en": ["N", "NE", "E", "SE", "S", "SW", "W", "NW"], "es": ["N", "NE", "E", "SE", "S", "SO", "O", "NO"]}


def compass(degrees: Column, lang: str = "en") -> Column:
    """Eight-wind letter of a bearing; empty where the bearing is unknown."""
    names = F.array(*[F.lit(x) for x in WINDS.get(lang, WINDS["en"])])
    return F.when(degrees.isNull(), "").otherwise(F.element_at(names, (F.pmod(F.bround(degrees / 45), F.lit(8)) + 1).cast("int")))


def facing(dx: Column, dy: Column, side: Column, north: Column, lang: str = "en") -> Column:
    """Where one looks at a wall of direction (dx, dy) from its ``side``; empty without north."""
    look_x, look_y = dy * side, -dx * side
    return compass(F.pmod(F.degrees(F.atan2(look_x, look_y)) - north, F.lit(360.0)), lang)


# Advance widths of Helvetica and Helvetica-Bold, characters 32 to 126 (fixed values of the font).
REGULAR = [278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556, 1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556, 333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584]
BOLD = [278, 333, 474, 556, 556, 889, 722, 238, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 333, 333, 584, 584, 584, 611, 975, 722, 722, 722, 722, 667, 611, 778, 722, 278, 556, 722, 611, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 333, 278, 333, 584, 556, 333, 556, 611, 556, 611, 556, 333, 611, 611, 278, 278, 556, 278, 889, 611, 611, 611, 611, 389, 556, 333, 611, 556, 778, 556, 556, 500, 389, 280, 389, 584]
OTHER = 556


def text_width(s: Column, size: Column | float, bold: bool = False) -> Column:
    """Width of a text in points: the characters of each width are counted by taking them out, so a
    text of any length stays one value."""
    by_width: dict[int, str] = {}
    for code, width in enumerate(BOLD if bold else REGULAR, 32):
        by_width[width] = by_width.get(width, "") + chr(code)
    total = F.length(s) * OTHER
    for width, characters in by_width.items():
        if width != OTHER:
            total = total + (F.length(s) - F.length(F.translate(s, characters, ""))) * (width - OTHER)
    return total * (size if isinstance(size, Column) else F.lit(float(size))) / 1000


def document_width(s: Column, size: float, bold: bool = False) -> Column:
    """``text_width`` of whole documents: one look at each byte instead of a pass of the text for every
    width there is. Null for null."""
    table = np.full(256, OTHER, np.int64)
    table[32 : 32 + len(REGULAR)] = BOLD if bold else REGULAR
    table[0x80:0xC0] = 0  # only the first byte of a character counts

    def units(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else int(table @ np.bincount(np.frombuffer(t, np.uint8), minlength=256)) for t in texts], dtype="Int64")

    return F.pandas_udf(units, "long")(s.cast("binary")) * F.lit(float(size)) / 1000


def first_key(meta: Column, keys: list[str]) -> Column:
    """First non-empty value among the keys of a map."""
    return F.coalesce(*[F.nullif(F.try_element_at(meta, F.lit(k)), F.lit("")) for k in keys])


def label(table: dict[str, dict[str, str]], lang: Column, key: Column) -> Column:
    """Text of a key in a language, else in English, else the key itself (a small fixed table)."""
    flat = F.create_map(*[F.lit(x) for la, rows in table.items() for k, v in rows.items() for x in (f"{la}/{k}", v)])
    return F.coalesce(F.try_element_at(flat, F.concat(lang, F.lit("/"), key)), F.try_element_at(flat, F.concat(F.lit("en/"), key)), key)


def chunk_count(frames: Column, views: int = 24, overlap: int = 4) -> Column:
    """Hopping windows needed for a walk: the first holds ``views``, each later one adds what doesn't overlap."""
    step = max(1, views - max(1, min(overlap, views - 1)))
    return F.when(frames <= 0, 0).otherwise(1 + F.greatest(F.lit(0), F.ceil((frames - views) / step))).cast("long")


def shape_error(error_percent: Column, scale: Column) -> Column:
    """Area error left after the scale is put right; an area error without a scale is refused."""
    value = ((1 + error_percent / 100) * scale * scale - 1) * 100
    return F.when(error_percent.isNotNull() & scale.isNull(), F.raise_error(F.lit("an area error needs its scale")).cast("double")).otherwise(value)
