"""Scalar rules for names, rotations, sizes, titles and numbers, each a Column to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import WS, trim_wide

#: The characters that count as Chinese or Japanese in titles.
CJK = r"\u3040-\u30ff\u4e00-\u9fff\u30fb"


def is_pdf(name: Column, mime: Column) -> Column:
    """By media type, or else by the end of the name; null never raises the answer."""
    return F.coalesce(mime == "application/pdf", F.lit(False)) | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def maybe_encrypted(content: Column) -> Column:
    """The bytes hold an encryption token: a candidate, for false alarms exist."""
    return F.contains(content, F.lit(b"/Encrypt"))


def pdf_version(content: Column) -> Column:
    """The header from ``%PDF-`` to the line's end, from the first place where it stands."""
    found = F.regexp_extract(F.decode(content, "ISO-8859-1"), r"(%PDF-[^\r\n]*)", 1)
    return F.when(found == "", "%PDF-1.7").otherwise(found)


def text_or_null(c: Column) -> Column:
    """Blank text is null; other text stays untrimmed."""
    return F.when(F.length(trim_wide(c)) > 0, c)


def normalize_rotation(degrees: Column) -> Column:
    """To the nearest multiple of 90 (halves up), from 0 to 270."""
    return F.pmod((F.floor(degrees / 90 + 0.5) * 90).cast("bigint"), F.lit(360)).cast("int")


def output_name(name: Column, suffix: Column) -> Column:
    base = F.regexp_replace(F.coalesce(name, F.lit("document")), r"(?i)\.pdf$", "")
    return F.concat(base, suffix, F.lit(".pdf"))


def part_suffix(part_no: Column) -> Column:
    return F.format_string("-%02d", part_no)


def clamp_page(page: Column, pages: Column) -> Column:
    """Into 1 to ``pages``; no page, or a number that isn't finite, gives 1."""
    value = page.cast("double")
    odd = (pages <= 0) | F.isnan(value) | (F.abs(value) == float("inf"))
    whole = F.when(odd, F.lit(1.0)).otherwise(F.least(pages.cast("double"), F.greatest(F.lit(1.0), value)))
    return F.when(odd, 1).otherwise(whole.cast("bigint")).cast("bigint")


def fit_scale(width: Column, height: Column, mode: str, box_width: float, box_height: float, padding: float = 0) -> Column:
    """Scale by which a page fits into a box, by its width or as a whole."""
    across = F.lit(float(max(1, box_width - 2 * padding))) / width
    return across if mode == "width" else F.least(across, F.lit(float(max(1, box_height - 2 * padding))) / height)


def format_file_size(size: Column) -> Column:
    value = size.cast("double")
    out = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0), "—")
    out = out.when(value < 1024, F.concat(value.cast("bigint").cast("string"), F.lit(" B")))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(value < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", value / 1024.0**power))
    return out.otherwise(F.format_string("%.1f TB", value / 1024.0**4))


def normalize_digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def normalize_title(title: Column) -> Column:
    """A heading as it should read: plain digits, tight numbers, no stray spaces between Chinese or
    Japanese characters, one space between the number and the words."""
    t = trim_wide(normalize_digits(title))
    t = F.regexp_replace(t, f"第{WS}*([0-9]+){WS}*章", "第$1章")
    t = F.regexp_replace(t, f"([0-9]){WS}+\\.", "$1.")
    t = F.regexp_replace(t, f"\\.{WS}+([0-9])", ".$1")
    t = F.regexp_replace(t, f"(?<=[{CJK}]) (?=[{CJK}])", "")
    t = F.regexp_replace(t, f"{WS}{{2,}}", " ")
    t = F.regexp_replace(t, f"^(第[0-9]+章|[0-9]+(?:\\.[0-9]+)*)(?=[^{WS[1:-1]}.0-9])", "$1 ")
    return trim_wide(t)


def plain_title(title: Column) -> Column:
    """A heading of running text: no space before a full stop, single spaces. A sentence may end before a number,
    so numbers stay as they stand, unlike in ``normalize_title``."""
    t = F.regexp_replace(title, "[\\t\\n\\f\\r ]+\\.", ".")
    t = F.regexp_replace(t, "[\\t\\n\\f\\r ]{2,}", " ")
    return F.regexp_replace(t, r"^\p{Zs}+|\p{Zs}+$", "")


def is_toc_leader(line: Column) -> Column:
    """A line of a table of contents: its words and page are joined by dots or dashes."""
    return line.rlike(rf"\.{{4,}}|…|・{{4,}}|[-–—]{{3,}}|(?:\.{WS}){{3,}}")


def leading_numbers(title: Column) -> Column:
    """array<double> of the number that a title begins with, or null."""
    t = trim_wide(normalize_digits(title))
    chapter, dotted = F.regexp_extract(t, "^第([0-9]+)章", 1), F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)*)", 1)
    return F.when(chapter != "", F.array(chapter.try_cast("double"))).when(
        dotted != "", F.transform(F.split(dotted, r"\."), lambda x: x.try_cast("double"))
    )
