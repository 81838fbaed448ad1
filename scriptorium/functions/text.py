"""Column functions on text: typed numbers, line classes, escapes, file and sheet names, confusable codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of a typed number and of the classes of a line.
NUMBER = r"^([$€£¥₹])?\s?(-)?(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?(%)?$"
KEY_VALUE = r"^\s*([^:=]{1,40}?)\s*[:=]\s*(.*)$"
BULLET = r"^\s*(?:[-•*·‣▪–]|\(?\d{1,3}[.)]|[a-zA-Z][.)])\s+"
ORDERED = r"^\s*\(?\d{1,3}[.)]\s+"
CHECKBOX = r"^\s*(\[\s?[xX✓✔]?\s?\]|[☐☑☒□■])\s*"
NUMBER_TOKEN = r"\d[\d,./:-]*\d|\d"
#: Glyph pairs that recognisers confuse, both ways.
CONFUSABLE = ("4Y", "4H", "4A", "4U", "1I", "1l", "17", "0O", "0D", "0Q", "5S", "2Z", "8B", "6G", "6b", "9g", "EF", "UV", "MN", "CG", "PR")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def typed_number(text: Column) -> tuple[Column, Column]:
    """(value, display format) of an unambiguous number, nulls else (STR1, STR2). Leading zeros and more than 15 digits stay
    text; grouped digits give #,##0; a percentage is divided by 100; a currency is quoted before the format."""
    s = strip(text)
    part = lambda i: F.regexp_extract(s, NUMBER, i)
    whole, dec = part(3), part(4)
    plain = F.replace(whole, F.lit(","), F.lit(""))
    ok = s.rlike(NUMBER) & ~((F.length(whole) > 1) & whole.startswith("0")) & (F.length(plain) <= 15)
    value = F.concat(F.when(part(2) == "-", "-").otherwise(""), plain, F.when(dec != "", F.concat(F.lit("."), dec)).otherwise("")).cast("double")
    body = F.concat(F.when(whole.contains(","), "#,##0").otherwise("0"), F.when(dec != "", F.concat(F.lit("."), F.repeat(F.lit("0"), F.length(dec)))).otherwise(""))
    form = F.when(part(5) == "%", F.concat(body, F.lit("%"))).when(part(1) != "", F.concat(F.lit('"'), part(1), F.lit('"'), body)).otherwise(body)
    return F.when(ok, F.when(part(5) == "%", value / 100).otherwise(value)), F.when(ok, form)


def line_class(text: Column) -> Column:
    """checkbox, bullet, key_value or text, in this order; a key that ends in a figure is a time, not a key (FLT16, FLT18)."""
    key = F.regexp_extract(text, KEY_VALUE, 1)
    return (
        F.when(text.rlike(CHECKBOX), "checkbox").when(text.rlike(BULLET), "bullet")
        .when(text.rlike(KEY_VALUE) & (strip(key) != "") & ~key.rlike(r"\d$"), "key_value").otherwise("text")
    )


def csv_field(text: Column) -> Column:
    """Minimal quoting (STR11)."""
    return F.when(text.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def markdown_cell(text: Column) -> Column:
    """Pipes escaped, line breaks as <br> (STR11)."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def file_name(name: Column) -> Column:
    """A download name: ASCII word characters, blanks and hyphens, 80 at most, `scan` where nothing is left (SNK19)."""
    clean = F.substring(strip(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\w\- ]+", "")), 1, 80)
    return F.when(clean == "", "scan").otherwise(clean)


def circled(n: Column) -> Column:
    """① to ⑳ for 1 to 20, else null (STR9)."""
    return F.when(n.between(1, 20), F.substring(F.lit("①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"), n, 1))


def column_letters(n: Column) -> Column:
    """Spreadsheet letters of a column counted from 1, up to three letters (PRJ21)."""
    letter = lambda k: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (k + 1).cast("int"), 1)
    m = n - 1
    return (
        F.when(m < 26, letter(m)).when(m < 702, F.concat(letter(F.floor((m - 26) / 26)), letter((m - 26) % 26)))
        .otherwise(F.concat(letter(F.floor((m - 702) / 676)), letter(F.floor((m - 702) / 26) % 26), letter((m - 702) % 26)))
    )


def readable_ink(fill: Column) -> Column:
    """White on a dark fill (RRGGBB, luminance under 120), else black (PRJ30)."""
    part = lambda i: F.conv(F.substring(fill, i, 2), 16, 10).cast("int")
    return F.when(0.299 * part(1) + 0.587 * part(3) + 0.114 * part(5) < 120, "FFFFFF").otherwise("000000")
