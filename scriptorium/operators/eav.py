"""Entity, attribute, value rows to one typed row per entity."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The attributes' wordings on the forms at hand besides their printed labels; a parameter of all operators here.
WORDINGS = {
    "invoice_no": ["inv no", "invoice #", "invoice number", "rechnungs nr"],
    "invoice_date": ["inv date", "date of invoice", "rechn datum"],
    "due_date": ["due", "due on", "payable by", "fälligkeit"],
    "total_amount": ["total", "grand total", "amount due", "gesamt"],
    "tax_rate": ["tax %", "vat %", "vat rate", "mwst"],
    "qty": ["qty", "no of units", "stückzahl"],
    "paid": ["paid?", "payment received", "bez"],
    "contact_name": ["contact", "contact person", "attn"],
    "contact_phone": ["phone", "phone no", "tel", "tel nr"],
    "contact_email": ["email", "e mail", "mail"],
    "site_address": ["address", "addr", "adresse"],
    "remarks": ["rem", "notes", "comments", "anmerkung"],
    "meter_no": ["meter #", "meter number", "zähler nr"],
    "reading": ["reading", "reading (kwh)", "stand"],
    "reading_date": ["read on", "date of reading", "abgelesen am"],
    "passed": ["passed", "passed?", "test passed"],
    "weight_kg": ["weight", "gross weight", "gewicht", "wt"],
    "depot": ["depot name", "warehouse", "lager"],
    "delivered_on": ["delivered", "delivered on", "geliefert am"],
    "pallets": ["pallets", "no of pallets", "paletten"],
    "member_no": ["member number", "membership no", "mitgl nr"],
    "member_since": ["joined", "joined on", "beitritt"],
    "fee": ["fee", "yearly fee", "beitrag"],
    "newsletter": ["newsletter?", "wants newsletter", "mailing"],
}
#: Month names by their first letters (folded), English, German and French.
MONTHS = {
    "jan": 1, "jän": 1, "feb": 2, "fév": 2, "fev": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "avr": 4, "may": 5, "mai": 5, "jun": 6, "juin": 6,
    "jul": 7, "juil": 7, "aug": 8, "aoû": 8, "aou": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "déc": 12, "dez": 12,
}
#: What counts as no value, as yes and as no.
NO_VALUE = ["", "-", "—", "n/a", "illegible"]
YES = ["true", "yes", "y", "ja", "j", "oui", "o", "sí", "si", "sì", "sim", "x", "✓", "✔", "✗", "✘", "×", "☑", "☒", "[x]", "1"]
NO = ["false", "no", "n", "nein", "non", "não", "☐", "□", "[ ]", "[]", "0"]
#: Blanks that a form's text can hold, beyond what \s has in Java.
BLANKS = "\t\n\x0b\x0c\r                 　﻿"


#: Marks in keys that count as blanks, and glyphs that recognition confuses, each to the one of its class.
MARKS = ".:_·•…-‐‑‒–—―"
FROM, TO = "01|icf589", "ollletsbg"


def tidy(text: Column) -> Column:
    """Outer blanks cut, inner runs made one blank."""
    flat = F.trim(F.translate(text, BLANKS, " " * len(BLANKS)))
    return F.when(flat.contains("  "), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat)


def key_skeleton(key: Column) -> Column:
    """A key without case, punctuation and confusable glyphs, so that a misread key equals the printed one."""
    bare = tidy(F.translate(F.lower(key), MARKS, " " * len(MARKS)))
    return F.translate(F.replace(bare, F.lit("rn"), F.lit("m")), FROM, TO)


def wording_map(attrs: list[tuple[str, str, str, str]], wordings: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Normalised wording to attribute, from the (attr, dtype, label_en, label_de) rows and `wordings` (WORDINGS if not given)."""
    more = WORDINGS if wordings is None else wordings
    return {w: a for a, _, en, de in attrs for w in [*(x for x in (en, de) if x), a.replace("_", " "), *more.get(a, [])]}


def skeleton_of(wording: str) -> str:
    """`key_skeleton` of one wording, on the driver."""
    bare = re.sub(" +", " ", wording.lower().translate(str.maketrans({c: " " for c in MARKS + BLANKS}))).strip()
    return bare.replace("rn", "m").translate(str.maketrans(FROM, TO))


def wording_table(spark: SparkSession, attrs: list[tuple[str, str, str, str]], wordings: dict[str, list[str]] | None = None) -> DataFrame:
    """_k, attr, dtype: the few skeletons of all wordings. Two attributes whose wordings have one skeleton can't be told apart on
    a form, which is an error."""
    kinds, by = {a: d for a, d, *_ in attrs}, {}
    for w, a in wording_map(attrs, wordings).items():
        if by.setdefault(skeleton_of(w), a) != a:
            raise ValueError(f"{w!r} may mean {by[skeleton_of(w)]} or {a}")
    return literal_table(spark, [(k, a, kinds[a]) for k, a in by.items()], ["_k", "attr", "dtype"])


def unknown_keys(pairs: DataFrame, attrs: DataFrame, wordings: dict[str, list[str]] | None = None) -> DataFrame:
    """key, n: the keys, without case, marks and confusable glyphs, that mean no attribute, and on how many rows; pre-aggregated,
    so a key that holds a third of the rows is one row of each task."""
    words = wording_table(pairs.sparkSession, [tuple(r) for r in attrs.select("attr", "dtype", "label_en", "label_de").collect()], wordings)
    keys = pairs.where("key is not null").groupBy(key_skeleton(F.col("key")).alias("_k")).agg(F.count("*").alias("n"))
    return keys.join(F.broadcast(words.select("_k")), "_k", "left_anti").withColumnRenamed("_k", "key")


#: A number with what may stand around it (lower case): sign or bracket, currency, sign or bracket, figures, unit.
_CODE = r"(?:[$€£]|eur|usd|gbp|chf)"
_NUMBER = rf"^([(−–-]?) ?{_CODE}? ?([(−–-]?) ?([0-9][0-9., ]*?)\)? ?(?:%|{_CODE}|kgs?|pcs?|stk|stck|st|units?|kwh)?\.?\)?$"
_ISO = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"
_SHORT = r"^(\d{1,2}) ?[-/.] ?(\d{1,2}) ?[-/.] ?(\d{4}|\d{2})$"
_DMY = r"^(\d{1,2})(?:st|nd|rd|th|er|\.|º)? (?:de )?(\p{L}+)\.?,? (?:de )?(\d{4}|\d{2})$"
_MDY = r"^(\p{L}+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4}|\d{2})$"


def with_reading(df: DataFrame, raw: str = "raw", dtype: str = "dtype", locale: str = "_locale") -> DataFrame:
    """`df` with `value`: the raw text in the one notation of its dtype, null where it can't be read. Each step is a
    projection of its own, so that every text is matched once and the whole stays within generated code."""
    has = set(df.columns)
    col, lang = F.col, F.lower(F.substring(F.coalesce(F.col(locale), F.lit("en")), 1, 2))
    number, date = col(dtype).isin("decimal", "integer"), col(dtype) == "date"
    months = F.from_json(F.lit(json.dumps(MONTHS)), "map<string,int>")
    us = (F.coalesce(col(locale), F.lit("")) == "en_US") & ~col("_low").contains(".")
    grouped = lambda g: rf"^(?:\d{{1,3}}(?:{g}\d{{3}})+|\d+)"
    x = col("_figures")
    steps = [
        {"_v": tidy(col(raw)), "_lang": lang},
        {"_low": F.lower(col("_v"))},
        # sign|figures of a number; year-month-day of a date, the month perhaps a name
        {"_s": F.when(number, F.regexp_replace("_low", _NUMBER, "$1$2|$3")).when(
            date & col("_low").rlike("^[0-9]"),
            F.when(us, F.regexp_replace("_low", _SHORT, "$3-$1-$2")).otherwise(F.regexp_replace(F.regexp_replace("_low", _SHORT, "$3-$2-$1"), _DMY, "$3-$2-$1")),
        ).when(date, F.regexp_replace("_low", _MDY, "$3-$1-$2"))},
        {"_s": F.when(date & us, F.regexp_replace("_s", _DMY, "$3-$2-$1")).otherwise(col("_s"))},
        {"_sign": F.when(number & col("_s").contains("|"), F.substring_index("_s", "|", 1)), "_figures": F.when(number & col("_s").contains("|"), F.substring_index("_s", "|", -1)),
         "_ymd": F.when(date, F.split("_s", "[-/.]"))},
        {"_point": F.when(col("_lang").isin("de", "nl", "it", "es", "pt"), F.when(x.rlike(grouped(r"\.") + r"(?:,\d+)?$"), F.translate(x, ",.", ".")))
            .when(col("_lang").isin("fr", "ru"), F.when(x.rlike(grouped(" ") + r"(?:,\d+)?$"), F.translate(x, ", ", ".")))
            .otherwise(F.when(x.rlike(grouped(",") + r"(?:\.\d+)?$"), F.translate(x, ",", ""))),
         "_month": F.when(F.size("_ymd") == 3, F.coalesce(F.when(F.length(col("_ymd")[1]) <= 2, col("_ymd")[1]), months[F.substring(col("_ymd")[1], 1, 4)].cast("string"), months[F.substring(col("_ymd")[1], 1, 3)].cast("string")))},
        {"_point": F.regexp_replace(F.when(col("_point").contains("."), F.regexp_replace("_point", r"\.?0+$", "")).otherwise(col("_point")), r"^0+(?=\d)", ""),
         "_date": F.when(col("_month").isNotNull(), F.try_to_date(F.concat_ws("-", F.when(F.length(col("_ymd")[0]) == 2, F.concat(F.lit("20"), col("_ymd")[0])).otherwise(col("_ymd")[0]), F.lpad("_month", 2, "0"), F.lpad(col("_ymd")[2], 2, "0")), "yyyy-MM-dd"))},
        {"value": F.when(
            ~col("_low").isin(NO_VALUE),
            F.when(col(dtype) == "text", col("_v"))
            .when(date, F.date_format("_date", "yyyy-MM-dd"))
            .when((col(dtype) == "integer") & col("_point").contains("."), F.lit(None))
            .when(number, F.when((col("_sign") != "") & (col("_point") != "0"), F.concat(F.lit("-"), col("_point"))).otherwise(col("_point")))
            .when(col(dtype) == "boolean", F.when(col("_low").isin(YES), "true").when(col("_low").isin(NO), "false")),
        )},
    ]
    for step in steps:
        df = df.withColumns(step)
    return df.select(*[c for c in df.columns if c in has or c == "value"])


SQL = {"text": "string", "date": "date", "decimal": "decimal(38,10)", "integer": "bigint", "boolean": "boolean"}


def literal_table(spark: SparkSession, rows: list[tuple[str, ...]], names: list[str]) -> DataFrame:
    """A few rows known to the driver as literals of the plan."""
    schema = "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), schema)))


def resolve(pairs: DataFrame, attrs: DataFrame, locales: DataFrame | None = None, wordings: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of `pairs` whose key means an attribute: form_id, attr, dtype, raw, value (null: a cast failure), read_at, kv_id.

    attrs is a table of a form's attributes: its few rows are fetched to the driver and become literals of the plan; the
    table of their wordings, as small, is broadcast. A key equals a wording when their skeletons do (case, punctuation and
    confusable glyphs apart). locales (scan_id, locale) gives the notation of dates and numbers. Null keys, unknown keys and null form ids with keys: unknown ones give no row,
    a null form_id is an entity of its own. Without a locale, English notation holds.
    """
    rows = [tuple(r) for r in attrs.select("attr", "dtype", "label_en", "label_de").collect()]
    words = wording_table(pairs.sparkSession, rows, wordings)
    base = pairs.select("form_id", "scan_id", key_skeleton(F.col("key")).alias("_k"), F.col("value").alias("raw"), "read_at", "kv_id")
    base = base.join(F.broadcast(words), "_k").drop("_k")
    if locales is None:
        base = base.withColumn("_locale", F.lit(None).cast("string"))
    else:
        one = locales.where("scan_id is not null").groupBy("scan_id").agg(F.max("locale").alias("_locale"))
        base = base.join(one, "scan_id", "left")
    return with_reading(base).select("form_id", "attr", "dtype", "raw", "value", "read_at", "kv_id")


def pivot(pairs: DataFrame, attrs: DataFrame, locales: DataFrame | None = None, typed: bool = True, wordings: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per form_id: a column per attribute in the order of `attrs`, typed by its dtype (typed=False: as written
    text), and `failed`, a map from attribute to the last raw value that could not be read as its dtype.

    Of an attribute's readable rows the one with the latest read_at counts (a null read_at is earliest), then the largest
    kv_id. Each (form, attribute) is reduced by a partial maximum before the shuffle, so a form or a key that holds a third
    of the rows is never gathered; the map of a form has at most one entry per attribute. Forms without any value keep
    their row, all null, when at least one key was known. Empty pairs: no rows. Extra columns are ignored.
    """
    names = [(r.attr, r.dtype) for r in attrs.select("attr", "dtype").collect()]
    order = F.struct("read_at", "kv_id", F.coalesce("value", "raw").alias("v"))
    empty = F.col("value").isNull() & ~F.lower(F.coalesce(tidy(F.col("raw")), F.lit(""))).isin(NO_VALUE)
    best = resolve(pairs, attrs, locales, wordings).groupBy("form_id", "attr").agg(
        F.max(F.when(F.col("value").isNotNull(), order))["v"].alias("value"), F.max(F.when(empty, order))["v"].alias("bad")
    )
    entry = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("attr", c))))
    wide = best.groupBy("form_id").agg(entry("value").alias("m"), entry("bad").alias("failed"))
    return wide.select("form_id", *[F.col("m")[a].cast(SQL[d] if typed else "string").alias(a) for a, d in names], "failed")


def found(wide: DataFrame, attrs: list[str]) -> DataFrame:
    """The wide rows read back as (form_id, attr, value), values as written."""
    named = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"`{a.replace('`', '``')}`").alias("value")) for a in attrs])
    return wide.select("form_id", F.inline(named)).where("value is not null")
