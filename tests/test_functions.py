import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "value", "form"),
    [("12", 12, "0"), ("0.750", 0.75, "0.000"), ("1,200", 1200, "#,##0"), ("-4", -4, "0"), ("$3.10", 3.1, '"$"0.00'), ("12.5%", 0.125, "0.0%"), ("007", None, None), ("1234567890123456", None, None), ("12 kg", None, None), ("3:30", None, None), ("INV-2291", None, None)],
)
def test_typed_number(spark, text, value, form):
    v, f = T.typed_number(F.lit(text))
    assert one(spark, v) == value and one(spark, f) == form


def test_line_class(spark):
    for text, want in {"[x] done": "checkbox", "- item": "bullet", "3) third": "bullet", "Name: A": "key_value", "at 10:30": "text", "plain": "text", "": "text"}.items():
        assert one(spark, T.line_class(F.lit(text))) == want


def test_names_and_escapes(spark):
    assert one(spark, T.file_name(F.lit("inv/../x"))) == "invx" and one(spark, T.file_name(F.lit("??"))) == "scan" and one(spark, T.file_name(F.lit(None).cast("string"))) == "scan"
    assert one(spark, T.csv_field(F.lit('a"b'))) == '"a""b"' and one(spark, T.markdown_cell(F.lit("a|b\nc"))) == "a\\|b<br>c"
    assert one(spark, T.circled(F.lit(3))) == "③" and one(spark, T.column_letters(F.lit(28))) == "AB" and one(spark, T.column_letters(F.lit(703))) == "AAA"
