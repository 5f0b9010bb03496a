from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panel360 import functions as fn


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)])
    return df.select(column).first()[0]


def test_div0(spark):
    a, b = F.lit(3), F.lit(0)
    assert one(spark, fn.div0(a, b)) == 0.0
    assert one(spark, fn.div0(a, F.lit(4))) == 0.75
    assert one(spark, fn.div0(a, F.lit(None).cast("int"))) is None
    assert one(spark, fn.div0(F.lit(None).cast("int"), b)) is None


def test_boundaries_are_counted_not_completed(spark):
    eve, new_year = F.lit(dt.date(2000, 12, 31)), F.lit(dt.date(2001, 1, 1))
    assert one(spark, fn.year_boundaries(eve, new_year)) == 1
    assert one(spark, fn.month_boundaries(eve, new_year)) == 1
    assert one(spark, fn.year_boundaries(new_year, F.lit(dt.date(2001, 12, 31)))) == 0


def test_add_months_clamps_to_month_end(spark):
    assert one(spark, F.add_months(F.lit(dt.date(2026, 8, 31)), -6)) == dt.date(2026, 2, 28)


@pytest.mark.parametrize("text, want", [
    ("anna smith-jones", "Anna Smith-Jones"), ("DaCOSTA", "Dacosta"), ("o'neil", "O'neil"),
    ("a/b c.d", "A/B C.D"), ("", "")])
def test_initcap(spark, text, want):
    assert one(spark, fn.initcap_punct(F.lit(text))) == want


def test_regex_group_gives_null_not_empty(spark):
    assert one(spark, fn.regex_group(F.lit("x: \n"), r"x:([^\n]*)")) is None
    assert one(spark, fn.regex_group(F.lit("none"), r"x:([^\n]*)")) is None
    assert one(spark, fn.regex_group(F.lit("x:  y "), r"x:([^\n]*)")) == "y"


@pytest.mark.parametrize("text, want", [("7", 7), ("7.5", 8), ("7 days", None), (None, None)])
def test_to_int_rounded(spark, text, want):
    assert one(spark, fn.to_int_rounded(F.lit(text).cast("string"))) == want


def test_concat_is_null_propagating_and_decimals_keep_scale(spark):
    assert one(spark, F.concat(F.lit("a"), F.lit(None).cast("string"))) is None
    assert one(spark, F.concat(F.lit("PDC "), F.lit("0.4").cast("decimal(4,2)"))) == "PDC 0.40"


def test_tokens_keep_letters_of_any_script(spark):
    assert one(spark, fn.tokens(F.lit("Straße, 2 Öfen!"))) == ["straße", "2", "öfen"]


def test_html_to_text(spark):
    html = "<h1>A &amp; B</h1><script>x()</script><p>one</p><p>two<br>three</p><!-- c -->"
    assert one(spark, fn.html_to_text(F.lit(html))) == "A & B\none\ntwo\nthree\n"
