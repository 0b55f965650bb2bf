"""Scalar functions on literal inputs."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from claimloom.functions import areas, dates, money, names, text


def value(spark, column, **inputs):
    types = {str: "string", int: "bigint", float: "double"}
    frame = spark.range(1).select(*(F.lit(v).cast(types[type(v)]).alias(k) for k, v in inputs.items()), F.lit(1).alias("one"))
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("figure", "style"), [("1,25,00,000", "indian"), ("12,500,000", "western"), ("1,2500,00", "irregular"), ("12500000", "ungrouped"), ("999", "ungrouped"), ("1,000", "indian"), ("1,25,000.50", "indian")])
def test_grouping(spark, figure, style):
    assert value(spark, money.grouping(F.col("x")), x=figure) == style


@pytest.mark.parametrize(("words", "rupees"), [("Two Crore Fifty Lakh Seventy Five Thousand", 25_075_000), ("Five Thousand Five Hundred", 5_500), ("Rupees One Crore Twenty Five Lakh only", 12_500_000), ("nothing here", None), ("", None), ("lakh", 100_000), ("zero", 0)])
def test_words(spark, words, rupees):
    assert value(spark, money.words_rupees(F.col("x")), x=words) == rupees


def test_words_round_trip(spark):
    numbers = [0, 7, 20, 21, 99, 100, 101, 999, 1000, 12_345, 100_000, 9_999_999, 10_000_000, 123_456_789, 999_999_999]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", money.words_rupees(money.in_words(F.col("n"))).alias("back")).collect()
    assert all(r["n"] == r["back"] for r in rows)


def test_figures_and_check(spark):
    m = value(spark, money.money_figures(F.col("x")), x="a sum of Rs. 1,25,00,000/- paid")
    assert (m["paise"], m["grouping"], m["suspicious"]) == (1_250_000_000, "indian", False)
    assert value(spark, money.money_figures(F.col("x")), x="no money") is None
    assert value(spark, money.cross_check(F.col("x")), x="Rs. 1,00,000 (Rupees One Lakh only)")["agree"] is True
    assert value(spark, money.cross_check(F.col("x")), x="Rs. 1,00,000 (Rupees Two Lakh only)")["agree"] is False
    assert value(spark, money.cross_check(F.col("x")), x="Rs. 1,00,000")["agree"] is None


@pytest.mark.parametrize(("n", "shown"), [(0, "0"), (999, "999"), (1000, "1,000"), (123456, "1,23,456"), (12500000, "1,25,00,000"), (-1234567, "-12,34,567")])
def test_format_indian(spark, n, shown):
    assert value(spark, money.format_indian(F.col("x")), x=n) == shown


@pytest.mark.parametrize(
    ("written", "day", "ambiguous"),
    [
        ("03/04/2024", date(2024, 4, 3), True),
        ("03/14/2024", date(2024, 3, 14), False),
        ("01/01/98", date(1998, 1, 1), False),
        ("05-06-30", date(2030, 6, 5), True),
        ("the 14th day of March 2024", date(2024, 3, 14), False),
        ("14 March2024BETWEEN", date(2024, 3, 14), False),
        ("2nd January, 2024", date(2024, 1, 2), False),
        ("31 February 2024", None, None),
        ("45/45/2024", None, None),
        ("12 Foobar 2024 and 01/02/2023", date(2023, 2, 1), True),
        ("", None, None),
    ],
)
def test_dates(spark, written, day, ambiguous):
    got = value(spark, dates.parse_date(F.col("x")), x=written)
    assert (got and got["value"]) == day
    assert (got and got["ambiguous"]) == ambiguous


def test_areas(spark):
    a = value(spark, areas.parse_area(F.col("x")), x="Carpet Area: 1,150 sq. ft.")
    assert (float(a["value"]), a["unit"], str(a["sq_m"]), a["basis"]) == (1150.0, "SQ_FT", "106.838496", "carpet")
    assert value(spark, areas.parse_area(F.col("x")), x="super built-up 12 square metres")["basis"] == "super_built_up"
    assert value(spark, areas.parse_area(F.col("x")), x="0 acres") is None
    assert value(spark, areas.parse_area(F.col("x")), x="3 gunthas")["unit"] == "GUNTHA"
    close = lambda a, b: value(spark, areas.within_tolerance(F.col("a"), F.col("b")), a=a, b=b)
    assert close(2400.0, 2390.0)
    assert not close(2400.0, 2210.0)
    assert close(0.0, 0.0)


@pytest.mark.parametrize(
    ("left", "right", "outcome"),
    [
        ("Anita Desai", "Anita Dessai", "MATCH"),
        ("Shri Ramesh Patil", "R. Patil", "MATCH"),
        ("Ramesh Patil", "Suresh Kulkarni", "MISMATCH"),
        ("rameshpatil", "Ramesh Patil", "MATCH"),
        ("Ramesh Patil", "rameshpatil", "MATCH"),
        ("Patil Ramesh", "Ramesh Patil", "MATCH"),
        ("", "Ramesh", "NOT_DETERMINABLE"),
        ("Shri", "Ramesh", "NOT_DETERMINABLE"),
        ("Ramesh Patil s/o Ganpat Patil", "Ramesh Patil", "MATCH"),
        ("Ramesh Patil", "Ramesh Ganpat Patil", "PARTIAL_MATCH"),
    ],
)
def test_names(spark, left, right, outcome):
    assert value(spark, names.match_names(F.col("a"), F.col("b")), a=left, b=right)["determination"] == outcome


def test_name_parts(spark):
    assert value(spark, names.match_names(F.col("a"), F.col("b")), a="Shri Ramesh Patil", b="R. Patil")["score"] == 0.925
    assert value(spark, names.normalise_name(F.col("x")), x="  Smt.  Anita   Desai ,") == "Anita Desai"
    key = lambda x: value(spark, names.phonetic_key(F.col("x")), x=x)
    assert key("patil") != key("patel")
    assert key("desai") == key("dessai")
    assert key("laxman") == key("lakshman") or key("lakshman") == "laxman"


def test_text(spark):
    page = "Carpet   Area:\n1150 sq ft"
    tier = lambda v: value(spark, text.ground_tier(F.col("t"), F.col("v")), t=page, v=v)
    assert [tier("1150 sq ft"), tier("Carpet Area: 1150"), tier("CarpetArea:1150"), tier("980"), tier(" ")] == ["exact", "collapsed", "squashed", None, None]
    assert text.locate(page, "Carpet Area: 1150") == (0, 19)
    assert text.locate(page, "CarpetArea") == (0, 13)
    assert text.locate(page, "missing") is None
    assert text.locate(None, "x") is None
    span = value(spark, text.exact_span(F.col("t"), F.col("v")), t=page, v="1150")
    assert (span["start"], span["end"]) == (15, 19)


def test_rates(spark):
    cer = lambda a, b: value(spark, text.cer(F.col("a"), F.col("b")), a=a, b=b)
    wer = lambda a, b: value(spark, text.wer(F.col("a"), F.col("b")), a=a, b=b)
    assert (cer("abcd", "abxd"), cer("", "x")) == (0.25, None)
    assert (wer("a b c d", "a b d"), wer("", "x"), wer("one two three", "onetwothree")) == (0.25, None, 1.0)
    assert cer("one two three", "onetwothree") < wer("one two three", "onetwothree")


def test_small_functions(spark):
    s = value(spark, text.script_counts(F.col("x")), x="abc करार અ")
    assert (s["devanagari"], s["other_indic"], s["latin"]) == (4, 1, 3)
    conf = lambda x: value(spark, text.confidence_value(F.col("x")), x=x)
    assert [conf("0.98765"), conf("7"), conf("-1"), conf("NaN"), conf("x")] == [0.9877, 1.0, 0.0, None, None]
    made = spark.range(1).select(text.rendered("LTV {ltv}% over {cap}%", F.create_map(F.lit("ltv"), F.lit("91"), F.lit("cap"), F.lit("90"))).alias("v")).first()["v"]
    assert made == "LTV 91% over 90%"
    assert spark.range(1).select(text.rendered("{missing}", F.create_map(F.lit("a"), F.lit("b"))).alias("v")).first()["v"] is None
    places = lambda n: value(spark, text.sample_places(F.col("x")), x=n)
    assert [places(0), places(3), places(9)] == [[], [0, 1, 2], [0, 2, 4, 6, 8]]
    quad = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((4, 2), (10, 4), (8, 12), (2, 8))))
    box = spark.range(1).select(text.quad_box(quad, 2.0).alias("v")).first()["v"]
    assert (box["x0"], box["y0"], box["x1"], box["y1"]) == (1.0, 1.0, 5.0, 6.0)


def test_small_inputs_are_dealt_to_all_cores(spark, small):
    from claimloom.session import spread

    orders = spark.read.parquet(f"{small}/orders.parquet")
    assert spread(orders).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(orders).count() == orders.count()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert "Repartition" not in spread(orders)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sharpness_and_spans(spark):
    flat, sharp = [[5.0] * 4] * 4, [[0.0, 9.0, 0.0, 9.0], [9.0, 0.0, 9.0, 0.0], [0.0, 9.0, 0.0, 9.0], [9.0, 0.0, 9.0, 0.0]]
    rows = spark.createDataFrame([(0, flat), (1, sharp), (2, None), (3, [[1.0]])], "i int, g array<array<double>>").select("i", text.sharpness("g").alias("s")).orderBy("i").collect()
    assert rows[0]["s"] == 0.0
    assert rows[1]["s"] == 1296.0
    assert rows[2]["s"] is None and rows[3]["s"] is None
    spans = spark.createDataFrame([("a  b", "a b"), (None, "x"), ("ab", "zz")], "t string, v string").select(text.located_span("t", "v").alias("s")).collect()
    assert [(r["s"]["start"], r["s"]["end"]) for r in spans] == [(0, 4), (None, None), (None, None)]
