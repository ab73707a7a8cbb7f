import math
from decimal import ROUND_HALF_UP, Decimal, localcontext

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from roundledger.functions import text

# Exact texts for numbers and percentages.
NUMBERS = [
    (None, 2, "NA"),
    (0.0, 2, "0.00"),
    (5.1298, 2, "5.13"),
    (-5.1298, 2, "-5.13"),
    (5.1298, None, "5"),
]
PERCENTAGES = [
    (None, None, "NA"),
    (0.0, None, "0.00%"),
    (5.1298, None, "512.98%"),
    (-5.1298, None, "-512.98%"),
    (5.1298, 4, "512.9800%"),
]


def shown(spark, present, value, digits):
    df = spark.createDataFrame([(value,)], "v double")
    arguments = [] if digits is None else [digits]
    return df.select(present(F.col("v"), *arguments)).first()[0]


@pytest.mark.parametrize("value, digits, expected", NUMBERS)
def test_number(spark, value, digits, expected):
    assert shown(spark, text.present_number, value, digits) == expected


@pytest.mark.parametrize("value, digits, expected", PERCENTAGES)
def test_percentage(spark, value, digits, expected):
    assert shown(spark, text.present_percentage, value, digits) == expected


@pytest.mark.parametrize(
    "value, digits, expected",
    [
        (1.005, 2, "1.00"),  # stored below the tie
        (8.345, 2, "8.35"),  # stored above the tie
        (1.115, 2, "1.11"),
        (0.125, 2, "0.13"),  # an exact tie
        (-0.125, 2, "-0.13"),
        (2.5, 0, "3"),
        (-0.0, 2, "0.00"),
        (-0.001, 2, "-0.00"),
        (float("inf"), 2, "Infinity"),
        (float("-inf"), 2, "-Infinity"),
        (1e20, 2, "100000000000000000000.00"),
        (1e21, 2, "1e+21"),
        (-1.5e22, 0, "-1.5e+22"),
        (0.1, 10, "0.1000000000"),
    ],
)
def test_exact_rounding(spark, value, digits, expected):
    assert shown(spark, text.present_number, value, digits) == expected


@settings(max_examples=12, deadline=None)
@given(st.data())
def test_rounds_the_exact_value(spark, data):
    digits = data.draw(st.integers(0, 15))
    top = int(min(9e15, 1e20 / 10**digits))
    near_ties = st.integers(-top, top).map(lambda n: (n + 0.5) / 10**digits)
    sizes = st.floats(-1e9, 1e9) | st.floats(-10, 10) | st.floats(-1e20, 1e20)
    values = data.draw(st.lists(near_ties | sizes, min_size=200, max_size=200))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    with localcontext() as context:
        context.prec = 400
        for value, result in df.select("v", text.fixed_point(F.col("v"), digits)).collect():
            unit = Decimal(1).scaleb(-digits)
            size = Decimal(abs(value)).quantize(unit, ROUND_HALF_UP)
            assert result == ("-" if value < 0 else "") + f"{size:f}"


@pytest.mark.parametrize(
    "value, digits, expected",
    [
        (647717543545.975, 2, "647717543545.97"),
        (9.5603427195, 9, "9.560342719"),
        (2.0**60, 2, "1152921504606846976.00"),
        (2.0**53, 0, "9007199254740992"),
        (2.0**69, 1, "590295810358705651712.0"),
        (0.9999999999999999, 15, "1.000000000000000"),
        (float("nan"), 2, "NaN"),
    ],
)
def test_no_magnitude_is_beyond_reach(spark, value, digits, expected):
    assert shown(spark, text.present_number, value, digits) == expected


def test_formatting_stays_small_enough_to_be_compiled(spark):
    """Java compiles methods of up to 8,000 bytes."""
    n = F.col("id") / 3
    df = spark.range(5).select(
        text.present_number(n, 2).alias("a"), text.present_percentage(n).alias("b"),
        text.present_metric(F.lit("mae"), n, 2).alias("c"),
    )
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    assert 0 < max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_more_digits_are_refused():
    with pytest.raises(ValueError, match="digits"):
        text.fixed_point(F.lit(1.0), 16)


@pytest.mark.parametrize(
    "metric, value, digits, expected",
    [
        ("totalTips", 12.0, 2, "12"),
        ("accuracy", 0.5, 0, "50%"),
        ("mae", 1.25, 2, "1.25"),
        ("bits", None, 2, "NA"),
    ],
)
def test_metric(spark, metric, value, digits, expected):
    df = spark.createDataFrame([(metric, value)], "m string, v double")
    shown_as = text.present_metric(F.col("m"), F.col("v"), digits)
    assert df.select(shown_as).first()[0] == expected


def test_labels_and_words(spark):
    df = spark.createDataFrame([("mae", True), ("Mae", False), ("bits", None)], "m string, c boolean")
    rows = df.select(
        text.metric_label(F.col("m")), text.is_metric(F.col("m")), text.correctness(F.col("c"))
    ).collect()
    assert [tuple(row) for row in rows] == [
        ("MAE", True, "yeah"),
        (None, False, "nah"),
        ("Bits", True, "dunno"),
    ]


PARSED = [
    ("2020", 2020), ("2020abc", 2020), (" -7.9", -7), ("", None), ("x1", None), (None, None),
    ("\u00a0\u2003\ufeff2020", 2020), ("\x1f2020", None), ("3000000000", 3_000_000_000),
    (str(2**63 - 1), 2**63 - 1), (str(2**63), None), (str(-(2**63)), -(2**63)),
    ("9" * 5000, None), ("0" * 5000 + "7", 7), ("0x10", 16), ("-0XfFg", -255), ("0x", None),
    ("0x" + "f" * 16, None), ("0x7" + "f" * 15, 2**63 - 1), ("0x" + "0" * 40 + "1", 1), ("+5", 5),
    ("000", 0),
]


def test_integer_prefix(spark):
    df = spark.createDataFrame([(t,) for t, _ in PARSED], "t string")
    assert [r[0] for r in df.select(text.integer_prefix(F.col("t"))).collect()] == [
        n for _, n in PARSED
    ]
    assert [text.parse_integer_prefix(t) for t, _ in PARSED] == [n for _, n in PARSED]


def test_finite(spark):
    df = spark.createDataFrame([(1.5,), (math.inf,), (-math.inf,), (math.nan,), (None,)], "v double")
    assert [r[0] for r in df.select(text.finite(F.col("v"))).collect()] == [1.5, None, None, None, None]
