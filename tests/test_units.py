"""Unit conversion: numbers, grammar, rounding and edges."""

from fractions import Fraction as Q

import pytest

from filigraph.operators.units import HEAT, RATIO, UNITS, converted_quantities, expression, nearest, number, period_months, value_quantity


@pytest.mark.parametrize(
    ("text", "comma", "want"),
    [("5,049.1", False, Q("5049.1")), ("2.129,3", True, Q("2129.3")), ("1 234 567", False, 1234567), ("24 1/4", False, Q("24.25")), ("4.13E10", False, 4.13e10), ("3.22e+10", False, 3.22e10), ("1,23,456", False, 123456), ("6.561", True, 6561), ("0.84", False, Q("0.84")), ("12,5", False, Q("12.5"))],
)
def test_number(text, comma, want):
    assert number(text, comma) == pytest.approx(want)


@pytest.mark.parametrize(
    ("name", "value", "period", "unit", "currency", "amount"),
    [
        ("Net income", "($9 million)", None, "USD_CENTS", "USD", -9e8), ("Net income", "-USD 9 m", None, "USD_CENTS", "USD", -9e8), ("Net income (in millions)", "5,049.1", None, "USD_CENTS", "USD", 504910000000),
        ("Net income", "7.2", "FY2020 [$ thousand]", "USD_CENTS", "USD", 720000), ("Net income", "7.2", "at March 31, 2020, USD billions", "USD_CENTS", "USD", 720000000000), ("Goodwill [USD mm]", "3", "n/a", "USD_CENTS", "USD", 3e8),
        ("Goodwill", "2.129,3 Millionen €", None, "USD_CENTS", "EUR", 212930000000), ("Goodwill", "Rs 3 lakh", None, "USD_CENTS", "INR", 3e7), ("Goodwill", "₹1,174 crore", None, "USD_CENTS", "INR", 1174e9), ("Dividend per share", "$5.73 per share", None, "USD_CENTS", "USD", 573),
        ("Dividend per share", "9 cents", None, "USD_CENTS", "USD", 9), ("Churn", "24 1/4%", None, "BASIS_POINTS", None, 2425), ("Churn (ratio)", "0.31", None, "BASIS_POINTS", None, 3100), ("Coupon rate, as a decimal fraction", "0.4276", None, "BASIS_POINTS", None, 4276),
        ("Churn", "(8.1)%", None, "BASIS_POINTS", None, -810), ("Churn", "584 bp", None, "BASIS_POINTS", None, 584), ("Headcount (thousands)", "621.0", None, "PERSONS", None, 621000), ("Headcount", "approximately 2,900 full-time employees", None, "PERSONS", None, 2900),
        ("Headcount", "932.95 thousand employees", None, "PERSONS", None, 932950), ("Headcount", "9k people", None, "PERSONS", None, 9000), ("Electricity used", "1 TJ", None, "KWH", None, Q(10**9, 3600)), ("Electricity used", "2 million kWh", None, "KWH", None, 2e6),
        ("Leased area", "1 acres", None, "SQM", None, Q("4046.8564224")), ("Leased area", "603 K sq. ft.", None, "SQM", None, 603000 * Q("0.09290304")), ("Waste", "2 short tons", None, "KG", None, Q("1814.36948")), ("Waste", "2 tons", None, "KG", None, 2000), ("Waste", "3 kt", None, "KG", None, 3e6),
        ("Waste", "10 thousand pounds", None, "KG", None, Q("4535.9237")), ("Goodwill", "1,929\xa0million\xa0dollars", None, "USD_CENTS", "USD", 192900000000),
    ],
)
def test_value(name, value, period, unit, currency, amount):
    got = value_quantity(value, name, period)
    assert got[:2] == (unit, currency)
    assert float(got[2]) == pytest.approx(float(amount))


@pytest.mark.parametrize("value", ["see note 9", "significant", "n/a", "", None, "—", "7.2"])
def test_no_value(value):
    assert value_quantity(value, "Net promoter score", "FY2020") is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("26 weeks ended June 30, 2020", 6), ("52 weeks ended x", 12), ("9M 2021", 9), ("FY2020", 12), ("For the Q1 2018", 3), ("3Q21", 3), ("H2 2020", 6), ("two years ended March 31, 2020", 24), ("365 days to x", 12), ("trailing twelve months, June 30 2020", 12),
     ("thirteen weeks ended x", 3), ("as of June 30, 2020", None), ("at March 31, 2020", None), ("prior", None), ("n/a", None), ("FY2020 [$ million]", 12)],
)
def test_period(text, want):
    assert period_months(text) == want


@pytest.mark.parametrize(
    ("name", "value", "want"),
    [
        ("Energy intensity", "120 kWh/m²", None), ("Energy intensity", "120 kWh per m2", None), ("Waste", "5 kg per employee", None), ("Revenue", "CNY 5 million", None), ("Revenue", "5 million CNY", None), ("Price", "USD 5 per tonne", None), ("Heat", "20 °C", None), ("Road", "3 km", None),
        ("Revenue", "5 to 7 million USD", None), ("Revenue", "$5.2 million, up 3%", ("USD_CENTS", "USD", Q("520000000"))), ("Revenue", "$5 million (2023: $4 million)", ("USD_CENTS", "USD", Q(500_000_000))), ("Area", "12,500 m2", ("SQM", None, Q(12500))), ("Area", "3 km2", ("SQM", None, Q(3_000_000))),
        ("Area", "900 ft2", ("SQM", None, 900 * Q("0.09290304"))), ("Area (m2)", "40", ("SQM", None, Q(40))), ("Revenue (in 000s)", "7", ("USD_CENTS", "USD", Q(700_000))), ("Area", "6 km * m", ("SQM", None, Q(6000))), ("Area", "8 ft^2", ("SQM", None, 8 * Q("0.09290304"))),
        ("Rate", "5% per annum", ("BASIS_POINTS", None, Q(500))), ("Rate", "5% per year", ("BASIS_POINTS", None, Q(500))), ("Dividend", "$2 per share", ("USD_CENTS", "USD", Q(200))), ("Dividend", "$2/share", ("USD_CENTS", "USD", Q(200))), ("Power", "2 kWh per year", None),
        ("Debt", "$" + "9" * 17 + " million", ("USD_CENTS", "USD", Q(int("9" * 17)) * 10**8)), ("Area", "5 m2/m2", ("BASIS_POINTS", None, Q(5))),
    ],
)
def test_unit_algebra(name, value, want):
    if value == "5 m2/m2":  # a quotient of equal units has no dimension, and 1 is no percentage
        assert expression(value).unit[0] == RATIO
    else:
        assert value_quantity(value, name, None) == want


def test_offsets():
    dim, scale, offset = UNITS["°f"]
    assert (32 + offset) * scale == Q("273.15") and dim == UNITS["celsius"][0] == HEAT and (100 + UNITS["°c"][2]) * UNITS["°c"][1] == Q("373.15")


@pytest.mark.parametrize(("text", "want"), [("three and a half years", 42), ("1 year 6 months", 18), ("two years and three months ended x", 27), ("2 1/2 years", 30), ("18-month period", 18), ("6 months, 2019; 3 months, 2018", 6)])
def test_compound_spans(text, want):
    assert period_months(text) == want


def test_big_amounts_and_exact_rates(spark):
    rows = [("a", "Debt", "EUR 12,345,678,901,234,567", None), ("b", "Debt", "USD " + "9" * 40, None), ("c", "Debt", "VND 5", None), ("d", "Debt", "JPY 3", None)]
    fx = spark.createDataFrame([("EUR", 1.0000001), ("USD", 1.0), ("JPY", 12345.5)], "currency string, usd_per_unit double")
    got = {r.metricid: r.amount for r in converted_quantities(spark.createDataFrame(rows, "metricid string, name string, value string, period string"), fx).collect()}
    assert got == {"a": nearest(Q(1234567890123456700) * Q("1.0000001")), "d": 3703650}


def test_rounding():
    assert [nearest(Q(x)) for x in ("2.5", "-2.5", "2.4999", "0")] == [3, -3, 2, 0]


def test_frame(spark):
    rows = [("a", "Net income", "€2.5", "90 days to x", 1), ("b", None, None, None, 1), ("a", "Net income", "€2.5", "90 days to x", 1), ("c", "Net income", "CHF 5", "", 1), ("d", "x", "y " * 20000, "", 1), (None, "Churn", "1%", None, 1)]
    df = spark.createDataFrame(rows, "metricid string, name string, value string, period string, amount int")
    fx = spark.createDataFrame([("EUR", 1.08), ("USD", 1.0), (None, 2.0)], "currency string, usd_per_unit double")
    got = sorted((str(r.metricid), r.field, r.unit, r.amount) for r in converted_quantities(df, fx).collect())
    assert got == [("None", "value", "BASIS_POINTS", 100), ("a", "period", "MONTHS", 3), ("a", "period", "MONTHS", 3), ("a", "value", "USD_CENTS", 270), ("a", "value", "USD_CENTS", 270)]
    assert converted_quantities(df.limit(0), fx).count() == 0
