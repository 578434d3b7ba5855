import datetime as dt

import pytest
from pyspark.sql import functions as F

from creditloom.functions import credit, dates, geo
from tests.conftest import rows

c = F.col


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_dates_bad_text_is_null(frame):
    df = frame("t string", ("20160230",), ("20160229",), ("nonsense",), (None,), ("201613",))
    assert values(df, dates.ymd_to_date(c("t"))) == [None, dt.date(2016, 2, 29), None, None, None]
    assert values(df, dates.ym_to_date(c("t"))) == [dt.date(2016, 2, 1), dt.date(2016, 2, 1), None, None, None]


@pytest.mark.parametrize(
    "day, opened, closed",
    [
        ("2008-12-31", "2009-01-01", "2008-10-01"),
        ("2008-01-01", "2008-04-01", "2008-01-01"),
        ("2008-06-30", "2008-07-01", "2008-04-01"),
        ("2009-01-31", "2009-02-01", "2009-01-01"),
        ("2010-12-15", "2011-01-01", "2010-12-01"),
    ],
)
def test_origination_buckets(frame, day, opened, closed):
    df = frame("d date", (day,))
    got = df.select(dates.opened_bucket(c("d")), dates.closed_bucket(c("d"))).first()
    assert [str(x) for x in got] == [opened, closed]


def test_quarters_end_on_the_first_of_the_next_month(frame):
    df = frame("d date", ("2014-01-01",), ("2014-02-01",), ("2014-04-01",), ("2014-05-01",))
    assert values(df, dates.quarter_label(c("d"))) == ["yr13_q4", "yr14_q1", "yr14_q1", "yr14_q2"]


def test_closed_date_needs_a_finished_loan(frame):
    df = frame(
        "closed date, paid date, flag string, bal long",
        (None, "2015-01-01", "Y", 5),
        (None, "2015-01-01", None, 0),
        (None, "2015-01-01", None, 5),
        (None, "2015-01-01", "N", None),
        ("2014-01-01", "2015-01-01", "Y", 0),
    )
    got = values(df, dates.closed_or_last_payment(c("closed"), c("paid"), c("flag"), c("bal")))
    assert got == [dt.date(2015, 1, 1)] * 2 + [None] * 2 + [dt.date(2014, 1, 1)]


def test_credit_limit_branches(frame):
    df = frame(
        "flag string, lim long, high long, bal long",
        ("C", 100, 900, 109),
        ("C", 100, 900, 110),
        ("C", 0, 900, 50),
        ("C", None, 900, 50),
        ("H", 900, 100, 500),
        (None, None, 70, 50),
        ("X", None, None, None),
    )
    args = (c("flag"), c("lim"), c("high"))
    assert values(df, credit.credit_limit(*args, c("bal"))) == [100, 110, 50, 50, 500, 70, 0]
    assert values(df, credit.credit_limit_raw(*args)) == [100, 100, 0, None, 100, None, None]


def test_chargeoff_branches(frame):
    df = frame(
        "a string, b string, amount long, bal long",
        ("TC", None, 1, 10),
        (None, "TC", None, 10),
        ("WO", None, None, 10),
        ("WO", None, 3, 10),
        (None, None, 30, 10),
        (None, None, None, 10),
        (None, None, 3, None),
    )
    assert values(df, credit.chargeoff(c("a"), c("b"), c("amount"), c("bal"))) == [10, 10, 10, 3, 10, 0, 3]


def test_payment_unknown_frequency_is_monthly(frame):
    df = frame("f string, a long", ("A", 120), ("B", 100), ("D", 9), ("Z", 7), (None, 7), ("W", None))
    got = values(df, credit.monthly_payment(c("f"), c("a")))
    assert got == [pytest.approx(10), pytest.approx(216), 0, 7, 7, None]


def test_bands_and_missing_scores(frame):
    df = frame("s int", (None,), (0,), (-8,), (299,), (300,), (640,), (719,), (760,), (800,))
    assert values(df, credit.band(c("s"), credit.CREDIT_SCORE_CUTS)) == [
        "NA", "NA", "NA", "NA", "subprime", "near prime", "near prime", "prime plus", "super prime",
    ]
    assert values(df, credit.band(c("s"), credit.RISK_SCORE_CUTS))[1:4] == ["NA", "NA", "subprime"]


def test_age_in_months_and_missing(frame):
    df = frame("a int", (0,), (-1,), (None,), (120,), (480,))
    assert values(df, credit.normalise_age(c("a"))) == [None, None, None, 120.0, 40.0]


def test_province_fallback(frame):
    df = frame("f string, p string", ("T9H", "ON"), ("Z1A", "NU"), (None, "AB"), ("Z1A", "??"), (None, None))
    assert values(df, credit.province(c("f"), c("p"))) == ["AB", "NU", "AB", None, None]


def test_rates_do_not_divide_by_zero(frame):
    df = frame("a long, b long", (1, 4), (1, 0), (None, 1))
    assert values(df, credit.rate_pct(c("a"), c("b"))) == [25.0, None, None]
    assert values(df, credit.utilisation(c("a"), c("b"))) == [0.25, 0.0, 0.0]
    assert values(df, credit.safe_log(c("b") - 4)) == [None, None, None]


def test_pattern_offsets(frame):
    df = frame("p string, o int", ("123456789ABC", 1), ("123456789ABC", 0), ("123456789ABC", 13), ("123456789ABC", -1), (None, 1))
    assert values(df, credit.pattern_at(c("p"), c("o"))) == ["1", "1", "", "C", None]
    assert values(df, credit.pattern_at(c("p"), c("o"), valid_only=12)) == ["1", None, None, None, None]


def test_product_category_precedence(frame):
    schema = "p string, a string, l long, t int, n string, x string, y string, h boolean"
    df = frame(
        schema,
        ("LC", "R", 1, 1, None, None, None, True),
        ("LC", "R", 1, 1, None, None, "SB", False),
        ("LC", "R", 1, 1, None, None, None, False),
        ("XX", "I", 1, 97, None, None, None, False),
        ("IL", "I", 65001, None, None, None, None, False),
        ("IL", "I", 15000, 12, "CITI Financial", None, None, False),
        ("IL", "I", 65000, 12, "CITI Financial Ltd", None, None, False),
        ("IL", "I", 10, 12, None, "SB", None, False),
        ("UT", "O", 10, 12, None, None, None, False),
        ("IL", "O", 10, 12, None, None, None, False),
    )
    got = values(df, credit.product_category(*[c(x) for x in "paltnxyh"]))
    assert got == ["HELOC", "HELOC", "LC", "IL_unusual", "IL_unusual", "h_int_IL", "AL_Dcr", "AL_Dsb", "UT", "Other"]


def test_postal_and_distance(frame):
    df = frame("p string", ("T9H 1A1",), (" T9H1A1 ",))
    region, unit = geo.split_postal(c("p"))
    assert rows(df.select(region.alias("r"), unit.alias("u"))) == [("T9H", "1A1")] * 2
    one = frame("x double", (56.7,))
    assert one.select(geo.geo_km(c("x"), F.lit(-111.0), c("x"), F.lit(-111.0))).first()[0] == 0
    degree = one.select(geo.geo_km(c("x"), F.lit(-111.0), c("x") + 1, F.lit(-111.0))).first()[0]
    assert degree == pytest.approx(111.045)
