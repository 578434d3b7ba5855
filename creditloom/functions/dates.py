"""Date expressions: parsing compact text, calendar steps, quarter buckets, fallbacks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Step:
    """The spacing of a panel: calendar months in production, days on dense test panels."""

    unit: str

    def floor(self, date: Column) -> Column:
        return F.trunc(date, "MM") if self.unit == "month" else date

    def shift(self, date: Column, n: int) -> Column:
        return F.add_months(date, n) if self.unit == "month" else F.date_add(date, n)

    def index(self, date: Column) -> Column:
        """Consecutive integers for consecutive periods."""
        if self.unit == "month":
            return F.year(date) * 12 + F.month(date)
        return F.unix_date(date)


MONTH = Step("month")
DAY = Step("day")


def ym_to_date(text: Column) -> Column:
    """``YYYYMM…`` text to the first day of that month; bad text gives NULL."""
    return F.try_to_date(F.concat(F.substring(text, 1, 6), F.lit("01")), "yyyyMMdd")


def ymd_to_date(text: Column) -> Column:
    """``YYYYMMDD`` text to a date; bad text gives NULL."""
    return F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd")


def opened_bucket(date: Column, monthly_since: int = 2009) -> Column:
    """First observation month after an opening: next month, or next quarter before the monthly era."""
    return F.when(
        F.year(date) >= monthly_since, F.trunc(F.add_months(date, 1), "MM")
    ).otherwise(F.add_months(F.trunc(date, "quarter"), 3))


def closed_bucket(date: Column, monthly_since: int = 2009) -> Column:
    """Observation month of a closing: its month, or its quarter before the monthly era."""
    return F.when(F.year(date) >= monthly_since, F.trunc(date, "MM")).otherwise(
        F.trunc(date, "quarter")
    )


def opened_or_estimated(opened: Column, last_payment: Column, months: int = 18) -> Column:
    return F.coalesce(opened, F.add_months(last_payment, -months))


def closed_or_last_payment(
    closed: Column, last_payment: Column, closed_flag: Column, balance: Column
) -> Column:
    """Last payment stands in for a missing closing date, but only once the loan looks finished."""
    finished = (closed_flag == "Y") | (balance == 0)
    return F.when(finished, F.coalesce(closed, last_payment)).otherwise(closed)


def quarter_label(date: Column) -> Column:
    """Quarters that start one day late: 2 Jan – 1 Apr is q1, so a month-start belongs to the past quarter."""
    inside = F.add_months(date, -1)
    return F.concat(
        F.lit("yr"),
        F.date_format(inside, "yy"),
        F.lit("_q"),
        F.quarter(inside).cast("string"),
    )
