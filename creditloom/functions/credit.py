"""Scalar rules on amounts, scores and codes.  All are plain Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Monthly equivalent of one instalment, by payment frequency code.
FREQUENCY_FACTOR: dict[str, float] = {
    "A": 1 / 12,
    "B": 2.16,
    "D": 0.0,
    "E": 2.0,
    "L": 1 / 2,
    "M": 1.0,
    "P": 0.0,
    "Q": 1 / 3,
    "R": 1 / 4,
    "S": 1 / 6,
    "T": 1 / 3,
    "W": 4.33,
    "Y": 1 / 12,
}

# Province by first letter of the postal region.
PROVINCE_BY_LETTER: dict[str, str] = {
    "A": "NL", "B": "NS", "C": "PE", "E": "NB", "G": "QC", "H": "QC", "J": "QC",
    "K": "ON", "L": "ON", "M": "ON", "N": "ON", "P": "ON", "R": "MB", "S": "SK",
    "T": "AB", "V": "BC", "X": "NT", "Y": "YT",
}
PROVINCE_CODES = ("ON", "QC", "NS", "NB", "MB", "BC", "PE", "SK", "AB", "NL", "NT", "YT", "NU")

# Lower bounds of the score bands and their labels.
BAND_LABELS = ("subprime", "near prime", "prime", "prime plus", "super prime")
RISK_SCORE_CUTS = (1, 600, 700, 780, 830)
CREDIT_SCORE_CUTS = (300, 640, 720, 760, 800)

# Lenders treated as high-interest instalment lenders.
HIGH_INTEREST_LENDERS = ("EasyFinancial", "CITI Financial", "National Money Mart")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in double; a zero or missing denominator gives NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def rate_pct(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(F.lit(100.0) * numerator.cast("double"), denominator.cast("double"))


def safe_log(value: Column) -> Column:
    """Natural logarithm, NULL where it is undefined."""
    return F.when(value > 0, F.log(value.cast("double")))


def millions(value: Column) -> Column:
    return value.cast("double") / F.lit(1_000_000.0)


def utilisation(balance: Column, limit: Column) -> Column:
    """Share of the limit in use, 0 where there is no limit."""
    return F.coalesce(ratio(balance, limit), F.lit(0.0))


def in_bin(value: Column, low: float, high: float | None = None) -> Column:
    """1 inside [low, high), else 0 (also for NULL)."""
    test = value >= low if high is None else (value >= low) & (value < high)
    return F.when(test, 1).otherwise(0)


def band(score: Column, cuts: Sequence[float], labels: Sequence[str] = BAND_LABELS) -> Column:
    """Label of the highest cut not above the score; 'NA' below the first cut or for NULL."""
    out = None
    for cut, label in sorted(zip(cuts, labels), reverse=True):
        out = F.when(score >= cut, label) if out is None else out.when(score >= cut, label)
    return out.otherwise("NA")


def normalise_age(code: Column) -> Column:
    """Codes above 120 are months; non-positive codes carry no age."""
    years = F.when(code > 120, code / F.lit(12)).otherwise(code.cast("double"))
    return F.when(code > 0, years)


def province(region: Column, reported: Column) -> Column:
    """Province from the region's first letter, else the reported one if it is a known code."""
    letters = F.create_map(*[F.lit(x) for pair in PROVINCE_BY_LETTER.items() for x in pair])
    by_letter = F.try_element_at(letters, F.substring(region, 1, 1))
    known = reported.rlike("|".join(PROVINCE_CODES))
    return F.coalesce(by_letter, F.when(known, reported))


def credit_limit(
    flag: Column, limit: Column, high_credit: Column, balance: Column, tolerance: float = 1.1
) -> Column:
    """Limit named by the flag, unless the balance exceeds it by the tolerance or it is undefined."""

    def capped(named: Column) -> Column:
        return F.when(ratio(balance, named) < tolerance, named).otherwise(balance)

    best_known = F.greatest(
        F.coalesce(limit, F.lit(0)), F.coalesce(high_credit, F.lit(0)), balance
    )
    return (
        F.when(flag == "C", capped(limit)).when(flag == "H", capped(high_credit)).otherwise(best_known)
    )


def credit_limit_raw(flag: Column, limit: Column, high_credit: Column) -> Column:
    return F.when(flag == "C", limit).when(flag == "H", high_credit)


def has_narrative(code: str, *columns: Column) -> Column:
    """True where any narrative column equals the code (NULL columns do not decide)."""
    hit = columns[0] == code
    for column in columns[1:]:
        hit = hit | (column == code)
    return hit


def chargeoff(code1: Column, code2: Column, amount: Column, balance: Column) -> Column:
    """Collections and amount-less write-offs charge the whole balance, others at most the balance."""
    booked = F.coalesce(amount, F.lit(0))
    whole = has_narrative("TC", code1, code2)
    unbooked = has_narrative("WO", code1, code2) & (booked == 0)
    return F.when(whole, balance).when(unbooked, balance).otherwise(F.least(booked, balance))


def monthly_payment(
    frequency: Column, amount: Column, factors: Mapping[str, float] = FREQUENCY_FACTOR
) -> Column:
    """Instalment scaled to a month; unknown frequencies count as monthly."""
    table = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])
    return amount.cast("double") * F.coalesce(F.try_element_at(table, frequency), F.lit(1.0))


def pattern_at(pattern: Column, offset: Column, valid_only: int | None = None) -> Column:
    """One character of a payment pattern, newest first.

    ``valid_only=n`` restricts to offsets 1…n; by default an offset past the end yields '' and
    one before the start counts from the end, as SUBSTR does.
    """
    char = F.substr(pattern, offset, F.lit(1))
    if valid_only is None:
        return char
    return F.when(offset.between(1, valid_only), char)


def product_category(
    product: Column,
    account_type: Column,
    limit: Column,
    term: Column,
    lender: Column,
    code1: Column,
    code2: Column,
    secured_line: Column,
) -> Column:
    """Thirteen product classes from product type, size, term, lender and narrative codes."""
    secured = has_narrative("SB", code1, code2)
    instalment = product == "IL"
    line = F.when(secured_line | secured, "HELOC").otherwise("LC")
    # A term above 96 months is unusual for any instalment account, not only for product IL.
    unusual = (instalment & (limit > 65000)) | (term > 96)
    loan = (
        F.when(unusual, "IL_unusual")
        .when(lender.isin(*HIGH_INTEREST_LENDERS), "h_int_IL")
        .when(instalment & limit.between(15000, 65000), "AL_Dcr")
        .when(instalment & secured, "AL_Dsb")
        .otherwise("IL")
    )
    return (
        F.when(product.isin("ML", "BC", "AL", "SL"), product)
        .when(product == "LC", line)
        .when(account_type == "I", loan)
        .when(product == "UT", "UT")
        .otherwise("Other")
    )


def is_bad(rating: Column) -> Column:
    """Anything but current (0, 1) or too new to rate (X)."""
    return ~rating.rlike("[X01]")


def in_arrears(rating: Column) -> Column:
    return rating.rlike("[45]")


def in_default(rating: Column) -> Column:
    return rating.rlike("[7-9]")
