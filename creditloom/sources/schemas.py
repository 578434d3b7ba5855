"""Declared input schemas.  Column names are lower case; dates arrive as compact text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
)


def _struct(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


_text, _long, _int, _real, _date = StringType(), LongType(), IntegerType(), DoubleType(), DateType()

CONSUMER = _struct(
    tu_consumer_id=_long, run_date=_text, fsa=_text, encrypted_ldu=_text, go30=_int, go90=_text,
    go91=_text, as115=_int, cvsc100=_int, mc33=_long,
)

ACCOUNT = _struct(
    tu_consumer_id=_long, tu_trade_id=_long, joint_account_id=_long, primary_indicator=_int,
    acct_type=_text, product_type=_text, best_amt_flag=_text, credit_limit=_long,
    high_credit_amt=_long, narrative_code1=_text, narrative_code2=_text, closed_indic=_text,
    current_balance=_long, chargoff_amt=_long, mop=_text, l3=_text, terms_dur=_int,
    terms_frequency=_text, terms_amt=_long, paymt_pat=_text, months_reviewed=_int,
    insurance_indicator=_text, paymt_amt=_long, activity_period=_text, tu_acct_num=_text,
    run_date=_date, reported_dt=_text, last_updated_dt=_text, opened_dt=_text, closed_dt=_text,
    file_since_dt=_text, last_paymt_dt=_text,
)

POSTAL_GEOGRAPHY = _struct(pstlcode=_text, province=_text, latitude=_real, longitude=_real)
KEY_MAPPING = _struct(encrypted_ldu=_text, ldu=_text, n_repeat=_int)
DAMAGED_SITES = _struct(postal_code=_text, fsa=_text, ldu=_text, community=_text)


def require(df: DataFrame, schema: StructType) -> DataFrame:
    """Project to the declared columns, failing on a missing column or a different type."""
    have = {field.name.lower(): field for field in df.schema.fields}
    wrong = [
        f"{field.name}: want {field.dataType.simpleString()}, have "
        + (have[field.name].dataType.simpleString() if field.name in have else "nothing")
        for field in schema.fields
        if field.name not in have or have[field.name].dataType != field.dataType
    ]
    if wrong:
        raise ValueError("schema mismatch: " + "; ".join(wrong))
    return df.select(*[df[field.name].alias(field.name) for field in schema.fields])
