"""Study parameters: the treated area, its event calendar and product settings."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Study:
    """Fixed values of the evaluated event; every field can be replaced for another study."""

    treated_regions: str = "^(T9H|T9J|T9K)$"
    treated_label: str = "T9(H|J|K)"
    provinces: tuple[str, ...] = ("AB", "SK")
    province_names: tuple[str, ...] = ("Alberta", "Saskatchewan")
    control_km: float = 100.0
    min_active: int = 5000

    event: dt.date = dt.date(2016, 5, 1)
    evacuation: tuple[dt.date, dt.date] = (dt.date(2016, 5, 1), dt.date(2016, 11, 1))

    revision_start: dt.date = dt.date(2016, 6, 1)
    revision: dt.date = dt.date(2017, 2, 1)
    relief_before: tuple[dt.date, dt.date] = (dt.date(2016, 3, 1), dt.date(2016, 5, 1))
    relief: tuple[dt.date, dt.date] = (dt.date(2016, 6, 1), dt.date(2016, 10, 1))
    relief_after: tuple[dt.date, dt.date] = (dt.date(2016, 11, 1), dt.date(2016, 12, 1))

    history_start: dt.date = dt.date(2003, 1, 1)
    monthly_since: int = 2009
    owner_since: int = 2011
    accounts_start: dt.date = dt.date(2011, 1, 1)

    window: tuple[dt.date, dt.date] = (dt.date(2014, 1, 1), dt.date(2018, 1, 1))
    origin_window: tuple[dt.date, dt.date] = (dt.date(2014, 2, 1), dt.date(2018, 1, 1))
    base_date: dt.date = dt.date(2016, 6, 1)


STUDY = Study()
