"""Calendar features as row-local expressions; no dimension table is joined."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcast.schema import DAY

# fixed values: national holidays on a fixed date as month*100+day, and the year one was added
FIXED_HOLIDAYS = [101, 421, 501, 907, 1012, 1102, 1115, 1225]
CONSCIOUSNESS_DAY = 1120
CONSCIOUSNESS_SINCE = 2024
DAYS_PER_YEAR = 365.25


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("int")


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar (the widely published 1876 computus)."""
    golden = year % 19
    century, in_century = _div(year, 100), year % 100
    leap_centuries, century_rest = _div(century, 4), century % 4
    moon_shift = _div(century - _div(century + 8, 25) + 1, 3)
    epact = (golden * 19 + century - leap_centuries - moon_shift + 15) % 30
    weekday_shift = (century_rest * 2 + _div(in_century, 4) * 2 + 32 - epact
                     - in_century % 4) % 7
    correction = _div(golden + epact * 11 + weekday_shift * 22, 451)
    march_days = epact + weekday_shift - correction * 7 + 22
    return F.date_add(F.make_date(year, F.lit(3), F.lit(1)), march_days - 1)


def is_holiday(day: Column) -> Column:
    month_day = F.month(day) * 100 + F.dayofmonth(day)
    return (month_day.isin(FIXED_HOLIDAYS)
            | ((month_day == CONSCIOUSNESS_DAY) & (F.year(day) >= CONSCIOUSNESS_SINCE))
            | (day == F.date_sub(easter(F.year(day)), 2)))


def calendar_features(df: DataFrame, day: str = DAY) -> DataFrame:
    d = F.col(day)
    angle = F.dayofyear(d) * F.lit(2 * math.pi) / F.lit(DAYS_PER_YEAR)
    return df.withColumns({
        "mes": F.month(d),
        "dia_semana": F.weekday(d),
        "trimestre": F.quarter(d),
        "ano": F.year(d),
        "is_feriado": is_holiday(d).cast("int"),
        "is_vespera_feriado": is_holiday(F.date_add(d, 1)).cast("int"),
        "is_fds": (F.weekday(d) >= 5).cast("int"),
        "dia_ano_sen": F.sin(angle),
        "dia_ano_cos": F.cos(angle),
    })
