"""Label, number and date expressions for Portuguese-language input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accented letters of Portuguese and their base letters
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
UNACCENTED = "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN"
COMBINING_MARKS = "[\\u0300-\\u036f]"


def fold_label(text: Column) -> Column:
    """Strip accents (precomposed or combining) and collapse blanks; case is left alone."""
    bare = F.regexp_replace(F.translate(text, ACCENTED, UNACCENTED), COMBINING_MARKS, "")
    return F.trim(F.regexp_replace(bare, "[\\s\\u00a0]+", " "))


def label_upper(text: Column) -> Column:
    return F.upper(fold_label(text))


def label_lower(text: Column) -> Column:
    return F.lower(fold_label(text))


def localized_number(text: Column) -> Column:
    """Number from text; only a cell holding a comma treats its dots as thousands marks."""
    text = F.trim(text)
    plain = F.when(text.contains(","),
                   F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
                   ).otherwise(text)
    number = plain.try_cast("double")
    return F.when(~F.isnan(number), number)


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """A date from integers, null for a day that does not exist. Bad input never raises."""
    plausible = year.between(1, 9999) & month.between(1, 12) & day.between(1, 31)
    month_end = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.when(plausible, F.when(day <= month_end, F.make_date(year, month, day)))


def user_date(text: Column) -> Column:
    """Day-first slash, dash or dot dates, and ISO dates, each with an optional time; else null.

    ISO text stays year-month-day: it is never read day-first.
    """
    bare = F.substring_index(F.substring_index(F.trim(text), " ", 1), "T", 1)
    parts = F.split(F.translate(bare, "/.", "--"), "-")
    first, second, third = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    year_first = F.length(first) == 4
    whole = (F.size(parts) == 3) & (year_first | (F.length(third) == 4))
    number = lambda part: part.try_cast("int")
    return F.when(whole, calendar_date(F.when(year_first, number(first)).otherwise(number(third)),
                                       number(second),
                                       F.when(year_first, number(third)).otherwise(number(first))))


def station_date(text: Column) -> Column:
    """Station files write yyyy/MM/dd or yyyy-MM-dd."""
    parts = F.split(F.translate(F.trim(text), "/", "-"), "-")
    year, month, day = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    return F.when(F.size(parts) == 3, calendar_date(year, month, day))


def decimal_comma(number: Column) -> Column:
    return F.replace(number.cast("string"), F.lit("."), F.lit(","))


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Fixed small dictionary as a literal map: no join, no shuffle; unknown keys give null."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)
