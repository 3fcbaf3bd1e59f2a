"""Monthly industrial consumption: worksheet blocks to rows, months to days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcast.functions.text import label_upper, lookup
from loadcast.operators.quality import keep_last
from loadcast.operators.series import by_sub
from loadcast.schema import (DAY, HOURS_PER_DAY, LEVEL_INPUT, NATIONAL,
                             PUBLICATION_LAG_MONTHS, SUB)

# fixed values: labels of the worksheet's subsystem block and the marks that open and close it
SHEET_LABEL_TO_SUB = {
    "NORTE": "N",
    "NORDESTE": "NE",
    "SUDESTE/C. OESTE": "SE",
    "SUDESTE/C.OESTE": "SE",
    "SUL": "S",
}
BLOCK_OPENS = "SUBSISTEMA EL"
BLOCK_CLOSES = ["REGIAO GEOGRAFICA", "TOTAL"]
YEAR_MARK = "^\\d{4}\\**$"
MONTH_CELLS = [f"c{i}" for i in range(1, 13)]


def sheet_months(grid: DataFrame) -> DataFrame:
    """Worksheet cells ``(sheet, row_no, c0..c12)`` to ``(ano, mes, id_subsistema, industrial_mwh)``.

    A year mark sets the year and closes the block; block marks open or close it. Both states are
    carried down the sheet, whose height is bounded by the workbook format.
    """
    label = label_upper(F.coalesce("c0", F.lit("")))
    first_cell = F.trim(F.coalesce("c1", F.lit("")))
    is_year = first_cell.rlike(YEAR_MARK)
    closes = F.lit(False)
    for mark in BLOCK_CLOSES:
        closes = closes | label.startswith(mark)
    marked = grid.select(
        "sheet", "row_no", *MONTH_CELLS,
        lookup(SHEET_LABEL_TO_SUB, label).alias(SUB),
        F.when(is_year, F.substring(first_cell, 1, 4).cast("int")).alias("year_mark"),
        F.when(is_year, F.lit(0)).when(label.startswith(BLOCK_OPENS), F.lit(1))
         .when(closes, F.lit(0)).alias("block_mark"),
    )
    down = (Window.partitionBy("sheet").orderBy("row_no")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = (marked
              .withColumn("ano", F.last("year_mark", ignorenulls=True).over(down))
              .withColumn("inside", F.last("block_mark", ignorenulls=True).over(down))
              .filter((F.col("inside") == 1) & F.col("block_mark").isNull()
                      & F.col("ano").isNotNull() & F.col(SUB).isNotNull()))
    cells = inside.unpivot(["sheet", "row_no", "ano", SUB], MONTH_CELLS, "cell", "text")
    number = F.trim("text").try_cast("double")
    values = (cells.withColumn("mes", F.substring("cell", 2, 2).cast("int"))
              .withColumn("industrial_mwh", F.when(~F.isnan(number), number))
              .filter(F.col("industrial_mwh").isNotNull()))
    return (keep_last(values, ["ano", "mes", SUB], ["sheet", "row_no"])
            .select("ano", "mes", SUB, "industrial_mwh"))


def monthly_anchors(monthly: DataFrame, lag_months: int = PUBLICATION_LAG_MONTHS) -> DataFrame:
    """MWh over the hours of the month, placed on day 15 of the month it becomes visible."""
    day15 = F.make_date("ano", "mes", F.lit(15))
    hours = F.dayofmonth(F.last_day(day15)) * HOURS_PER_DAY
    return (monthly.filter(F.col("industrial_mwh").isNotNull())
            .select(SUB, F.add_months(day15, lag_months).alias("anchor"),
                    (F.col("industrial_mwh") / hours).alias("anchor_value")))


def industrial_levels(monthly: DataFrame, first_day: Column, last_day: Column,
                      lag_months: int = PUBLICATION_LAG_MONTHS, mode: str = "linear") -> DataFrame:
    """Daily industrial level per subsystem between two days.

    Each anchor owns the days up to the next one and expands only those inside the grid, so no
    as-of join is needed. ``linear`` interpolates in time and is flat beyond both ends; it moves
    before an anchor is published. ``step`` holds the last visible value and never looks ahead.
    """
    if mode not in ("linear", "step"):
        raise ValueError(f"unknown mode: {mode}")
    anchors = monthly_anchors(monthly, lag_months)
    order = Window.partitionBy(SUB).orderBy("anchor")
    segments = anchors.select(
        SUB, "anchor", "anchor_value",
        F.lead("anchor").over(order).alias("next_anchor"),
        F.lead("anchor_value").over(order).alias("next_value"),
        F.lag("anchor").over(order).isNull().alias("is_first"),
        first_day.alias("lo"), last_day.alias("hi"))
    opens = F.greatest("anchor", "lo")
    if mode == "linear":
        opens = F.when(F.col("is_first"), F.col("lo")).otherwise(opens)
    closes = F.least(F.coalesce(F.date_sub("next_anchor", 1), "hi"), "hi")
    days = (segments.withColumn("opens", opens).withColumn("closes", closes)
            .filter(F.col("opens") <= F.col("closes"))
            .withColumn(DAY, F.explode(F.sequence("opens", "closes"))))
    level = F.col("anchor_value")
    if mode == "linear":
        into = F.datediff(DAY, "anchor")
        span = F.datediff("next_anchor", "anchor")
        slope = (F.col("next_value") - F.col("anchor_value")) * into / span
        level = F.when(F.col("next_anchor").isNull() | (into <= 0), level).otherwise(level + slope)
    return days.select(DAY, SUB, level.alias(LEVEL_INPUT))


def with_national_level(levels: DataFrame) -> DataFrame:
    national = levels.groupBy(DAY).agg(
        F.coalesce(F.sum(LEVEL_INPUT), F.lit(0.0)).alias(LEVEL_INPUT))
    return levels.unionByName(national.withColumn(SUB, F.lit(NATIONAL)))


def annual_change(levels: DataFrame, rows: int = 365) -> DataFrame:
    """Percent change against the row one year earlier; zero where there is none."""
    before = F.lag(LEVEL_INPUT, rows).over(by_sub())
    change = F.try_divide(F.col(LEVEL_INPUT), before) - 1
    return levels.withColumn("industrial_var_anual", F.coalesce(change * 100, F.lit(0.0)))


def industrial_daily(monthly: DataFrame, first_day: Column, last_day: Column,
                     lag_months: int = PUBLICATION_LAG_MONTHS, mode: str = "linear",
                     run_up_days: int = 0) -> DataFrame:
    """Daily level and annual change for the subsystems and the nation.

    ``run_up_days`` builds the series that much earlier, so the annual change of the first year
    is real instead of zero; the extra days are returned too and drop out in the panel join.
    """
    levels = industrial_levels(monthly, F.date_sub(first_day, run_up_days), last_day,
                               lag_months, mode)
    return annual_change(with_national_level(levels))
