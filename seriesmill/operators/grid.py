"""Irregular readings onto a regular grid (problem 1).

Each reading is a step function's piece: valid from its Time to the next reading of its series, for `hold` steps at most,
and not beyond the UTC day. The pieces are cut at the borders of the slots, and each slot gets the time-weighted mean of
the pieces in it and the fraction of it that they cover. A slot in which no reading lies is marked as missing, whatever
an earlier reading still covers of it.

Defined results: the grid of a series and day runs from the first to the last slot that holds a reading. Values that are
null, NaN or infinite are no readings. A series whose step no rule gives (or gives as 0 or less) has no grid.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from seriesmill.functions.rules import series_step
from seriesmill.operators.messages import readings


def validity_intervals(rows: DataFrame, hold: int = 1) -> DataFrame:
    """path, day, step, value, Time and upto: where the reading stops to be valid; next: the reading that follows."""
    following = Window.partitionBy("path", "day").orderBy("Time")
    return rows.withColumn("next", F.lead("Time").over(following)).withColumn(
        "upto", F.least("next", F.col("Time") + hold * F.col("step"), (F.col("day").cast("bigint") + 1) * 86400)
    )


def on_grid(df: DataFrame, rules: Iterable[Row], hold: int = 1) -> DataFrame:
    """path, day, slot, step, readings, value (time-weighted mean), coverage (0 to 1), missing.

    A gap of any length costs one row per slot; slots and intervals of a path and day stay in one partition, so the
    whole takes one shuffle.
    """
    rows = readings(df).withColumn("step", series_step(F.col("path"), rules)).where("step > 0")
    # from the reading's slot on, up to the slot before the next reading's (or with it, where this reading reaches into it)
    pieces = validity_intervals(rows, hold).withColumn(
        "slot",
        F.explode(
            F.expr(
                "sequence(Time - pmod(Time, step), coalesce(next - if(pmod(next, step) = 0, step, pmod(next, step)), Time - pmod(Time, step)), step)"
            )
        ),
    )
    held = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("slot") + F.col("step")) - F.greatest("Time", "slot"))
    cut = pieces.select("path", "day", "slot", "step", "value", held.alias("held"), (F.col("Time") >= F.col("slot")).cast("bigint").alias("own"))
    return cut.groupBy("path", "day", "slot").agg(
        F.any_value("step").alias("step"),
        F.sum("own").alias("readings"),
        (F.sum(F.when(F.col("held") > 0, F.col("value") * F.col("held"))) / F.sum(F.when(F.col("held") > 0, F.col("held")))).alias("value"),
        (F.sum("held") / F.any_value("step")).alias("coverage"),
        (F.sum("own") == 0).alias("missing"),
    )
