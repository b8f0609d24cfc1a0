"""Late and out-of-order events (problem 5), in Spark SQL only.

Every kept row falls in a cell of a triangle: the UTC hour of its Time (event period) by its arrival period. Period 0
is all that arrived before the hour's end, period j the j-th `period` seconds after it. Each cell is aggregated once;
a window over the cells of a series and hour, in order of arrival, then gives every revision of the hour's aggregate:
what was known at its end, and each correction. Cells beyond the cut-off are left out of it and listed as dropped.

Copies are settled by a window limited to its first row, which Spark also applies before the shuffle. A cell's
aggregate is partial before its shuffle, and a series and hour has at most cut-off/period + 1 cells.

Defined results: rows with a null path or Time are no messages. A row whose arrival can't be told counts as on time
(period 0). Values that are null, NaN or infinite count in `rows`, not in the other aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.operators.messages import keyed

#: The latest arrival that corrects: so many seconds after the end of the hour, the last one included.
CUT_OFF_S = 21600
PERIOD_S = 3600


def triangle_rows(df: DataFrame, period: int = PERIOD_S) -> DataFrame:
    """The kept rows with path, hour (its start), arrival, seq, value and arrival_period."""
    rows = keyed(df, F.col("Value").alias("value"))
    return df.sparkSession.sql(
        f"""
        SELECT path, hour, seq, value, arrival,
               CASE WHEN arrival >= hour + 3600 THEN greatest(1, (arrival - hour - 3600 + {period - 1}) div {period}) ELSE 0 END AS arrival_period
        FROM (SELECT _path AS path, Time - pmod(Time, 3600) AS hour, _seq AS seq, value, _arrival AS arrival,
                     row_number() OVER (PARTITION BY _path, Time ORDER BY _arrival ASC NULLS LAST, _seq ASC NULLS LAST) AS nth
              FROM {{rows}})
        WHERE nth = 1
        """,
        rows=rows,
    )


def _periods(cut_off: int, period: int) -> int:
    if cut_off % period:
        raise ValueError("the cut-off must be a multiple of the period")
    return cut_off // period


def late_rows(df: DataFrame, cut_off: int = CUT_OFF_S, period: int = PERIOD_S) -> DataFrame:
    """seq and outcome of the rows in the triangle's late cells: `corrects` up to the cut-off's cell, `dropped` beyond."""
    return df.sparkSession.sql(
        f"""
        SELECT seq, CASE WHEN arrival_period <= {_periods(cut_off, period)} THEN 'corrects' ELSE 'dropped' END AS outcome
        FROM {{cells}} WHERE arrival_period > 0
        """,
        cells=triangle_rows(df, period),
    )


def revisions(df: DataFrame, cut_off: int = CUT_OFF_S, period: int = PERIOD_S) -> DataFrame:
    """path, hour, arrival_period and the hour's aggregates as known after that arrival period.

    rows_new: rows that arrived in the period; rows, n, total, lowest, highest: of all rows so far; final: whether no
    later revision of the hour exists.
    """
    return df.sparkSession.sql(
        f"""
        WITH cells AS (
          SELECT path, hour, arrival_period, count(*) AS rows_new, count(good) AS n, sum(good) AS total, min(good) AS lowest, max(good) AS highest
          FROM (SELECT path, hour, arrival_period, CASE WHEN NOT isnan(value) AND abs(value) < double('infinity') THEN value END AS good
                FROM {{placed}} WHERE arrival_period <= {_periods(cut_off, period)})
          GROUP BY path, hour, arrival_period)
        SELECT path, hour, arrival_period, rows_new,
               sum(rows_new) OVER so_far AS rows, sum(n) OVER so_far AS n, sum(total) OVER so_far AS total,
               min(lowest) OVER so_far AS lowest, max(highest) OVER so_far AS highest,
               lead(arrival_period) OVER (PARTITION BY path, hour ORDER BY arrival_period) IS NULL AS final
        FROM cells
        WINDOW so_far AS (PARTITION BY path, hour ORDER BY arrival_period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        """,
        placed=triangle_rows(df, period),
    )
