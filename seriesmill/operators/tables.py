"""The tables built from points (Path, Value, Time, Date, Timestamp). Batch and stream share them.

version is when the rows are uploaded and tree_date the date of the undated bands; both are parameters. Rows with a null
path give no rows. Duplicates are removed by dropDuplicates, which aggregates before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.paths import ancestor_prefixes, is_tagged, path_level, reverse_path, tag_list

#: Bands of Level, and the date of the undated ones.
REVERSE, TREE, REVERSE_TREE = 10000, 20000, 30000
TREE_DATE = "1970-02-12"


def points(df: DataFrame, zero_timestamp: bool = False) -> DataFrame:
    stamp = F.lit(0).cast("bigint") if zero_timestamp else F.col("Timestamp")
    return df.select("Path", "Value", "Time", "Date", stamp.alias("Timestamp"))


def points_reverse(df: DataFrame, zero_timestamp: bool = False) -> DataFrame:
    """Plain paths reversed, tagged ones as they are."""
    path = F.col("Path")
    return points(df.withColumn("Path", F.when(is_tagged(path), path).otherwise(reverse_path(path))), zero_timestamp)


def _row(date: Column, level: Column, path: Column) -> Column:
    return F.named_struct(F.lit("Date"), date, F.lit("Level"), level, F.lit("Path"), path)


def _days(df: DataFrame, tagged: bool) -> DataFrame:
    keep = is_tagged(F.col("Path"))
    return df.where(keep if tagged else ~keep).select("Date", "Path").dropDuplicates()


def index(df: DataFrame, version: int, tree_date: str = TREE_DATE, daily: bool = True) -> DataFrame:
    """Date, Level, Path, Version: each plain series by day, and the tree of all, both also reversed."""
    path, tree = F.col("Path"), F.lit(tree_date).cast("date")
    level, back = path_level(path), reverse_path(path)
    fixed = [_row(tree, level + TREE, path), _row(tree, level + REVERSE_TREE, back)]
    if daily:
        fixed += [_row(F.col("Date"), level, path), _row(F.col("Date"), level + REVERSE, back)]
    above = F.transform(ancestor_prefixes(path), lambda a: _row(tree, a["Level"] + TREE, a["Path"]))
    rows = _days(df, False).select(F.explode(F.concat(F.array(*fixed), above)).alias("r"))
    return rows.select("r.*").dropDuplicates().withColumn("Version", F.lit(version).cast("bigint"))


def tagged(df: DataFrame, version: int, name_only: Sequence[str] = ()) -> DataFrame:
    """Date, Tag1, Path, Tags, Version: a row for each tag of each tagged series and day.

    For the (unescaped) names in name_only, or with * for all, only the __name__ row; its Tags stay complete.
    """
    # No filter may need the tags (nor explode, which implies one): it would be moved below the deduplication, and the
    # tags be made for every point. Tagged paths with a name always have some.
    rows = _days(df.where(~F.startswith("Path", F.lit("?"))), True).withColumn("Tags", tag_list(F.col("Path")))
    name = F.get("Tags", F.lit(0))
    if "*" in name_only:
        tag = F.explode_outer(F.slice("Tags", 1, 1))
    elif name_only:
        few = name.isin([f"__name__={n}" for n in name_only])
        tag = F.explode_outer(F.when(few, F.slice("Tags", 1, 1)).otherwise(F.col("Tags")))
    else:
        tag = F.explode_outer("Tags")
    return rows.select("Date", tag.alias("Tag1"), "Path", "Tags", F.lit(version).cast("bigint").alias("Version"))


def tree(df: DataFrame, version: int, date: str | None = None, compat: bool = False) -> DataFrame:
    """[Date,] Level, Path, Version: every plain path and its ancestors once. compat: a path that ends in a dot has none."""
    path = F.col("Path")
    leaf = F.struct(path_level(path).alias("Level"), path.alias("Path"))
    above = ancestor_prefixes(path)
    if compat:
        above = F.when(F.endswith(path, F.lit(".")), F.array().cast("array<struct<Level:bigint,Path:string>>")).otherwise(above)
    rows = df.where(~is_tagged(path)).select("Path").dropDuplicates().select(F.explode(F.concat(F.array(leaf), above)).alias("r")).select("r.*").dropDuplicates()
    head = [F.lit(date).cast("date").alias("Date")] if date else []
    return rows.select(*head, "Level", "Path", F.lit(version).cast("bigint").alias("Version"))


def tree_of_dump(lines: DataFrame, line: str = "value") -> DataFrame:
    """path, level, month: each path of a tab-separated dump (path, value, time, day, ...) and its ancestors once, with the first day of
    the earliest month in which it stands. Lines with fewer than four columns give nothing."""
    cells = F.split(line, "\t", -1)
    rows = lines.where(F.size(cells) >= 4).select(cells[0].alias("Path"), cells[3].substr(1, 10).try_cast("date").alias("day"))
    month = rows.where("day IS NOT NULL").groupBy("Path").agg(F.trunc(F.min("day"), "month").alias("month"))
    path = F.col("Path")
    leaf = F.struct(path_level(path).alias("Level"), path.alias("Path"))
    nodes = month.select("month", F.explode(F.concat(F.array(leaf), ancestor_prefixes(path))).alias("r"))
    return nodes.groupBy(F.col("r.Path").alias("path")).agg(F.min("month").alias("month"), F.any_value("r.Level").alias("level"))


def series(df: DataFrame, version: int, reversed_path: bool = False) -> DataFrame:
    """Date, Level, Path, Version: a row for each plain series and day."""
    path = F.col("Path")
    rows = _days(df, False).select("Date", path_level(path).alias("Level"), (reverse_path(path) if reversed_path else path).alias("Path"))
    return rows.withColumn("Version", F.lit(version).cast("bigint"))


#: Builders by type, for configurations.
BUILDERS = {
    "points": lambda df, version, **kw: points(df, **kw),
    "points-reverse": lambda df, version, **kw: points_reverse(df, **kw),
    "index": index,
    "tagged": tagged,
    "tree": tree,
    "series": series,
    "series-reverse": lambda df, version, **kw: series(df, version, reversed_path=True, **kw),
}
