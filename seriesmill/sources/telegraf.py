"""JSON metrics {name, timestamp, fields, tags}: one point for each numeric or boolean field, all in the JVM."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.escape import path_escape, query_escape
from seriesmill.functions.numbers import is_number, wrap_u32


def encoded_tags(tags: Column) -> Column:
    """Keys sorted; `name` becomes `_name`, unless it is the only tag. Null and empty maps give an empty text."""
    entries = F.array_sort(F.map_entries(tags))
    one = F.size(entries) == 1
    pair = lambda e: F.concat(query_escape(F.when((e["key"] == "name") & ~one, F.lit("_name")).otherwise(e["key"])), F.lit("="), query_escape(e["value"]))
    return F.coalesce(F.array_join(F.transform(entries, pair), "&"), F.lit(""))


def metric_path(name: Column, field: Column, tags: Column, concat: str = "_") -> Column:
    end = F.when(field == "value", F.lit("")).otherwise(F.concat(F.lit(concat), path_escape(field)))
    return F.concat(path_escape(name), end, F.lit("?"), encoded_tags(tags))


def points(metrics: DataFrame, time: str = "timestamp", concat: str = "_") -> DataFrame:
    """The columns of metrics but fields, with Path, Value, Time. fields: a JSON object; texts in it, nested values and nulls give no points.

    metrics: name, fields (string), tags (map), the column of epoch seconds, and optionally `error`: rows with one are kept
    as they are, without a point.
    """
    failed = F.col("error").isNotNull() if "error" in metrics.columns else F.lit(False)
    fields = F.from_json("fields", "map<string,variant>")
    rows = metrics.select(*[F.col(c) for c in metrics.columns if c != "fields"], F.explode_outer(fields).alias("_field", "_variant"))
    kind = F.schema_of_variant("_variant")
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    value = F.when(number, F.try_variant_get("_variant", "$", "double")).when(
        kind == "BOOLEAN", F.try_variant_get("_variant", "$", "boolean").cast("double")
    )
    out = rows.withColumn("Value", value).where(failed | is_number(F.col("Value")))
    path = F.when(~failed, metric_path(F.col("name"), F.col("_field"), F.col("tags"), concat))
    return out.withColumns({"Path": path, "Time": wrap_u32(F.col(time))}).drop("_field", "_variant")


#: Kinds of a metric's parts in a payload; whatever else makes the whole payload an error.
_KINDS = {"name": "^STRING$", "timestamp": "^BIGINT$", "tags": "^OBJECT<", "fields": "^OBJECT<"}


def payload_metrics(payloads: DataFrame, body: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, name, timestamp, fields, tags, error of each metric of JSON payloads {"metrics": [...]}.

    A payload that is no JSON object, or in which a part has the wrong kind (a time that is no whole number, say), gives one
    row with its error and no metric. Missing or null parts are empty; a missing time is 0.
    """
    whole = F.try_parse_json(body)
    metrics = F.try_variant_get(whole, "$.metrics", "array<variant>")
    kind = lambda m, part: F.schema_of_variant(F.try_variant_get(m, f"$.{part}", "variant"))
    part_wrong = lambda m: reduce(or_, (~F.coalesce(kind(m, p), F.lit("VOID")).rlike(f"{k}|^VOID$") for p, k in _KINDS.items()))
    none = F.try_variant_get(whole, "$.metrics", "variant")
    error = (
        F.when(whole.isNull() | ~F.schema_of_variant(whole).rlike("^OBJECT<"), F.lit("no JSON object"))
        .when(metrics.isNull() & none.isNotNull() & (F.schema_of_variant(none) != "VOID"), F.lit("metrics: no list"))
        .when(F.exists(metrics, lambda m: ~F.schema_of_variant(m).rlike("^OBJECT<")), F.lit("metrics: no objects"))
        .when(F.exists(metrics, part_wrong), F.lit("metrics: wrong kind of a part"))
    )
    nothing = F.array(F.lit(None).cast("variant"))
    rows = payloads.select(*keep, error.alias("error"), metrics.alias("_m")).select(
        *keep, "error", F.explode(F.when(F.col("error").isNotNull(), nothing).otherwise(F.col("_m"))).alias("_m")
    )
    get = lambda part, kind: F.try_variant_get("_m", f"$.{part}", kind)
    stamp = F.when(F.col("error").isNull(), F.coalesce(get("timestamp", "bigint"), F.lit(0).cast("bigint")))
    # the fields of each metric stay a JSON text, so that their kinds can be told apart
    return rows.select(*keep, F.when(F.col("error").isNull(), F.coalesce(get("name", "string"), F.lit(""))).alias("name"), stamp.alias("timestamp"), F.to_json(get("fields", "variant")).alias("fields"), get("tags", "map<string,string>").alias("tags"), "error")
