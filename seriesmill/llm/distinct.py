"""Distinct counts over huge identifier sets (problem 3): sketches of the k smallest hash values.

A sketch is a set of rows (group columns, h): the at most k smallest distinct hashes of the group's identifiers. Merging
is union, distinct, and keeping the k smallest again, so partial results of tasks, days or stores combine in any order
and to the same result. Each task keeps only k hashes of a group before anything is shuffled; sketches of Date and of
Level come from those of (Date, Level), not from the rows.

Fewer than k hashes are an exact count. With k, the k-th smallest of n uniform hashes in (0, 1) is u: n is estimated as
(k - 1) / u with a relative standard error of 1 / sqrt(k - 2), and the bounds are those of the Gamma law of n * u (Wilson and
Hilferty's approximation). Of two sketches the k smallest of the union estimate the union; the share of these found in
both (or in the first only) estimates intersection and difference, with Wilson's bounds for a share.

Defined results: null identifiers aren't counted. Null is a group like any other. Empty tables give no groups. Hashes
are the first 60 bits of MD5: with n identifiers the chance that two collide is below n^2 / 2^61.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 1024
BITS = 60
#: Quantile of the normal law for the bounds: 95 %.
Z = 1.959964


def hash60(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _smallest(df: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
    """The k smallest distinct h of each group. Spark limits the window before its shuffle as well."""
    order = Window.partitionBy(*groups).orderBy("h")
    return df.distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select(*groups, "h")


def _within_tasks(df: DataFrame, groups: Sequence[str], k: int) -> DataFrame:
    """Of each task's rows only the k smallest distinct h of each group, so that no group's rows are shuffled as a whole."""

    def keep(t: pa.Table) -> pa.Table:
        ids = np.zeros(t.num_rows, np.int64)
        for g in groups:
            code = t[g].combine_chunks()
            code = code.chunk(0) if isinstance(code, pa.ChunkedArray) else code
            which = code.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            _, ids = np.unique(ids * (which.max(initial=0) + 1) + which, return_inverse=True)
        h = t["h"].to_numpy()
        order = np.lexsort((h, ids))
        i, v = ids[order], h[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (v[1:] != v[:-1])
        order, i = order[new], i[new]
        first = np.searchsorted(i, i)
        return t.take(pa.array(order[np.arange(len(i)) - first < k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= 1 << 19:
                held = keep(pa.Table.from_batches(held)).combine_chunks().to_batches()
                rows = sum(x.num_rows for x in held) // 2  # sketches of many groups may stay large: don't sort them each time
        if held:
            yield from keep(pa.Table.from_batches(held)).to_batches()

    return df.mapInArrow(run, df.schema)


def sketch(df: DataFrame, identifier: str, groups: Sequence[str], k: int = K) -> DataFrame:
    """The sketch of each group: its columns and h."""
    rows = df.where(F.col(identifier).isNotNull()).select(*[F.col(g) for g in groups], hash60(F.col(identifier)).alias("h"))
    return _smallest(_within_tasks(rows, groups, k), groups, k)


def merge(sketches: DataFrame, groups: Sequence[str], k: int = K) -> DataFrame:
    """The sketches of coarser groups (or the union of more sketches): nothing but the hashes is needed."""
    return _smallest(sketches.select(*groups, "h"), groups, k)


def merge_groupings(sketches: DataFrame, groupings: Sequence[Sequence[str]], k: int = K) -> DataFrame:
    """merge for several groupings in one pass: grouping (names joined by +), all their columns (null where not grouped by), and h."""
    names = list(dict.fromkeys(c for g in groupings for c in g))
    kinds = {c: sketches.schema[c].dataType for c in names}
    one = lambda g: F.struct(F.lit("+".join(g)).alias("grouping"), *[(F.col(c) if c in g else F.lit(None).cast(kinds[c])).alias(c) for c in names])
    each = sketches.select(F.explode(F.array(*[one(g) for g in groupings])).alias("g"), "h").select("g.*", "h")
    return _smallest(each, ["grouping", *names], k)


def _bounds(estimate: Column, k: Column) -> tuple[Column, Column]:
    """Bounds of n given the estimate (k - 1) / u: n * u has the Gamma law of shape k."""
    u = (k - 1) / estimate
    q = lambda z: k * F.pow(1 - 1 / (9 * k) + z / (3 * F.sqrt(k)), F.lit(3.0))
    return q(F.lit(-Z)) / u, q(F.lit(Z)) / u


def estimates(sketches: DataFrame, groups: Sequence[str], k: int = K) -> DataFrame:
    """The groups with kept (hashes), estimate, low, high, exact."""
    per = sketches.groupBy(*groups).agg(F.count(F.lit(1)).alias("kept"), F.max("h").alias("_last"))
    n = F.col("kept").cast("double")
    exact = F.col("kept") < k
    guess = (n - 1) / ((F.col("_last") + 1) / F.lit(float(1 << BITS)))
    low, high = _bounds(guess, n)
    return per.select(
        *groups, "kept", F.when(exact, n).otherwise(guess).alias("estimate"),
        F.when(exact, n).otherwise(F.greatest(low, n)).alias("low"), F.when(exact, n).otherwise(high).alias("high"), exact.alias("exact"),
    )


def set_estimates(left: DataFrame, right: DataFrame, on: Sequence[str], k: int = K) -> DataFrame:
    """For each group of both: estimate, low and high of `union`, `both` (in both) and `only` (in the left, not in the right)."""
    marked = left.withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(right.withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1)))
    sizes = marked.groupBy(*on).agg(F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr")).where("_nl > 0 AND _nr > 0")
    order = Window.partitionBy(*on).orderBy("h")
    seen = marked.groupBy(*on, "h").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    per = seen.groupBy(*on).agg(
        F.count(F.lit(1)).cast("double").alias("m"), F.max("h").alias("_last"),
        F.sum(F.col("_l") * F.col("_r")).alias("_both"), F.sum(F.col("_l") * (1 - F.col("_r"))).alias("_only"),
    )
    # both sketches hold all of their group: the union is exact if it has fewer than k; a sketch of k hides larger ones
    exact = F.col("m") < k
    guess = F.when(exact, F.col("m")).otherwise((F.col("m") - 1) / ((F.col("_last") + 1) / F.lit(float(1 << BITS))))
    low, high = _bounds(guess, F.col("m"))
    out = per.withColumn("union", guess).withColumn("union_low", F.when(exact, guess).otherwise(low)).withColumn("union_high", F.when(exact, guess).otherwise(high))
    for name, hits in (("both", "_both"), ("only", "_only")):
        p, m, zz = F.col(hits) / F.col("m"), F.col("m"), Z * Z
        mid, half = (p + zz / (2 * m)) / (1 + zz / m), Z * F.sqrt(p * (1 - p) / m + zz / (4 * m * m)) / (1 + zz / m)
        out = (
            out.withColumn(name, p * F.col("union"))
            .withColumn(f"{name}_low", F.when(exact, F.col(name)).otherwise(F.greatest(F.lit(0.0), mid - half) * F.col("union_low")))
            .withColumn(f"{name}_high", F.when(exact, F.col(name)).otherwise((mid + half) * F.col("union_high")))
        )
    names = [f"{n}{e}" for n in ("union", "both", "only") for e in ("", "_low", "_high")]
    return out.join(sizes.select(*on), list(on), "left_semi").select(*on, *names)
