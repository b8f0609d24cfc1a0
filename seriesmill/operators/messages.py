"""Messages delivered more than once (problem 4).

A message is what agrees in canonical path and Time. Its copies are ordered by arrival, then by seq; the first is kept.

Only 128-bit identifier hashes, the delivery order and the file-row position are shuffled. Each task first settles the
copies it can see itself (`settle`), so that a message with a third of all rows reaches the shuffle once per block of
rows, not once per copy. What loses becomes one bitmap per file and 32,768 rows (a deletion vector); reading the wide
rows then needs no shuffle at all, only the vectors of the files being read.

Defined results: rows with a null path or Time are no messages: nothing is deleted, and `kept_rows` leaves them out.
A null arrival comes after every other, a null seq after every other of the same arrival. Rows alike in all of that
are told apart by their position. Empty tables give empty results, and extra columns of any name are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.paths import canonical_path
from seriesmill.session import checkpoint

#: Rows that a task settles at once.
BLOCK_ROWS = 1 << 19
#: Rows per deletion vector: 32,768 bits, the size that bitmap_construct_agg builds.
VECTOR_ROWS = 32768
VECTOR_BYTES = 4096
#: Bytes of deletion vectors that may be broadcast at once; more are applied file group by file group.
BROADCAST_BYTES = 64 << 20
#: Rows with their paths go to so many times the usual number of tasks, so that each sorts its own in memory.
TASKS = 2
LATEST = np.iinfo(np.int64).max


def arrival(timestamp: str = "Timestamp", chunk: str = "chunk") -> Column:
    """When a row was received: its Timestamp; where that is null or 0, the whole seconds in its chunk's name."""
    from_chunk = F.expr(f"try_cast(substring_index(`{chunk}`, '.', -1) AS bigint) div 1000000000")
    return F.when(F.col(timestamp) != 0, F.col(timestamp)).otherwise(from_chunk)


def keyed(df: DataFrame, *columns: Column) -> DataFrame:
    """_path (canonical), Time, _arrival, _seq and the given columns of the rows that belong to a message."""
    return df.where(F.col("Path").isNotNull() & F.col("Time").isNotNull()).select(
        canonical_path(F.col("Path")).alias("_path"), F.col("Time").alias("Time"), arrival().alias("_arrival"), F.col("seq").alias("_seq"), *columns
    )


def id_hashes(path: Column, time: Column) -> list[Column]:
    """128 bits for a message: among 10^12 messages two share them with a probability below 10^-14."""
    return [F.xxhash64(path, time).alias("_k1"), F.xxhash64(time, F.lit(1), path).alias("_k2")]


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(name)
    return col.fill_null(LATEST).to_numpy(zero_copy_only=False) if col.null_count else col.to_numpy(zero_copy_only=False)


def losers(batch: pa.RecordBatch) -> np.ndarray:
    """Mask of the rows that some other row of the batch precedes in the same message."""
    k1, k2, at, seq = (_longs(batch, c) for c in ("_k1", "_k2", "_arrival", "_seq"))
    order = np.lexsort((seq, at, k2, k1))
    a, b = k1[order], k2[order]
    lost = np.zeros(len(order), bool)
    lost[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return lost


def in_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many, so that more copies meet."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def settle(df: DataFrame, mark: bool = False) -> DataFrame:
    """Drops the rows that lose within their task; with mark, keeps them under a column `_lost`.

    Marked losers get their position as identifier: wherever they are sent, they stand alone and spread evenly.
    """
    schema = df.schema if not mark else df.select("*", F.lit(True).alias("_lost")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_blocks(batches, BLOCK_ROWS):
            lost = losers(b)
            if not mark:
                yield b.filter(pa.array(~lost)) if lost.any() else b
                continue
            k1 = np.where(lost, _longs(b, "_row"), _longs(b, "_k1"))
            k2 = np.where(lost, _longs(b, "_file"), _longs(b, "_k2"))
            cols = [pa.array(k1) if f == "_k1" else pa.array(k2) if f == "_k2" else b.column(f) for f in b.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lost)], names=[*b.schema.names, "_lost"])

    return df.mapInArrow(run, schema)


def deliveries(df: DataFrame) -> DataFrame:
    """What the shuffle gets of each row of a message: identifier, delivery order, file and row."""
    position = F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    return keyed(df, *position).select(*id_hashes(F.col("_path"), F.col("Time")), "_arrival", "_seq", "_file", "_row")


def deleted(df: DataFrame) -> DataFrame:
    """_seq, _file, _row of every row of a message except its kept row. df must come from files."""
    order = Window.partitionBy("_k1", "_k2").orderBy(
        F.col("_arrival").asc_nulls_last(), F.col("_seq").asc_nulls_last(), "_file", "_row"
    )
    ranked = settle(deliveries(df), mark=True).withColumn("_rank", F.row_number().over(order))
    return ranked.where(F.col("_lost") | (F.col("_rank") > 1)).select("_seq", "_file", "_row")


def deletion_vectors(df: DataFrame) -> DataFrame:
    """(_file, _bucket, _bits): one bitmap of deleted rows per file and VECTOR_ROWS rows; none where all are kept."""
    at = deleted(df).select(
        "_file", F.expr(f"_row div {VECTOR_ROWS}").alias("_bucket"), (F.col("_row") % VECTOR_ROWS).cast("int").alias("_bit")
    )
    return at.repartition("_file", "_bucket").groupBy("_file", "_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def without_deleted(df: DataFrame, vectors: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of df that no vector deletes, read with all their columns and without a shuffle.

    Vectors within broadcast_bytes are sent to the tasks at once; where they are more, the files are read in groups
    whose vectors keep to it. `vectors` is read more than once, so it should be checkpointed.
    """
    sizes = vectors.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).orderBy("_file").collect()
    groups: list[list[int]] = [[]]
    filled = 0
    for r in sizes:
        if groups[-1] and (filled + r["n"]) * VECTOR_BYTES > broadcast_bytes:
            groups.append([])
            filled = 0
        groups[-1].append(r["_file"])
        filled += r["n"]
    names = df.columns
    wide = df.select(
        *[F.col(f"`{c}`") for c in names], F.xxhash64("_metadata.file_path").alias("_vf"), F.col("_metadata.row_index").alias("_vr")
    )
    if len(groups) == 1:
        return _apply(wide, vectors, names)
    bounds = [None, *[g[0] for g in groups[1:]], None]
    out = None
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        part, own = wide, vectors
        if lo is not None:
            part, own = part.where(F.col("_vf") >= lo), own.where(F.col("_file") >= lo)
        if hi is not None:
            part, own = part.where(F.col("_vf") < hi), own.where(F.col("_file") < hi)
        got = _apply(part, own, names)
        out = got if out is None else out.unionByName(got)
    return out


def _apply(wide: DataFrame, vectors: DataFrame, names: list[str]) -> DataFrame:
    bucket = F.expr(f"_vr div {VECTOR_ROWS}")
    # as 64-bit words, made once for each vector, so that a row's bit is found without making texts
    word = lambda i: F.conv(F.hex(F.substring("_bits", i * 8 + 1, F.lit(8))), 16, -10).cast("bigint")
    words = F.transform(F.sequence(F.lit(0), F.lit(VECTOR_BYTES // 8 - 1)), word).alias("_words")
    joined = wide.join(F.broadcast(vectors.select("_file", "_bucket", words)), (F.col("_vf") == F.col("_file")) & (bucket == F.col("_bucket")), "left")
    # the bytes of a word stand the other way round
    at = F.expr(f"cast(_vr % {VECTOR_ROWS} div 64 AS int)")
    bit = F.getbit(F.get("_words", at), F.expr("cast((7 - _vr % 64 div 8) * 8 + _vr % 8 AS int)"))
    return joined.where(F.col("_words").isNull() | (bit == 0)).select(*[F.col(f"`{c}`") for c in names])


def exactly_once(df: DataFrame) -> DataFrame:
    """df with exactly one row of each message, and the rows that are no messages as they are."""
    return without_deleted(df, checkpoint(deletion_vectors(df)))


def kept_rows(df: DataFrame, *columns: str) -> DataFrame:
    """The kept row of each message: path, day (UTC, days since 1970), Time, and the given columns of it.

    A Time that is no day's (beyond 32 bits of days) has no row here.

    Copies are settled in each task and then by message, which spreads them evenly however many a path has. Only then
    the kept rows of a path and day, at most 86,400, are brought together, sorted by Time: what follows within a path and
    day needs no further shuffle.
    """
    rows = settle(keyed(df, *[F.col(c).alias(c) for c in columns]).select(
        *id_hashes(F.col("_path"), F.col("Time")), "_arrival", "_seq", F.col("_path").alias("path"), "Time", *[c for c in columns if c != "seq"]
    )).drop("_k1", "_k2")
    order = Window.partitionBy("path", "Time").orderBy(F.col("_arrival").asc_nulls_last(), F.col("_seq").asc_nulls_last())
    parts = TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = rows.repartition(parts, "path", "Time").withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    day = F.expr("try_cast(floor(Time / 86400) AS int)").alias("day")
    kept = one.where(F.expr("try_cast(floor(Time / 86400) AS int) IS NOT NULL")).select("path", day, "Time", *[F.col("_seq").alias("seq") if c == "seq" else F.col(c) for c in columns])
    return kept.repartition(parts, "path", "day").sortWithinPartitions("path", "day", "Time")


def readings(df: DataFrame, *columns: str) -> DataFrame:
    """Kept rows whose Value is finite, as path, day, Time, value and the given columns."""
    rows = kept_rows(df, "Value", *columns).withColumnRenamed("Value", "value")
    return rows.where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")
