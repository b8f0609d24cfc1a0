import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture
def column(spark):
    """The values of an expression over a column x of texts."""

    def run(make, values, kind="string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r[1] for r in sorted(df.select("i", make(F.col("x"))).collect())]

    return run


GRAPHITE = "seq bigint, chunk string, Path string, Value double, Time bigint, Date date, Timestamp bigint"


@pytest.fixture
def graphite(spark, tmp_path):
    """Writes points (seq, Path, Value, Time, Timestamp[, chunk]) as a parquet table and reads it."""

    def make(rows, extra=()):
        full = [(r[0], (r[5] if len(r) > 5 else f"default.{r[4] or 0}000000000"), r[1], r[2], r[3], None, r[4]) for r in rows]
        df = spark.createDataFrame(full, GRAPHITE)
        for name, value in extra:
            df = df.withColumn(name, value)
        out = str(tmp_path / f"graphite{len(list(tmp_path.iterdir()))}.parquet")
        df.repartition(2).write.parquet(out)
        return spark.read.parquet(out)

    return make
