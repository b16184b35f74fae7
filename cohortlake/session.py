"""Sessions, table loading and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(cpus: int = 8, shuffle_partitions: int = 8, app: str = "cohortlake") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("COHORTLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local master without one gets a temporary folder."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="spark-cohortlake-")
    return _FALLBACK[app]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        zipped = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-cohortlake-')}/cohortlake", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(zipped)
        _SHIPPED.add(app)


class Scratch:
    """Parquet tables in the shared folder that cut lineage and outlive executors.

    ``save`` writes and reads back; ``drop`` removes a table that no later plan reads. Tables that the
    result reads stay until the folder is cleared: a DataFrame is lazy, so nobody else knows its end.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:04d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path = getattr(t, "scratch_path", None)
            if path:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Run the actions inside with another number of shuffle partitions."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def block_offsets(counts: DataFrame, keys: list[str], block: str, value: str, out: str) -> DataFrame:
    """Exclusive prefix sums of ``value`` over ``block`` within ``keys``.

    ``counts`` has one row per (keys, block), so the window sees as many rows as there are blocks, a
    number the caller fixes, and never the rows behind them.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def blocked_cumsum(df: DataFrame, keys: list[str], order: list[str], block_of, value, out: str, blocks: int = 64) -> DataFrame:
    """Exclusive running sum of ``value`` within ``keys`` without one task per key.

    Rows are ordered by (block, order) where ``block_of`` is an expression in ``[0, blocks)``; sums per
    block give the offsets, and the window runs inside one block only. A key that holds a third of all
    rows is spread over ``blocks`` tasks. Rows whose block is null are not allowed.
    """
    from pyspark.sql import Window

    d = df.withColumn("_block", block_of).withColumn("_value", value)
    sums = d.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    offs = block_offsets(sums, keys, "_block", "_sum", "_off").select(*keys, "_block", "_off")
    cond = F.lit(True)
    left, right = d.alias("l"), offs.alias("r")
    for k in [*keys, "_block"]:
        cond = cond & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    j = left.join(right, cond).select("l.*", "r._off")
    w = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return j.withColumn(out, F.col("_off") + F.coalesce(F.sum("_value").over(w), F.lit(0))).drop("_block", "_value", "_off")
