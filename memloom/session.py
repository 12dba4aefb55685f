"""Session helpers: table loading, shared scratch tables, hot-key aware joins.

Scratch tables live below the folder that the session names in
``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a folder
of our own is taken.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dimension may be broadcast up to this many rows of a few bytes each.
BROADCAST_ROWS = 100_000
#: Keys that hold more than 1/HOT_SHARE of all rows are joined apart; there are fewer than HOT_SHARE of them.
HOT_SHARE = 200
#: Own folders, by application.
_own: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; made up for a session that names none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        app = spark.sparkContext.applicationId
        conf = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="memloom-"))
    return conf.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/memloom/{name}-{uuid.uuid4().hex}"


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Delete what is there when the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a scratch table and read it back: the lineage ends here and survives lost executors.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str, pieces: int) -> DataFrame:
    """``df`` by ``key`` over as many partitions as the session asks for, or over ``pieces`` if those are more.

    So a group of partitions never grows with the data because the session was set up for less of it.
    """
    return df.repartition(pieces, key) if pieces > parallelism(df.sparkSession) else df.repartition(key)


def hot_join(rows: DataFrame, dim: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``dim`` (unique on ``keys``; ``count`` = rows with that key).

    Keys above ``total / HOT_SHARE`` rows - fewer than HOT_SHARE by
    construction - are joined by broadcast, so one key that holds a third of all
    rows never meets in one task; the others are joined by shuffle.
    """
    limit = max(1, total // HOT_SHARE)
    hot, cold = dim.filter(F.col(count) > limit), dim.filter(F.col(count) <= limit)
    mark = hot.select(*keys, F.lit(True).alias("__hot"))
    tagged = rows.join(F.broadcast(mark), keys, "left")
    apart = tagged.filter("__hot").drop("__hot").join(F.broadcast(hot), keys)
    rest = tagged.filter("__hot IS NULL").drop("__hot").join(cold, keys)
    return apart.unionByName(rest)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
