"""Cutting lineage in iterative jobs by tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary one is set only where there is none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="meshwright-net-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """The rows of ``df``, written once as Parquet and read back; a lost executor costs a reread, not the loop so far."""
    path = f"{shared_folder(df.sparkSession)}/net-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt to all shuffle partitions, for work that is heavy for its bytes: few files or small shuffles would leave it to few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


#: Rows from which edges are worth files of their own for every bucket of nodes.
MANY_ROWS = 4_000_000


def dealt(df: DataFrame, key: str, label: str = "dealt", many: int = MANY_ROWS) -> DataFrame:
    """The rows staged or, if they are many, in files by buckets of ``key``, so that joins on it move the other side only.

    They are counted before they are written, once and in one form: counting rows that are staged already, as edges are, reads nearly nothing.
    """
    if df.count() < many:
        return staged(df, label)
    spark, name = df.sparkSession, f"net_{label}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Dealt first, so that a bucket is one file.
    spread_out(df, key).write.format("parquet").bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    # The name was needed only to write buckets: what was read keeps its files and their layout.
    spark.sql(f"DROP TABLE {name}")
    return table


def any_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


#: Bytes of rows that a join may send to every executor, once a shuffle has counted them.
SENT = "10MB"
#: Bytes of the largest partition, once a shuffle has counted them, up to which a join keeps one side's rows in a table instead of sorting both.
HELD = "64MB"


def measured_joins(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query in a session that broadcasts no table by the size of its files, only by that of its rows.

    Parquet packs sequences and repeated values so well that millions of staged rows stay under Spark's limit for broadcasts, and rows
    exploded from them count as nothing; the driver would gather them whole.
    """

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", SENT)
        spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", HELD)
        return query(spark, sf_dir)

    return run
