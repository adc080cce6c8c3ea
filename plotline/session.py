"""A session with the settings the engine counts on, and tables in the folder a cluster shares."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "plotline", master: str | None = None, **conf: str) -> SparkSession:
    """Time zone UTC, adaptive execution on. Memory and partitions are the cluster's to set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, as in tests, under a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="plotline-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Whether Spark deletes what a query has shuffled when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """What queries shuffle in here is deleted as each of them ends; otherwise it stays until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: later steps neither compute it again nor depend on executors that hold it."""
    path = shared_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row, however often later steps use them and whatever they filter by: a generator is not inlined as a projection is."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over as many tasks as shuffles have partitions, for work that is heavy by the row and small by its bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows that one task takes of a table whose size is counted.
TASK_ROWS = 250_000


def tasks_for(df: DataFrame) -> int:
    """As many tasks as shuffles have partitions, or as give each TASK_ROWS rows at most; counting a stored table reads its footers."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_ROWS))
