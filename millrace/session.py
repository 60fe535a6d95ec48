"""Session factory, table loader and the one way this engine cuts lineage."""

from __future__ import annotations

import functools
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "millrace", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widened(df: DataFrame) -> DataFrame:
    """The rows of a scan, dealt to all cores where its files have fewer row groups than that.

    For maps that cost far more than moving their rows. A table of many files stays as it is,
    without a shuffle. Not for what comes after a shuffle, which would be run to be counted.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._conf.get("millrace.scratch", None)
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="millrace-")
            spark.sparkContext._conf.set("millrace.scratch", found)
    return found


_LOCAL = threading.local()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _scopes() -> list[list[str]]:
    if not hasattr(_LOCAL, "scopes"):
        _LOCAL.scopes = []
    return _LOCAL.scopes


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back.

    The files survive the loss of any executor and are columnar and compressed. Inside a
    ``scratched`` function they go when it is done; others are left to the cleaning of the
    folder, since later plans may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    # the shuffle files of a plan whose result is written are of no more use
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    if _scopes():
        _scopes()[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that no later plan reads."""
    _delete(df.sparkSession, df._settled)
    for scope in _scopes():
        if df._settled in scope:
            scope.remove(df._settled)


def scratched(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Settle what the function returns, then delete all that was settled inside it.

    Also asks the JVM to collect garbage, upon which Spark frees the shuffle files of plans
    that nothing refers to any more.
    """

    @functools.wraps(plan)
    def run(*args, **options) -> DataFrame:
        scopes = _scopes()
        scopes.append([])
        try:
            out = plan(*args, **options)
        finally:
            inner = scopes.pop()
        kept = settle(out, plan.__name__.strip("_"))
        spark = kept.sparkSession
        for path in inner:
            _delete(spark, path)
        del out
        gc.collect()
        spark._jvm.System.gc()
        return kept

    return run


#: Bytes of a table's files up to which a ``modest`` function's joins may broadcast it.
BROADCAST = 1 << 18


def modest(plan: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """What the function runs broadcasts tables of at most BROADCAST bytes, or less if the session allows less.

    Spark goes by the size of the files; keys that compress well are many times as large in the driver, which
    makes a table of them for the broadcast.
    """

    @functools.wraps(plan)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        spark, name = df.sparkSession, "spark.sql.autoBroadcastJoinThreshold"
        before = spark.conf.get(name)
        if spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() > BROADCAST:
            spark.conf.set(name, str(BROADCAST))
        try:
            return plan(df, *args, **options)
        finally:
            spark.conf.set(name, before)

    return run
