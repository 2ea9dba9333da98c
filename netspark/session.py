"""Sessions and the shared folder in which intermediate tables are stored."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("netspark")
        .config("spark.sql.shuffle.partitions", str(cores)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_own: dict[str, str] = {}  # folders made for local sessions, by application


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-stored-")
    return _own[context.applicationId]


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df computed once, as a table of its own in the shared folder.

    What reads it recovers from there when an executor is lost, and its size is
    known to the planner. The folder goes when the driver ends; a loop names the
    table that it needs no more, which goes at once.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.deleteOnExit(path)
    df.write.option("compression", "zstd").parquet(path.toString())
    made = spark.read.schema(df.schema).parquet(path.toString())
    made._stored_at = (files, path)
    if instead_of is not None:
        discard(instead_of)
    return made


def discard(*tables: DataFrame) -> None:
    """Removes what `cut` stored for these tables; nothing may read them any more."""
    for table in tables:
        if hasattr(table, "_stored_at"):
            files, path = table._stored_at
            files.delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, most_rows: int = 100_000, most_bytes: int = 16 << 20) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes of values; else as it is."""
    wide = [F.octet_length(f.name) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    size = sum([F.coalesce(c, F.lit(0)) for c in wide], F.lit(16 * len(df.columns)))
    found = df.limit(most_rows + 1).select(size.alias("b")).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(df) if found.n <= most_rows and (found.b or 0) <= most_bytes else df
