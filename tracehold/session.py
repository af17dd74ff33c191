"""Session settings and shared scratch space."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> SparkSession:
    """Times are UTC everywhere; everything else is left to the cluster's own settings."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def utc(t: dt.datetime) -> dt.datetime:
    """A time of ours, which carries no zone, as UTC whatever the driver's own zone is."""
    return t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the one the cluster names. Only where driver and executors are
    one process may it be a local one; on a cluster a run without a shared folder is refused."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tracehold-")
    sc.setCheckpointDir(local)
    return local


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut the lineage with a table written to the shared folder, so a lost executor costs no earlier
    round. Unlike a checkpoint it is computed once, and its size is known to the next join."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nothing(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """No rows of a schema, as a relation that Spark knows to be empty: what is read or joined with it is left
    out of a plan, where rows made in Python are of unknown size and are shuffled for."""
    fields = (T.DataType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return spark.range(1).filter("false").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def plain_times(df: DataFrame) -> DataFrame:
    """Timestamps without a zone, so an answer reads the same whatever the reader's zone is."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields
                           if isinstance(f.dataType, T.TimestampType)})
