"""Where lineage is cut, and how large a side may be to be broadcast."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with more rows or bytes than this is joined by shuffling both sides instead.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of our own only where it is unset and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, read from reliable storage afterwards. For narrow rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again. For wide rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """Path of a new scratch folder in the shared folder; drop_written() removes it."""
    path = f"{shared_dir(spark)}/plumbline-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_written() -> None:
    """Delete the tables of written() and scratch(); results that still read them must have been saved."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone; its folder goes with the cluster's own clean-up
            return


atexit.register(drop_written)


def free(name: str, columns: list[str]) -> str:
    """name, lengthened until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most rows rows and size bytes (as JSON), else df as it is.

    df should be stored already, as it is read for that.
    """
    n, held = df.agg(F.count("*"), F.sum(F.length(F.to_json(F.struct(*[df[c] for c in df.columns]))))).first()
    return F.broadcast(df) if n <= rows and (held or 0) <= size else df


def stable(df: DataFrame) -> DataFrame:
    """df such that its rows have the same numbers (monotonically_increasing_id) whenever it is computed.

    That holds for filters and projections of files; all else is written first.
    """

    def narrow(plan) -> bool:  # noqa: ANN001
        below = [plan.children().apply(k) for k in range(plan.children().size())]
        return plan.nodeName() in ("Project", "Filter") and all(map(narrow, below)) if below else plan.nodeName() == "LogicalRelation"

    return df if narrow(df._jdf.queryExecution().optimizedPlan()) else written(df, "rows")
