"""Intermediate tables in the folder that all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where that is unset on one machine (tests) a folder of our own is made and set."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    now = at.get() if at.isDefined() else None
    if now is None:
        want = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not want:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            want = _OWN.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="cladeworks-"))
        sc.setCheckpointDir(want)
        now = sc._jsc.sc().getCheckpointDir().get()
    return now


def stage(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back: cuts lineage, survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables written by :func:`stage` with the same columns, as one scan."""
    spark = tables[0].sparkSession
    return spark.read.schema(tables[0].schema).parquet(*(t._staged for t in tables))


def stage_counted(df: DataFrame, name: str = "t") -> tuple[DataFrame, int]:
    """:func:`stage` and the number of rows, which is observed while they are written."""
    seen = Observation()
    out = stage(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Has a path in the shared folder deleted when the process ends."""
    atexit.register(_delete, spark, path)


def unstage(df: DataFrame) -> None:
    """Delete a table written by :func:`stage` that no later plan reads."""
    for f in df.inputFiles()[:1]:
        _delete(df.sparkSession, f.rpartition("/")[0])


#: Rows up to which :func:`small` has a table broadcast.
SMALL = 50_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else unmarked. Starts a job that reads no more than that."""
    return marked(df, df.limit(rows + 1).count(), rows)


def marked(df: DataFrame, n: int, rows: int = SMALL) -> DataFrame:
    """:func:`small` for a table whose number of rows ``n`` is known."""
    return F.broadcast(df) if n <= rows else df


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass
