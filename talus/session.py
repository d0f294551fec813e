"""Session settings, and tables that cut a plan."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_session(master: str | None = None, partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """The session of this program. ``master`` stays what the launcher set if it is not given; ``shared``: the folder for tables between
    stages, which driver and executors must all see."""
    b = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for key, value in (("spark.master", master), ("spark.sql.shuffle.partitions", partitions), ("spark.checkpoint.dir", shared)):
        b = b.config(key, str(value)) if value else b
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a temporary one if everything runs on this machine; else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="talus-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_SCRATCH: list[list[Workspace]] = []


@contextmanager
def scratch():
    """Frees at its end every workspace that was opened inside: for steps whose result has been written by then."""
    own: list[Workspace] = []
    _SCRATCH.append(own)
    try:
        yield
    finally:
        _SCRATCH.remove(own)
        for ws in own:
            ws.drop()


class Workspace:
    """Tables of one run in the shared folder; ``drop`` frees those that nothing reads again."""

    def __init__(self, spark: SparkSession, name: str):
        for own in _SCRATCH:
            own.append(self)
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` written and read again: later stages don't recompute it, and a lost executor costs no more than a re-read."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """These tables, or the whole workspace."""
        for path in [f"{self.path}/{n}" for n in names] or [self.path]:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    ws = Workspace(df.sparkSession, "cut")
    out = ws.put("table", df)
    out._talus_workspace = ws
    return out


def counted(df: DataFrame, **sums: str) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates of the rows that are taken while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, *[F.expr(e).alias(k) for k, e in sums.items()]))
    return out, seen.get


def drop(df: DataFrame) -> None:
    """Frees what ``cut`` wrote."""
    df._talus_workspace.drop()
