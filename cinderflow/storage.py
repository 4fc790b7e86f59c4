"""Shared storage: where intermediate tables go, and how lineage is cut."""

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver can reach.

    A cluster names it in ``spark.checkpoint.dir``; without it a cluster gets an error. Only a local master,
    which is one machine, falls back to a folder of our own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or "file:///tmp/checkpoints/cinderflow").rstrip("/")


#: The innermost scratch() of this thread or task, if any.
_scratch: ContextVar["Scratch | None"] = ContextVar("scratch", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _scratch.get()) is not None:
        own.paths.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Removes a path that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Paths that fresh_path() gave out within one scratch(), and those of them that outlive it."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self) -> str:
        """The last path given out stays."""
        self.kept.add(self.paths[-1])
        return self.paths[-1]

    def keep_all(self) -> None:
        self.kept.update(self.paths)


@contextmanager
def scratch(spark: SparkSession):
    """Removes at its end, failed or not, what was written within it and not kept; what is kept belongs to the scratch around it.

    Paths belong to the thread (or task) that asked for them, so runs side by side never remove one another's tables.
    """
    own, outer = Scratch(), _scratch.get()
    token = _scratch.set(own)
    try:
        yield own
    except BaseException:
        own.kept.clear()
        raise
    finally:
        _scratch.reset(token)
        for path in own.paths:
            if path not in own.kept:
                remove(spark, path)
        if outer is not None:
            outer.paths += [p for p in own.paths if p in own.kept]


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and returns a scan of it.

    This cuts the lineage the way ``checkpoint()`` does, in a compressed columnar form, and a
    lost executor costs only a reread.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df itself if all its rows come straight from files, else df written and reread.

    For operators that number rows by partition and place: a task that runs again after its executor is lost must
    see the same rows in the same order, which rows fetched from a shuffle, or made by a program, don't promise.
    """
    return df if from_files(df) else written(df, name)


def from_files(df: DataFrame) -> bool:
    """Whether every leaf of df's physical plan is a scan of files and no shuffle or cache stands between."""
    nodes = [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        below = node.children()
        kind = node.getClass().getSimpleName()
        if not below.isEmpty():
            if "Exchange" in kind or "Adaptive" in kind or "Shuffle" in kind:
                return False
            nodes += [below.apply(i) for i in range(below.size())]
        elif kind not in ("FileSourceScanExec", "BatchScanExec"):
            return False
    return True


def sized(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df, settled, and the bytes of the files it scans. Statistics of other plans are guesses: 2^63 - 1 for a created frame, products for joins."""
    df = settled(df, name)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return df, sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


#: Rows and bytes of an Arrow batch to Python workers: whole texts are wide, and a worker holds a batch at a time.
ARROW_ROWS, ARROW_BYTES = 1000, 64 << 20
#: Up to so many ids (8 bytes each) are broadcast to leave rows out; above, both sides are shuffled.
BROADCAST_IDS = 500_000


def small(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """df, to be broadcast where it has at most so many (narrow) rows."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df without the rows whose key is in the one column of ids (null counts as a value)."""
    from pyspark.sql import functions as F

    away = written(ids.toDF("__away").distinct(), "away")
    if away.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        away = F.broadcast(away)
    return df.join(away, df[key].eqNullSafe(away["__away"]), "left_anti")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, which need not see the driver's folders, and bounds their batches."""
    import os
    import shutil
    import tempfile

    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_cinderflow_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="cinderflow-"), "cinderflow"), "zip", root, "cinderflow")
    sc.addPyFile(archive)
    sc._cinderflow_shipped = True
