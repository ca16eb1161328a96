"""Session facts the operators share: tables, the shared folder, materialising."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}
_CLEANED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the setting is missing and the master is local (tests, a laptop) a
    temporary folder of this machine takes its place; it is removed when Python
    ends. On a cluster its executors would write to disks of their own, so there
    the missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="corpusmill-")
        atexit.register(shutil.rmtree, _OWN_DIR[app], ignore_errors=True)
    return "file://" + _OWN_DIR[app]


def own_dir(spark: SparkSession) -> str:
    """This application's folder inside the shared one; it is removed when Python ends."""
    path = f"{shared_dir(spark)}/corpusmill/{spark.sparkContext.applicationId}"
    if path not in _CLEANED:
        _CLEANED.add(path)
        atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    """Delete a folder of tables; what can't be reached any more is left."""
    if "://" not in path or path.startswith("file:"):
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
        return
    try:
        sc = SparkSession.getActiveSession().sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  (the session may have ended first)
        return


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage like a checkpoint, survives lost executors, and, unlike
    ``checkpoint()``, keeps Parquet's column pruning and filter pushdown for
    what is read later.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that :func:`materialise` wrote for ``df``, which must not be read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(path)


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """``df`` on the driver, after proving that it has at most ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark ``df`` for a broadcast only if it has at most ``max_rows`` rows.

    Otherwise it comes back unmarked and Spark joins it with a shuffle (AQE
    splits skewed partitions).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def tasks_for(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """Partitions for a sort by hand of ``df``: as many as the session has, or more if its sources hold more.

    Sources are taken at the size Spark knows before it reads them; those of unknown
    size (rows made in the driver) don't count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)
    return max(cores(df.sparkSession), -(-known // bytes_each))


def cores(spark: SparkSession) -> int:
    """Partitions for work that is spread by hand; follows the session."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for steps that work long on a row.

    Only an input of fewer partitions, a small one, is shuffled for that.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
