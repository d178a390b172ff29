"""Session settings and the shared folder for settled tables."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "featlake", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the library relies on; what a running session has set already stays, unless asked for in ``conf``.

    Settled tables are dictionary-coded and compressed, so their files are taken as a third of their size in memory
    before a broadcast is planned.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.fileCompressionFactor": "3.0",
    }
    running = SparkSession.getActiveSession()
    known = set(running.conf.getAll) if running else set()
    for k, v in {**{k: v for k, v in defaults.items() if k not in known}, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_OWN: dict[str, str] = {}  # temporary folders of local sessions without a setting
_SEEN: set[tuple[str, str]] = set()  # disk folders of clusters that were found to be shared
_LOST: set[tuple[str, str]] = set()  # those that were found not to be


def _is_disk(spark: SparkSession, folder: str) -> bool:
    return folder.startswith("file:") or (folder.startswith("/") and spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:"))


def _is_shared(spark: SparkSession, folder: str) -> bool:
    """Whether rows that the executors write to ``folder`` are all read again."""
    path, n = f"{folder}/scratch/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/shared", 2 * spark.sparkContext.defaultParallelism
    rows = spark.range(0, n, 1, n)
    try:
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path).count() == n
    except (Py4JJavaError, PySparkException):  # some machine may not write or read there
        return False


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, or by the running context, or on a cluster one in the warehouse; a temporary one only for sessions of one process.

    A cluster needs a folder that all machines share. A disk path may be mounted everywhere, so it is tried once in each
    application: one from which not all rows come back is passed over, as settled tables would lose rows there.
    """
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    local = master.startswith("local") and not master.startswith("local-cluster")
    named = [spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()]
    if not local:
        named.append(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/featlake")
    named = [f.rstrip("/") for f in named if f]
    for folder in named:
        if local or (app, folder) in _SEEN or not _is_disk(spark, folder) or spark.conf.get("spark.featlake.mounted", "false") == "true":
            return folder
        if (app, folder) not in _LOST and _is_shared(spark, folder):
            _SEEN.add((app, folder))
            return folder
        _LOST.add((app, folder))
    if not local:
        raise RuntimeError(f"{', '.join(named)}: disk paths that not all machines share; set spark.checkpoint.dir to a folder every executor can reach")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="featlake-")
    return _OWN[app]


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The planner then knows the table's real size, so it broadcasts only what fits
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise plans a sort-merge join whose two
    sides are plain shuffles, which adaptive execution can split on hot keys. The lineage is
    cut in a place that survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more, before the application ends."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/settled/{spark.sparkContext.applicationId}/" in name:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, keys: list[str], most: int, weight: Column | None = None) -> DataFrame:
    """``df`` by hash of ``keys`` in partitions of about ``most`` rows, or of that sum of ``weight``; at least one for each core.

    The number of partitions is stated, so adaptive execution does not put them together again: what a task holds when its
    rows are cut into many more, or are all different, does not grow with the table.
    """
    total = df.agg(F.count(F.lit(1)) if weight is None else F.sum(weight)).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-int(total) // most)), *keys)


def busy(df: DataFrame) -> int:
    """How many cores a pass over a settled table keeps busy: its rows over those of the largest partition (a row group of a file is not parted)."""
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return sum(rows) // max(rows) if rows else 1


def dealt(df: DataFrame, least: int = 20_000) -> DataFrame:
    """``df``, a settled table, dealt over all cores if it lies in too few partitions and has more than ``least`` rows for one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * busy(df) < cores and df.count() > least * busy(df) else df


def release(spark: SparkSession) -> None:
    """Delete the settled tables and scratch files of this application; frames that read them can't be used any more."""
    jvm = spark.sparkContext._jvm
    for kind in ("settled", "scratch"):
        path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{kind}/{spark.sparkContext.applicationId}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared folder for files that a query writes and reads back."""
    return f"{shared_folder(spark)}/scratch/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
