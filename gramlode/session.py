"""Session set-up, the shared scratch folder, and scan spreading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one task turns into grams, which take many times its memory.
TASK_BYTES = 4 << 20

_local_scratch: dict[str, str] = {}


def build_session(app: str = "gramlode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested with.

    A cluster's own submit settings win: nothing here fixes the number of executors or their memory.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # a shuffled side whose partitions turn out small is hashed instead of sorted
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the folder named in ``spark.checkpoint.dir``. Only a local session, where driver and tasks share one disk,
    may go without that setting; it then gets one temporary folder per application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="gramlode-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the scratch folder that nothing else uses."""
    return f"{scratch_dir(spark)}/gramlode/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the scratch folder, in partitions ``by`` some columns, and read it back: later steps reuse the
    table instead of recomputing it, also after an executor was lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*(by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Spread a plain file scan by ``keys`` when it has fewer partitions than the session has cores.

    Small or single-row-group files would otherwise keep all text work in a task or two. A large table has many more
    splits than cores and passes through unshuffled. Only meant for scans: asking for the partition count of a plan
    with a shuffle in it would run that shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)


def spread_by_size(rows: DataFrame, text: str, *keys: str, size: int = TASK_BYTES) -> DataFrame:
    """Place ``rows`` by ``keys`` in as many partitions as leave about ``size`` bytes of ``text`` to each, however many there
    are. The number is counted and given, so small partitions are not put together again."""
    total = rows.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // size)), *keys)
