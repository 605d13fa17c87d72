"""Tables whose partitions are replaced as one step.

Below a table's folder, ``data/version=…/`` holds what each run wrote and ``manifests/`` the list of the partitions that
count and the version of each. A run writes its data first, beside everything else, then a new manifest under a temporary
name, and renames it last. Readers take the newest manifest: before the rename they see all of the old rows, after it all
of the new ones, and a run that fails in between has changed nothing. Two runs that end at the same time cannot both
take the next number; the later one fails and may be repeated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramlode.operators.sizing import fits_broadcast


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    folder, system = _files(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(folder)) if system.exists(folder) else []


def _newest(spark: SparkSession, root: str) -> int:
    numbers = [int(name) for name in _names(spark, f"{root}/manifests") if name.isdigit()]
    return max(numbers, default=0)


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """The partitions of the table and the version that counts of each; None before the first run was published."""
    newest = _newest(spark, root)
    return spark.read.parquet(f"{root}/manifests/{newest:012d}") if newest else None


def stage(df: DataFrame, root: str, partitions: list[str], version: str) -> None:
    """Write a run's rows, which no reader sees yet. Running it again under the same name replaces what is there.

    Rebalancing on the partition columns gives few files per partition and splits one that is much larger than the rest.
    """
    spark = df.sparkSession
    folder, system = _files(spark, f"{root}/empty")
    if not system.exists(folder):  # the columns, also when there are no rows
        df.where("false").coalesce(1).write.mode("overwrite").parquet(f"{root}/empty")
    spread = df.hint("rebalance", *[F.col(c) for c in partitions])
    spread.write.mode("overwrite").partitionBy(*partitions).parquet(f"{root}/data/version={version}")


def _staged(spark: SparkSession, root: str, versions: list[str]) -> DataFrame:
    """The rows of some versions; the folders of others are not even listed."""
    schema = T.StructType([*spark.read.parquet(f"{root}/empty").schema, T.StructField("version", T.StringType())])
    paths = [f"{root}/data/version={v}" for v in versions]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*paths)


def publish(spark: SparkSession, root: str, replaced: DataFrame, version: str) -> None:
    """Make a staged run count for the partitions in ``replaced``, whose columns are the partition columns; a partition
    that the run has no rows for is empty from now on."""
    partitions = replaced.columns
    newest = _newest(spark, root)
    new = _staged(spark, root, [version]).where(F.col("version") == version).select(*partitions, "version").distinct()
    new = new.join(replaced, partitions, "left_semi")
    if newest:
        new = manifest(spark, root).join(replaced, partitions, "left_anti").select(*partitions, "version").unionByName(new)
    draft, final = f"{root}/drafts/{uuid.uuid4().hex}", f"{root}/manifests/{newest + 1:012d}"
    new.coalesce(1).write.parquet(draft)
    (source, system), (target, _) = _files(spark, draft), _files(spark, final)
    system.mkdirs(target.getParent())
    if system.exists(target) or not system.rename(source, target):
        raise RuntimeError(f"{final} was written by another run meanwhile")


def replace(df: DataFrame, root: str, replaced: DataFrame, version: str | None = None) -> None:
    """Write ``df`` and let it count for the partitions in ``replaced``, a stored table. Named versions make it safe to
    repeat a run."""
    version = version or f"v-{uuid.uuid4().hex}"
    stage(df, root, replaced.columns, version)
    publish(df.sparkSession, root, replaced, version)


def read(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the newest manifest. Folders of versions that it does not name are not opened."""
    current = manifest(spark, root)
    if current is None:
        raise FileNotFoundError(f"no published version below {root}")
    versions = [row.version for row in current.select("version").distinct().collect()]
    rows = _staged(spark, root, versions)
    partitions = [c for c in current.columns if c != "version"]
    listed = F.broadcast(current) if fits_broadcast(current) else current
    kept = rows.where(F.col("version").isin(versions)).join(listed, [*partitions, "version"], "left_semi")
    return kept.select(*[c for c in rows.columns if c != "version"])


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Remove the versions that no partition needs any more, drafts and older manifests; the names of the versions."""
    newest = _newest(spark, root)
    if not newest:
        return []
    needed = {f"version={row.version}" for row in manifest(spark, root).select("version").distinct().collect()}
    gone = [name for name in _names(spark, f"{root}/data") if name.startswith("version=") and name not in needed]
    old = [name for name in _names(spark, f"{root}/manifests") if name != f"{newest:012d}"]
    for path in [*(f"data/{n}" for n in gone), *(f"manifests/{n}" for n in old), "drafts"]:
        folder, system = _files(spark, f"{root}/{path}")
        system.delete(folder, True)
    return [name.removeprefix("version=") for name in gone]
