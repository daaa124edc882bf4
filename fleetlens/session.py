"""Session settings the library relies on, and the shared working folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build(app: str = "fleetlens", master: str | None = None, partitions: int | None = None,
          extra: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution and UTC. On a cluster leave `master`
    and `partitions` unset, so that spark-submit and AQE decide."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in (extra or {}).items():
        b = b.config(key, value)
    return configure(b.getOrCreate())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the Python workers this package, wherever they run: Spark hands the
    archive out itself. Once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="fleetlens-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def configure(spark: SparkSession) -> SparkSession:
    """Timestamps are compared in UTC everywhere; workers know the package."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship(spark)
    return spark


@functools.lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="fleetlens-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the one the cluster names in spark.checkpoint.dir.

    Only a local master falls back to a folder of this machine: on a cluster
    other executors could not read it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df, name: str):
    """Write `df` to the shared folder and read it back: the plan starts anew
    from files, which survive the loss of any executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df):
    """`df` in at least as many partitions as there are cores, for work that costs far more than its bytes tell (a small file, or
    one that AQE made of few partitions, is one task). A table of more partitions than cores stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
