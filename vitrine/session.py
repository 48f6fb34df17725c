"""Session settings and the shared folder used for checkpoints and snapshots."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_CUTS: dict[str, list[str]] = {}


def build_session(app_name: str = "vitrine", cpus: int | str | None = None) -> SparkSession:
    """A session for local runs. On a cluster, spark-submit provides master and sizes."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if cpus is not None:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(cpus if cpus != "*" else 8))
            .config("spark.driver.memory", "12g")
        )
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master may go without the setting; it then gets a fresh
    temporary folder. On a cluster a machine-local folder would be lost with
    its machine, so a missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="vitrine-")
    return _LOCAL_DIRS[app]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder.

    It survives the loss of executors, and later reads of it still prune
    columns and push filters down, and texts take half the space that the default
    compression needs. ``release`` or ``scratch`` delete it.
    """
    path = fresh_dir(df.sparkSession, "stage")
    _CUTS.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, kept: int = 0) -> int:
    """Delete the tables of ``cut_lineage`` but the first ``kept``; returns how many. Results that
    have not been written or collected yet may still read them."""
    made = _CUTS.get(spark.sparkContext.applicationId, [])
    gone, made[kept:] = made[kept:], []
    for path in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(gone)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables of ``cut_lineage`` made inside are deleted at the end: write or collect results before."""
    before = len(_CUTS.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)
