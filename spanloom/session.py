"""Session helper, lineage cuts and row numbering."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Largest side that is ever sent to every executor, in rows. With vectors of 768 floats this is about 50 MB.
BROADCAST_ROWS = 16_384
BROADCAST_BYTES = 32 << 20


def get_session(app: str = "spanloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; `conf` adds to them (dots as `__`)."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, which do not share the driver's import path."""
    context = spark.sparkContext
    if getattr(context, "_spanloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():
        archive = Path(tempfile.mkdtemp(prefix="spanloom-ship-")) / "spanloom.zip"
        with zipfile.ZipFile(archive, "w") as handle:
            for source in sorted(package.rglob("*.py")):
                handle.write(source, source.relative_to(package.parent))
        # Spark copies the file to each executor, so a folder of the driver is all it needs.
        context.addPyFile(str(archive))
    context._spanloom_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by `spark.checkpoint.dir`. A temporary one is taken in local mode only."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="spanloom-checkpoint-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# The folders of the innermost `scratch`, those that are to be kept left out.
_SCRATCH: list[list[str]] = []


def shared_folder(spark: SparkSession, keep: bool = False) -> str:
    """A new folder below the checkpoint folder; inside `scratch` it is deleted at the end unless it is to be kept."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(folder)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the intermediate tables that are written inside, once what they were for is written elsewhere."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for folder in _SCRATCH.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, keep: bool = False, codec: str | None = None) -> DataFrame:
    """As `cut`, but written as Parquet: later reads take only the columns they need. `codec` names another compression."""
    folder = shared_folder(df.sparkSession, keep)
    (df.write.option("compression", codec) if codec else df.write).parquet(folder)
    return df.sparkSession.read.parquet(folder)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialised table for broadcast if its measured size is at most `most` bytes."""
    sizes = [
        F.octet_length(c) if kind in ("string", "binary") else F.size(c) * 16 if kind.startswith("array") else F.lit(8)
        for c, kind in df.dtypes
    ]
    row = sum((F.coalesce(size, F.lit(0)) for size in sizes), F.lit(16))
    measured = df.agg(F.sum(row.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if measured <= most else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows out by `key` if the scan has fewer splits than there are slots; large tables pass as they are."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots, key)


def number_rows(
    df: DataFrame,
    order_by: list[str],
    name: str = "row_id",
    unfold: Callable[[DataFrame], DataFrame] | None = None,
    keep: bool = False,
) -> DataFrame:
    """Number the rows 0, 1, 2 … in the order of `order_by`, which must be unique.

    The rows are range-partitioned and written once, compressed; only one count per partition meets in a single
    task, so the numbering does not pull the table through one window. `unfold` makes several rows of one behind the
    shuffle: `df` then has at least the first columns of `order_by`, and is dealt out by those it has.
    """
    dealt = df.repartitionByRange(*[c for c in order_by if c in df.columns])
    rows = (unfold(dealt) if unfold else dealt).sortWithinPartitions(*order_by)
    placed = store(rows.withColumn("_seen", F.monotonically_increasing_id()), keep, "zstd").withColumn(
        "_part", F.shiftright("_seen", 33)
    )
    # One row per partition: bounded by the number of tasks, hence small enough for every executor.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.col("_seen").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + within).drop(
        "_seen", "_part", "_start"
    )
