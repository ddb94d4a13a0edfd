"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ids given to rows without an id start here, so that they come after every real one.
NO_ID = 1 << 62
# Texts may be long, so few rows travel in one Arrow batch.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, as single texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def own_id(key: Column, *content: Column) -> Column:
    """`key`, or for rows without one an id made from their content, above NO_ID."""
    made = F.lit(NO_ID) + F.xxhash64(*content).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(key.cast("bigint"), made)


@dataclass(frozen=True)
class Ids:
    """Ids of rows of which some have none; the made ones come from the content and after all given ones.

    `first` is the smallest id that can be a made one, NULL if no row lacks an id. Given ids from NO_ID upward leave no
    room above, so they are moved to the negative numbers, which then must be free.
    """

    first: int | None

    def own(self, key: Column, *content: Column) -> Column:
        key = key.cast("bigint")
        if self.first is None:
            return key
        if self.first:
            return own_id(key, *content)
        return F.coalesce(key.bitwiseOR(F.lit(-(1 << 63))), F.xxhash64(*content).bitwiseAND(F.lit((1 << 63) - 1)))

    def given(self, own: Column) -> Column:
        """The id as it was given, NULL for a made one."""
        if self.first is None:
            return own
        return F.when(own < self.first, own if self.first else own.bitwiseAND(F.lit((1 << 63) - 1)))


def ids_of(rows: DataFrame, key: str) -> Ids:
    """How the rows of a table get ids, by the least and the greatest of those that are given."""
    column = F.col(key).cast("bigint")
    low, high, lacking = rows.agg(F.min(column), F.max(column), F.count_if(column.isNull())).first()
    if not lacking:
        return Ids(None)
    if high is None or high < NO_ID:
        return Ids(NO_ID)
    if low < 0:
        raise ValueError(f"rows without {key} need room above or below the given ones, which go from {low} to {high}")
    return Ids(0)


def words_of(text: Column) -> Column:
    """The words of a text: runs without ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def open_fs(path: str):
    """(filesystem, path in it) for a folder that all executors can reach."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + parts.path.lstrip("/")
    return fs.FileSystem.from_uri(path)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    from spanloom.session import ship

    ship(spark)
    prepare(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")
