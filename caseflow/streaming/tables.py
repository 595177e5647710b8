"""File streams in, versioned result tables out.

A sink keeps one folder per micro-batch and overwrites it when the batch is retried, so a job can
lose its driver or any executor and continue from its checkpoint without doubled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch_id"
BUCKET = "bucket"


def stream_files(
    spark: SparkSession, path: str, glob: str = "*.parquet", max_files: int | None = None
) -> DataFrame:
    """A folder of parquet files as a stream; the schema is read once, from the files there.

    With ``max_files`` the order in which files are taken up matters. It is that of their times of change; files of one
    clock tick go by name where the path is a pattern, and in no order where it is a folder.
    """
    there = spark.read.option("pathGlobFilter", glob).parquet(path)
    reader = spark.readStream.schema(there.schema).option("pathGlobFilter", glob)
    if not max_files:
        return reader.parquet(path)
    reader = reader.option("maxFilesPerTrigger", max_files)
    folder = path.rstrip("/")
    flat = all(f.rsplit("/", 2)[-2] == folder.rsplit("/", 1)[-1] for f in there.inputFiles())
    return reader.parquet(f"{folder}/{glob}" if flat else path)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream, be it one parquet file or a folder of them.

    A stream reads folders only, so a single file is picked out of the folder it lies in.
    """
    file = f"{name}.parquet"
    path = f"{sf_dir.rstrip('/')}/{file}"
    files = spark.read.parquet(path).inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{file}") and not files[0].endswith(f"/{file}/{file}"):
        return stream_files(spark, sf_dir, file)
    return stream_files(spark, path, "*")


def write_version(
    batch: DataFrame, batch_id: int, path: str, partitions: Sequence[str] = ()
) -> None:
    """Write one micro-batch to its own folder, replacing what a failed attempt left there."""
    batch.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/{BATCH}={batch_id}")


def run_available(
    df: DataFrame,
    path: str,
    mode: str,
    write: Callable[[DataFrame, int], None] | None = None,
    partitions: Sequence[str] = (),
) -> None:
    """Process everything that has arrived and stop; a later call goes on from the checkpoint."""
    writer = write or (lambda batch, batch_id: write_version(batch, batch_id, f"{path}/rows", partitions))
    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(writer)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def read_versions(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """All versions written so far, with the micro-batch each row came from."""
    if isinstance(schema, T.StructType):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    versioned = f"{schema}, {BATCH} BIGINT"
    try:
        return spark.read.schema(versioned).parquet(f"{path}/rows")
    except AnalysisException as error:  # nothing has been written yet
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], versioned)


def read_version(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """One version, without listing the others."""
    return spark.read.parquet(f"{path}/rows/{BATCH}={batch_id}")


def latest(versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version of every key of an update-mode result.

    The values ride along in the aggregate, so each key is read and shuffled once.
    """
    values = [c for c in versions.columns if c not in (*keys, BATCH)]
    return (
        versions.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), BATCH).alias("v"))
        .select(*keys, "v.*")
    )


# --- snapshots that are replaced bucket by bucket ---------------------------------------------------


def with_bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """The rows with the bucket of their key, the same on every run."""
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def write_buckets(df: DataFrame, batch_id: int, path: str) -> None:
    """Write one version of the buckets that occur; a large bucket is cut into several files."""
    write_version(df.hint("rebalance", BUCKET), batch_id, f"{path}/rows", [BUCKET])


def name_buckets(spark: SparkSession, buckets: Sequence[int], batch_id: int, path: str) -> None:
    """The pointer: from now on the version ``batch_id`` of these buckets is the one to read."""
    rows = spark.createDataFrame([(b,) for b in buckets], f"{BUCKET} INT").coalesce(1)
    write_version(rows, batch_id, f"{path}/pointer/rows")


def named_buckets(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """The version to read of every bucket: at most one number for each bucket.

    A version that was written but not named is not among them. ``below`` leaves out this batch and later
    ones, for a batch that is tried again after it was named.
    """
    named = read_versions(spark, f"{path}/pointer", f"{BUCKET} INT")
    if below is not None:
        named = named.where(F.col(BATCH) < below)
    return {r[0]: r[1] for r in named.groupBy(BUCKET).agg(F.max(BATCH)).collect()}


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, versions: dict[int, int]) -> DataFrame:
    """The rows of the given versions of buckets; no other folder is listed or read."""
    folders = [f"{path}/rows/{BATCH}={v}/{BUCKET}={b}" for b, v in sorted(versions.items())]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/rows").parquet(*folders).select(*schema.fieldNames())
