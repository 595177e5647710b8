"""Helpers that several corpus operators use: stored tables, global ranks, connected components."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.session import work_dir

BROADCAST_IDS = 250_000
ARROW_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make a session ready: send this package to its executors, once, and bound the bytes of Arrow batches.

    The usual bound of 64 MB for each batch, held several times over by every task, is too much next to
    a small heap.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run in here gives its shuffle files back when it ends; the session's own choice is put back."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared work folder and read it back.

    This cuts lineage: a lost executor costs only the tasks that it was running. A stored table is
    also computed once however often it is read. Nothing reads the shuffles of the write again, so they go
    with its end and not when the driver happens to collect its garbage.
    """
    path = work_dir(spark, name)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete stored tables that nothing reads again, so that a long chain of steps does not keep all of them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as a long and the text, null as empty; whatever else the table holds stays behind."""
    return df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def narrowed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among distinct ``ids``, or all rows where that list is too long to send round.

    For use before a join on the key: few ids spare the join the shuffle of most texts.
    """
    if ids.count() <= BROADCAST_IDS:
        return df.join(F.broadcast(ids), key, "left_semi")
    return df


def small_side(df: DataFrame) -> DataFrame:
    """A join's side, sent to every task where it is counted to be short; else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def ranked(spark: SparkSession, df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``rank``, 0-based over all rows in the given total order, without one task seeing them all.

    Rows are dealt out by range and stored; the only thing added up over partitions is one count
    for each partition.
    """
    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = stored(spark, parts, name)
    own = Window.partitionBy("_part").orderBy(*order)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        parts.withColumn("_own", F.row_number().over(own))
        .join(F.broadcast(offsets), "_part")  # a row for each partition at most
        .withColumn("rank", F.col("_before") + F.col("_own") - 1)
        .drop("_part", "_own", "_before")
    )


def components(spark: SparkSession, edges: DataFrame, name: str) -> DataFrame:
    """(id, root): for every id in the edges (a, b) the smallest id it is connected with.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each step takes a minimum
    per node, combined before the shuffle, and a join that adaptive execution can split, so a node
    with very many neighbours is no single task. The edges are stored after every round; only a
    count and a checksum reach the driver.
    """
    edges = stored(
        spark,
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-edges",
    )
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        edges = stored(spark, small, f"{name}-round")
    root = edges.groupBy("a").agg(F.min("b").alias("root"))
    roots = root.select(F.col("root").alias("a")).distinct().select("a", F.col("a").alias("root"))
    return root.union(roots).select(F.col("a").alias("id"), "root")
