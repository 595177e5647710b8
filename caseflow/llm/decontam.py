"""Benchmark decontamination by size-partitioned MinHash containment search, in native expressions.

Test items are partitioned by the power of two of their number of distinct word shingles. An item
of a partition is indexed under its m least shingle hashes (a bottom-m MinHash sketch), m being one
more than the number of shingles that the largest item of the partition may miss. A document that
holds the required share of an item therefore holds one of its sketch values, however long the
document is. Candidates are verified on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import documents, narrowed, stored

BROADCAST_ROWS = 500_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _with_shingles(df: DataFrame, width: int) -> DataFrame:
    """Add ``hashes`` of the shingles to a frame with ``w``: one for the whole sequence where it is shorter.

    Every array is a column before a lambda looks into it, else it would be computed for each element.
    """
    df = df.withColumn("n_words", F.size("w")).withColumn("word_hashes", F.transform("w", lambda w: F.xxhash64(w)))
    last = F.col("n_words") - width
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(F.col("word_hashes"), i + j) for j in range(width)]),
    )
    none = F.array().cast("array<bigint>")
    short = F.when(F.col("n_words") > 0, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(none)
    return df.withColumn("hashes", F.when(last >= 0, runs).otherwise(short)).drop("word_hashes")


def _with_texts(df: DataFrame, width: int) -> DataFrame:
    """Add ``shingles``, the distinct shingles as words with a space between."""
    last = F.col("n_words") - width
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(F.col("w"), i + 1, width), " ")
    )
    none = F.array().cast("array<string>")
    short = F.when(F.col("n_words") > 0, F.array(F.array_join("w", " "))).otherwise(none)
    return df.withColumn("shingles", F.array_distinct(F.when(last >= 0, runs).otherwise(short)))


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) wherever a document holds ``percent`` of an item's distinct shingles.

    Words are what lies between ASCII white space, lower-cased. An item or document of fewer than
    ``width`` words is one shingle, its whole sequence, so a short item only meets documents that
    consist of it. Empty and null texts hold nothing and are found nowhere; rows without an id are
    left out. Repeated rows give one pair. Empty tables give no rows. Columns besides doc_id, item_id
    and text are ignored.

    The sketches are sent to every task only when they are counted to be at most 500,000 rows;
    beyond that the probe is a shuffled join.
    """
    items = documents(benchmark, "item_id").where("doc_id IS NOT NULL").distinct()
    items = items.select(F.col("doc_id").alias("item_id"), _words(F.col("text")).alias("w"))
    items = _with_texts(_with_shingles(items, width), width).where("size(shingles) > 0")
    items = stored(
        spark, items.select("item_id", "shingles", F.sort_array(F.array_distinct("hashes")).alias("hashes")), "leak-items"
    )
    partition = F.floor(F.log2(F.size("hashes") + F.lit(0.5))).cast("int")
    largest = F.pow(F.lit(2), partition + 1).cast("int") - 1
    least = (largest * (100 - percent) / 100).cast("int") + 1
    sketches = items.select("item_id", F.explode(F.slice("hashes", 1, least)).alias("h"))
    sketches = stored(spark, sketches, "leak-sketches")
    probe = F.broadcast(sketches) if sketches.count() <= BROADCAST_ROWS else sketches

    texts = documents(docs).where("doc_id IS NOT NULL")
    met = (
        _with_shingles(texts.select("doc_id", _words(F.col("text")).alias("w")), width)
        .select("doc_id", F.explode_outer("hashes").alias("h"))  # explode would push a copy of the arrays into a filter
        .join(probe, "h")
        .select("doc_id", "item_id")
        .distinct()
    )
    met = stored(spark, met, "leak-candidates")
    whole = narrowed(texts, met.select("doc_id").distinct(), "doc_id")
    whole = whole.select("doc_id", F.concat(F.lit(" "), F.array_join(_words(F.col("text")), " "), F.lit(" ")).alias("padded"))
    whole = whole.join(met, "doc_id").join(items.select("item_id", "shingles"), "item_id")
    shared = F.size(F.filter("shingles", lambda s: F.contains(F.col("padded"), F.concat(F.lit(" "), s, F.lit(" ")))))
    short = F.size(F.split(F.element_at("shingles", 1), " ")) < width
    exact = F.when(short, (F.col("padded") == F.concat(F.lit(" "), F.element_at("shingles", 1), F.lit(" "))).cast("int"))
    return (
        whole.select(
            "doc_id",
            "item_id",
            F.coalesce(exact, shared).cast("bigint").alias("n_shared"),
            F.size("shingles").cast("bigint").alias("n_shingles"),
        )
        .where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
        .distinct()
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, all columns as they were."""
    found = contaminated(spark, docs, benchmark).select(F.col("doc_id").alias("_gone")).distinct()
    gone = stored(spark, found, "leak-gone")
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["_gone"], "left_anti")
