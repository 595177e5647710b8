"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's documents are dealt into shards of bounded size; in a shard they form one stream of words
in a seeded order, cut into blocks of equal length. All blocks of the mix are apportioned to the
shards at once by the highest quotients target / (2k - 1), which gives every shard a whole number of
blocks. A shard takes its stream as often as that number allows in full, and the rest as blocks
picked at even steps from a seeded start. The ranges of words are an output of their own, and the mixed
documents hold the words that are taken, as often as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.shared import ranked, small_side, stored

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
SHARD_DOCS = 1 << 16


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _targets(spark: SparkSession, sizes: DataFrame, share: float, most: float) -> DataFrame:
    """(source, rank, source_size, n, target): shares by weight, none above ``most`` times its source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = ranked(spark, sources, [F.col("source").isNull(), F.col("source")], "mix-sources")
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    sources = stored(
        spark,
        sources.withColumn("weight", F.get(weights, (F.col("rank") % len(WEIGHTS)).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most))),
        "mix-weights",
    )
    whole = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    rate, capped = 0.0, -1
    while True:  # one round for each time that a source reaches its cap; four numbers reach the driver
        above = F.col("cap") <= F.col("weight") * F.lit(rate)
        taken, weight, now = sources.agg(
            F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)
        ).first()
        if now == capped or not weight:
            break
        capped, rate = now, (whole - (taken or 0.0)) / weight
    return sources.withColumn("target", F.least("cap", F.col("weight") * F.lit(rate)))


def apportion(spark: SparkSession, cells: DataFrame, seats: int, name: str) -> DataFrame:
    """Add ``quota``: the seats of each cell by the highest quotients target / (2k - 1).

    ``cells`` has source, rank, shard, target. Seats far below a cell's share are its own in any case
    and those far above never are; only quotients near the share are compared, about five for each
    cell whatever the number of seats. Ties go to the lower source, then the lower shard.
    """
    n, total = cells.agg(F.count("*"), F.sum("target")).first()
    if not total or not seats:
        return cells.withColumn("quota", F.lit(0).cast("bigint"))
    share = F.col("target") * F.lit(seats / total)
    near = F.ceil(F.col("target") / F.lit(total) * F.lit(n / 2)) + 2
    cells = cells.withColumn("low", F.greatest(F.lit(0), F.floor(share) - near)).withColumn("high", F.floor(share) + near)
    sure = cells.agg(F.sum("low")).first()[0]
    open_seats = cells.where("target > 0").select(
        "rank", "shard", "target", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("k")
    ).withColumnRenamed("rank", "source_rank")
    order = [(F.col("target") / (2 * F.col("k") - 1)).desc(), F.col("source_rank"), F.col("shard"), F.col("k")]
    won = ranked(spark, open_seats, order, name).where(F.col("rank") < seats - sure)
    won = won.groupBy(F.col("source_rank").alias("rank"), "shard").agg(F.count("*").alias("won"))
    return cells.join(won, ["rank", "shard"], "left").withColumn("quota", F.col("low") + F.coalesce("won", F.lit(0))).drop("low", "high", "won")


def _placed(spark: SparkSession, docs: DataFrame, share: float, most: float, block: int, seed: int) -> DataFrame:
    """One row per document: its place in its shard's stream (first, stop), and what the shard takes (rounds, extra, blocks, start)."""
    sizes = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
    )
    sizes = stored(spark, sizes, "mix-sizes")
    targets = stored(spark, _targets(spark, sizes, share, most), "mix-targets")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("n") / SHARD_DOCS))
    named = targets.select(
        F.col("source").alias("_source"), "rank", "source_size", F.col("target").alias("source_target"), shards.alias("shards")
    )
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    placed = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id",
        "size",
        "rank",
        "source_size",
        "source_target",
        order.alias("place"),
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("size")), F.col("shards")).alias("shard"),
    )
    cells = placed.groupBy("rank", "shard").agg(
        F.sum("size").alias("cell_size"),
        (F.max("source_target") * F.sum("size") / F.greatest(F.max("source_size"), F.lit(1))).alias("target"),
    )
    cells = stored(spark, cells, "mix-cells")
    seats = round((cells.agg(F.sum("target")).first()[0] or 0) / block)
    blocks = F.ceil(F.col("cell_size") / block).cast("bigint")
    quotas = apportion(spark, cells, seats, "mix-quotients").withColumn("blocks", blocks)
    quotas = quotas.withColumn("quota", F.least("quota", F.floor(F.col("blocks") * most).cast("bigint")))
    quotas = quotas.select(
        "rank",
        "shard",
        "blocks",
        F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0).alias("rounds"),
        F.when(F.col("blocks") > 0, F.col("quota") % F.col("blocks")).otherwise(0).alias("extra"),
        F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "rank", "shard"), "blocks")).otherwise(0).alias("start"),
    )
    stream = Window.partitionBy("rank", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.withColumn("stop", F.sum("size").over(stream)).join(quotas, ["rank", "shard"])
    return rows.withColumn("first", F.col("stop") - F.col("size"))


def _before(b: Column) -> Column:
    """Picked blocks before a block of the stream."""
    return F.floor((b * F.col("extra") + F.col("start")) / F.greatest("blocks", F.lit(1)))


def _taken(block: int) -> Column:
    def picked(word: Column) -> Column:
        """Words in picked blocks before a word of the stream."""
        b = F.floor(word / block)
        return (_before(b) - _before(F.lit(0))) * block + (_before(b + 1) - _before(b)) * (word - b * block)

    return (F.col("rounds") * F.col("size") + picked(F.col("stop")) - picked(F.col("first"))).cast("bigint")


def mix(
    spark: SparkSession, docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, seed: int = 17
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Null texts have size 0 and are never taken; a null source is a source of its own, last in order.
    Rows that repeat a doc_id are documents of their own. Equal sizes and ids give equal answers on
    every run. Without any words all targets are 0. An empty table gives no rows. Columns besides
    doc_id, source and text are ignored.
    """
    rows = _placed(spark, docs, share, most, block, seed)
    return rows.select("doc_id", "size", "source_size", F.col("source_target").alias("target"), _taken(block).alias("taken"))


def mix_blocks(
    spark: SparkSession, docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, seed: int = 17
) -> DataFrame:
    """What ``mix`` takes, one row per range of words: doc_id, first_word, end_word, repeats.

    A document that is taken in full has a row for all its words with the number of rounds, and every block
    picked on top has one for its words that lie in the document. The words of a document's rows, times
    their repeats, add up to ``taken``.
    """
    rows = _placed(spark, docs, share, most, block, seed).where("size > 0")
    begin, end = F.col("b") * block, (F.col("b") + 1) * block
    whole = rows.where("rounds > 0").select(
        "doc_id", F.lit(0).cast("bigint").alias("first_word"), F.col("size").alias("end_word"), F.col("rounds").cast("bigint").alias("repeats")
    )
    held = F.sequence(F.floor(F.col("first") / block), F.floor((F.col("stop") - 1) / block))
    picked = rows.where("extra > 0").withColumn("b", F.explode(held)).where(_before(F.col("b") + 1) > _before(F.col("b")))
    picked = picked.select(
        "doc_id",
        (F.greatest(begin, "first") - F.col("first")).cast("bigint").alias("first_word"),
        (F.least(end, "stop") - F.col("first")).cast("bigint").alias("end_word"),
        F.lit(1).cast("bigint").alias("repeats"),
    )
    return whole.unionByName(picked)


def mixed_documents(spark: SparkSession, docs: DataFrame, column: str = "words_taken") -> DataFrame:
    """The documents of which the mix takes words; ``text`` is what it takes, ``column`` counts its words.

    The text is the whole text as often as the mix takes it, each on a line of its own, then the words of the
    blocks picked on top, with the white space after them. All other columns are those of the whole document.
    Rows of one doc_id share the takes of the one that gives most.
    """
    block = BLOCK_WORDS
    rows = _placed(spark, docs, 1.5, 2.0, block, 17).withColumn("taken", _taken(block)).where("taken > 0")
    place = F.struct("taken", "size", "first", "rounds", "extra", "blocks", "start")
    takes = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.max(place).alias("_take"))
    takes = small_side(stored(spark, takes, "mix-takes"))
    # As one struct, so that no name of the table meets one of these.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = whole.join(takes, F.col("_row.doc_id").cast("bigint").eqNullSafe(F.col("_id")))
    rows = rows.withColumn("_text", F.col("_row.text").cast("string"))
    words = F.regexp_extract_all(F.col("_text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    take = F.col("_take")

    def before(b: Column) -> Column:
        return F.floor((b * take["extra"] + take["start"]) / F.greatest(take["blocks"], F.lit(1)))

    def chosen(_: Column, i: Column) -> Column:
        b = F.floor((take["first"] + i) / block)
        return before(b + 1) > before(b)

    rows = rows.withColumn("_words", F.when(take["extra"] > 0, words).otherwise(F.array().cast("array<string>")))
    part = F.array_join(F.filter("_words", chosen), "")
    text = F.concat_ws("\n", F.array_repeat(F.col("_text"), take["rounds"].cast("int")), F.when(part != "", part))
    rows = rows.withColumn("_mixed", text)
    out = [F.col("_mixed").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c != column]
    return rows.select(*out, word_count(F.col("_mixed")).alias(column)).where(F.col(f"`{column}`") > 0)
