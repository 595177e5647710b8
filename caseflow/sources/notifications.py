"""Storage notifications: decoding, content, and the metadata table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import fixed_values as fixed
from caseflow.functions.text import tag_documents

ENVELOPE = "message STRING, subscription STRING, _corrupt STRING"
MESSAGE = "data STRING, messageId STRING, publishTime STRING, _corrupt STRING"
OBJECT = "bucket STRING, name STRING, timeCreated STRING, generation STRING, _corrupt STRING"
_JSON = {"columnNameOfCorruptRecord": "_corrupt"}
# Payloads that count as none at all.
_NOTHING = ["", "{}", "[]", "null", "false", "0", '""']

KEY = ["bucket", "name", "generation"]
METADATA_SCHEMA = "filename STRING, date STRING, tags STRING, word_count BIGINT"


def _absent(text: Column) -> Column:
    return text.isNull() | (text == "")


def decoded(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the object's fields and ``reject_reason``, null on the rows that decode.

    The reasons are tried in a fixed order. Nothing here can raise: base64, UTF-8 and JSON are
    read with functions that give null, and the corrupt-record field tells bad JSON from JSON
    without the field.
    """
    text = F.regexp_replace(F.col(raw), r"^\s+|\s+$", "")
    # A message that is a JSON object comes back as its own JSON text.
    staged = (
        df.withColumn("_envelope", F.from_json(text, ENVELOPE, _JSON))
        .withColumn("_message", F.from_json(F.col("_envelope.message"), MESSAGE, _JSON))
        .withColumn("_has_data", F.array_contains(F.json_object_keys("_envelope.message"), "data"))
        .withColumn(
            "_json",
            F.try_validate_utf8(F.try_to_binary(F.col("_message.data"), F.lit("base64")).cast("string")),
        )
        .withColumn("_object", F.from_json("_json", OBJECT, _JSON))
    )
    no_payload = text.isNull() | text.isin(_NOTHING)
    bad_json = F.try_parse_json(text).isNull()
    no_object = F.col("_envelope._corrupt").isNotNull() | F.col("_envelope.message").isNull()
    reason = (
        F.when(no_payload | bad_json, "NO_PAYLOAD")
        .when(no_object, "INVALID_FORMAT")
        .when(~F.coalesce("_has_data", F.lit(False)), "NO_DATA")
        .when(_absent(F.col("_json")) | F.col("_object._corrupt").isNotNull(), "DECODE_FAILED")
        .when(_absent(F.col("_object.bucket")) | _absent(F.col("_object.name")), "MISSING_OBJECT")
    )
    fields = F.struct(
        F.col("_message.messageId").alias("message_id"),
        F.col("_message.publishTime").alias("publish_time"),
        F.col("_object.bucket").alias("bucket"),
        F.col("_object.name").alias("name"),
        F.col("_object.timeCreated").alias("time_created"),
        F.col("_object.generation").alias("generation"),
        reason.alias("reject_reason"),
    )
    # As a generated row: a filter on a field would otherwise repeat the whole chain that makes it.
    return staged.select(*df.columns, F.inline(F.array(fields)))


def decode_notifications(df: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Usable notifications, and rejected ones with the reason."""
    rows = decoded(df, raw)
    return (
        rows.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        rows.filter(F.col("reject_reason").isNotNull()),
    )


def object_key() -> Column:
    """One text for an object version; an absent field differs from an empty one and equals itself."""
    return F.sha2(F.to_json(F.struct(*KEY)), 256)


def attach_content(notifications: DataFrame, objects: DataFrame) -> DataFrame:
    """Join the stored text; ``status`` says where there is none, and no text is made up."""
    stored = objects.select("bucket", "name", "content", F.lit(True).alias("_stored"))
    return (
        notifications.join(stored, ["bucket", "name"], "left")
        .withColumn("status", F.when(F.col("_stored"), "OK").otherwise("CONTENT_NOT_FOUND"))
        .drop("_stored")
    )


def one_per_object(notifications: DataFrame) -> DataFrame:
    """Drop redelivered notifications of the same object version; of several, the earliest stays.

    Earliest by publishing time, then by message and creation time, absent ones first, so a rerun keeps the same.
    """
    rest = [c for c in notifications.columns if c not in KEY]
    first = notifications.groupBy(*KEY).agg(
        F.min_by(F.struct(*rest), F.struct("publish_time", "message_id", "time_created")).alias("_first")
    )
    return first.select(*[F.col(c) if c in KEY else F.col(f"_first.{c}").alias(c) for c in notifications.columns])


def metadata_rows(
    contents: DataFrame,
    rules: Mapping[str, Sequence[str]] = fixed.DOCUMENT_TAGS,
    now: Column | None = None,
) -> DataFrame:
    """One metadata row per object with content; the date falls back to now."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'") if now is None else now
    tagged = tag_documents(contents.filter(F.col("status") == "OK"), "content", rules)
    created = F.when(_absent(F.col("time_created")), now).otherwise(F.col("time_created"))
    return tagged.select(F.col("name").alias("filename"), created.alias("date"), "tags", "word_count")


def append_metadata(rows: DataFrame, path: str, batch: str, fmt: str = "json") -> None:
    """Append one batch of metadata rows to a table of files: ``json`` for lines, ``parquet`` for a warehouse.

    The batch's name is a partition of the table, and only that partition is written: a batch that is
    tried again replaces what the failed attempt left and doubles nothing.
    """
    named = rows.withColumn("batch", F.lit(batch))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").format(fmt).save(path)


def read_metadata(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The appended rows, each with its ``batch``."""
    return spark.read.schema(f"{METADATA_SCHEMA}, batch STRING").format(fmt).load(path)
