"""Text columns: redaction, masking, token estimates, tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import fixed_values as fixed

# (?U) gives \d and \b their Unicode meaning, whatever the Java version.
CARD_NUMBER = "(?U)" + fixed.CARD_NUMBER_PATTERN
IDENTITY_NUMBER = "(?U)" + fixed.IDENTITY_NUMBER_PATTERN

# Every Unicode space plus the four separators that count as one elsewhere. As one short class it
# is several times faster than the listed code points.
SPACE = r"\s\x1c-\x1f"
WORD = f"(?U)[^{SPACE}]+"
SPACES = f"(?U)[{SPACE}]+"
_ENDS = f"(?U)^[{SPACE}]+|[{SPACE}]+$"


def redact_text(text: Column) -> Column:
    """Hide card numbers, then identity numbers; the order matters where they touch."""
    cards_hidden = F.regexp_replace(text, CARD_NUMBER, fixed.CARD_NUMBER_REPLACEMENT)
    return F.regexp_replace(cards_hidden, IDENTITY_NUMBER, fixed.IDENTITY_NUMBER_REPLACEMENT)


def strip(text: Column) -> Column:
    """Remove every kind of whitespace at both ends; ``trim`` only knows the space."""
    return F.regexp_replace(text, _ENDS, "")


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def clean_last4(text: Column) -> Column:
    """The four digits of a card ending, null when there are not exactly four."""
    bare = F.regexp_replace(strip(text), r"^\*+", "")
    return F.when(bare.rlike("^[0-9]{4}$"), bare)


def mask_pan(last4: Column) -> Column:
    return F.concat(F.lit(fixed.MASK_PREFIX), last4)


def token_estimate(chars: Column, floor: int | None = 1) -> Column:
    """Tokens for a number of characters; ``floor=None`` leaves small counts alone."""
    tokens = F.floor(chars / fixed.CHARS_PER_TOKEN)
    return tokens if floor is None else F.greatest(F.lit(floor).cast("long"), tokens)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def contains_any(lowered: Column, words: Sequence[str]) -> Column:
    """Whether already lower-cased text has one of the words as a substring."""
    if not words or any(w == "" for w in words):
        raise ValueError("rules need at least one word, and an empty word would match everything")
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word.lower())
    return found


def tag_documents(
    df: DataFrame,
    text: str = "text",
    rules: Mapping[str, Sequence[str]] = fixed.DOCUMENT_TAGS,
    default: str = fixed.DEFAULT_TAG,
) -> DataFrame:
    """Add ``tags`` (sorted, comma separated) and ``word_count``; one pass for all tags."""
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_compact(
        F.array(*[F.when(contains_any(F.col("_lowered"), rules[t]), F.lit(t)) for t in sorted(rules)])
    )
    return (
        df.withColumn("_lowered", lowered)
        .withColumn("_tags", found)
        .withColumn("tags", F.when(F.size("_tags") == 0, default).otherwise(F.array_join("_tags", ", ")))
        .withColumn("word_count", word_count(F.coalesce(F.col(text), F.lit(""))))
        .drop("_lowered", "_tags")
    )
