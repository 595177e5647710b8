"""Redaction of whole rows, driven by the schema."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions import fixed_values as fixed
from caseflow.functions.text import redact_text


def redact_columns(df: DataFrame, secret: Collection[str] = fixed.SECRET_FIELD_NAMES) -> DataFrame:
    """Redact text at any depth and replace every value kept under a secret name.

    The schema is walked once while the plan is built; the result is one projection. A secret
    field becomes a string even when it is null or not text. Plain map values become strings, because
    a replaced value has to share their type; a nested map value cannot, so under a secret key it
    becomes null.
    """
    names = {n.lower() for n in secret}
    return df.select(
        *[_redact(F.col(f"`{f.name}`"), f.dataType, f.name, names).alias(f.name) for f in df.schema.fields]
    )


def _redact(value: Column, kind: T.DataType, name: str, secret: set[str]) -> Column:
    if name.lower() in secret:
        return F.lit(fixed.SECRET_FIELD_REPLACEMENT)
    if isinstance(kind, T.StringType):
        return redact_text(value)
    if isinstance(kind, T.StructType):
        fields = [_redact(value[f.name], f.dataType, f.name, secret).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _redact(item, kind.elementType, "", secret))
    if isinstance(kind, T.MapType):
        is_secret = lambda key: F.lower(key).isin(sorted(secret))
        if not isinstance(kind.keyType, T.StringType):
            return F.transform_values(value, lambda _, v: _redact(v, kind.valueType, "", secret))
        if isinstance(kind.valueType, (T.StructType, T.ArrayType, T.MapType)):
            return F.transform_values(
                value, lambda k, v: F.when(~is_secret(k), _redact(v, kind.valueType, "", secret))
            )
        return F.transform_values(
            value,
            lambda k, v: F.when(is_secret(k), fixed.SECRET_FIELD_REPLACEMENT).otherwise(redact_text(v.cast("string"))),
        )
    return value
