"""Masking of secret values by field name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from feedlake.functions.lexicons import SECRET_TERMS

MASK = "********"


def _is_secret(name: str) -> bool:
    return any(term in name.lower() for term in SECRET_TERMS)


def _masked_text(value: Column, mask_empty: bool) -> Column:
    hide = value.isNotNull() if mask_empty else F.coalesce(value != "", F.lit(False))
    return F.when(hide, F.lit(MASK)).otherwise(value)


def mask_value(value: Column, kind: T.DataType, mask_empty: bool = True) -> Column:
    """``value`` with the strings under secret names masked, at any depth.

    Under a secret name only strings change; other values there are left whole.
    """
    if isinstance(kind, T.StructType):
        fields = [_mask_field(f.name, value.getField(f.name), f.dataType, mask_empty).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: mask_value(x, kind.elementType, mask_empty))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.transform_values(value, lambda k, v: _mask_entry(k, v, kind.valueType, mask_empty))
    return value


def _mask_field(name: str, value: Column, kind: T.DataType, mask_empty: bool) -> Column:
    if not _is_secret(name):
        return mask_value(value, kind, mask_empty)
    return _masked_text(value, mask_empty) if isinstance(kind, T.StringType) else value


def _mask_entry(name: Column, value: Column, kind: T.DataType, mask_empty: bool) -> Column:
    secret = reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(t)) for t in SECRET_TERMS])
    hidden = _masked_text(value, mask_empty) if isinstance(kind, T.StringType) else value
    return F.when(secret, hidden).otherwise(mask_value(value, kind, mask_empty))


def mask_sensitive(df: DataFrame, mask_empty: bool = True) -> DataFrame:
    return df.select(
        *[_mask_field(f.name, F.col(f"`{f.name}`"), f.dataType, mask_empty).alias(f.name) for f in df.schema.fields]
    )
