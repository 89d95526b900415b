"""Masking of structs, arrays, maps and variants, whose shape the schema gives."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary as V
from .jsontext import mask_json_text
from .masks import mask, mask_by_entity
from .names import entity_of_key, key_entity
from .prose import DEFAULT_RECOGNIZERS, Recognizer, is_telling, redact_text


def entity_by_name(field: T.StructField) -> str | None:
    """A struct field is classified like a JSON key."""
    return key_entity(field.name)


@dataclass(frozen=True)
class NestedStyle:
    """How the leaves of a nested value are masked."""

    style: str = "partial"
    seed: str | None = None
    reveal_types: frozenset[str] = frozenset()
    recognizers: tuple[Recognizer, ...] = DEFAULT_RECOGNIZERS
    mask_scalars: bool = False
    secrets_only: bool = False
    default: str | None = None  # what a leaf holds whose name says nothing
    entity_of: Callable[[T.StructField], str | None] = entity_by_name


_SCALARS = (T.NumericType, T.BooleanType)


def is_json_like(dtype: T.DataType) -> bool:
    """Types that are walked rather than masked as one value."""
    if isinstance(dtype, T.ArrayType):
        return is_json_like(dtype.elementType)
    return isinstance(dtype, (T.StructType, T.MapType, T.VariantType))


def _is_concerned(dtype: T.DataType, how: NestedStyle) -> bool:
    """Whether anything inside may change: text, or what a secret name stands before."""
    if isinstance(dtype, T.ArrayType):
        return _is_concerned(dtype.elementType, how)
    if isinstance(dtype, T.MapType):
        return isinstance(dtype.keyType, T.StringType) or _is_concerned(dtype.valueType, how)
    if isinstance(dtype, T.StructType):
        return any(how.entity_of(f) == V.SECRET or _is_concerned(f.dataType, how) for f in dtype.fields)
    if how.mask_scalars and isinstance(dtype, _SCALARS):
        return True
    return isinstance(dtype, (T.StringType, T.VariantType))


def _neutral_text(value: Column, how: NestedStyle) -> Column:
    if how.secrets_only:
        return value
    scanned = redact_text(value, how.style, how.seed, how.reveal_types, how.recognizers)
    return F.when(is_telling(value, how.recognizers), scanned).otherwise(value)


def _leaf(value: Column, dtype: T.DataType, entity: str | None, how: NestedStyle) -> Column:
    """A scalar whose field, known from the schema, names ``entity`` or nothing."""
    is_text = isinstance(dtype, T.StringType)
    if not is_text and not (how.mask_scalars and isinstance(dtype, _SCALARS)):
        return F.lit(None).cast(dtype) if entity == V.SECRET else value
    entity = entity or how.default
    if entity is None:
        return _neutral_text(value, how) if is_text else value
    if entity != V.SECRET and (how.secrets_only or entity in how.reveal_types):
        return value
    return mask(value, entity, how.style, how.seed)


def _map_value(key: Column, value: Column, dtype: T.DataType, how: NestedStyle) -> Column:
    """A map value whose key is data: a column decides how it is masked."""
    if isinstance(dtype, T.StringType) or (how.mask_scalars and isinstance(dtype, _SCALARS)):
        text = value.cast("string")
        entity = F.coalesce(entity_of_key(key), F.lit(how.default).cast("string"))
        masked = mask_by_entity(text, entity, how.style, how.seed)
        if how.secrets_only:
            return F.when(entity == V.SECRET, masked).otherwise(text)
        return (
            F.when(entity.isNull(), _neutral_text(text, how))
            .when(entity.isin(sorted(set(how.reveal_types) - {V.SECRET})), text)
            .otherwise(masked)
        )
    return F.when(~F.coalesce(entity_of_key(key) == V.SECRET, F.lit(False)), mask_nested(value, dtype, how))


def mask_nested(
    value: Column, dtype: T.DataType, how: NestedStyle, entity: str | None = None
) -> Column:
    """Mask every string leaf of ``value``; NULL containers stay NULL.

    A secret name covers all that is below it: text becomes ``[REDACTED]``, any other value,
    and what a secret key of a map stands before, NULL.
    """
    secret = entity == V.SECRET
    if not secret and not _is_concerned(dtype, how):
        return value
    inherited = V.SECRET if secret else None
    if isinstance(dtype, T.StructType):
        fields = [
            mask_nested(value[f.name], f.dataType, how, inherited or how.entity_of(f)).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: mask_nested(item, dtype.elementType, how, inherited))
    if isinstance(dtype, T.MapType):
        if isinstance(dtype.keyType, T.StringType) and not secret:
            return F.transform_values(value, lambda k, v: _map_value(k, v, dtype.valueType, how))
        return F.transform_values(value, lambda _, v: mask_nested(v, dtype.valueType, how, inherited))
    if isinstance(dtype, T.VariantType):
        text = F.lit(f'"{V.REDACTED}"') if secret else json_text(F.to_json(value), how)
        return F.when(value.isNotNull(), F.parse_json(text))
    return _leaf(value, dtype, entity, how)


def json_text(text: Column, how: NestedStyle) -> Column:
    """``mask_json_text`` with the settings of a ``NestedStyle``."""
    return mask_json_text(
        text,
        how.style,
        how.seed,
        how.reveal_types,
        how.recognizers,
        how.mask_scalars,
        how.secrets_only,
        how.default,
    )


def each_element(value: Column, dtype: T.DataType, one: Callable[[Column], Column]) -> Column:
    """Apply a scalar mask to a value, or to every element of an array of them."""
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: each_element(item, dtype.elementType, one))
    if isinstance(dtype, T.BinaryType):
        return one(F.base64(value))
    return one(value)


__all__: Sequence[str] = ("NestedStyle", "each_element", "is_json_like", "json_text", "mask_nested")
