"""Text of result cells and of whole result lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary as V


def cell(value: Column, dtype: T.DataType | None = None, max_chars: int | None = None) -> Column:
    """A value as text: ``NULL`` for a missing one, cut if longer than ``max_chars``."""
    text = F.base64(value) if isinstance(dtype, T.BinaryType) else value.cast("string")
    if max_chars is not None:
        cut = F.concat(F.substring(text, 1, max_chars), F.lit(V.CUT_MARK))
        text = F.when(F.length(text) > max_chars, cut).otherwise(text)
    return F.coalesce(text, F.lit("NULL"))


def markdown_line(cells: Sequence[Column]) -> Column:
    """``| a | b |``."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def tsv_line(cells: Sequence[Column]) -> Column:
    """Tab-joined cells."""
    return F.concat_ws("\t", *cells)
