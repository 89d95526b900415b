"""Finding personal data in the text columns of a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prose import (
    DEFAULT_RECOGNIZERS,
    Recognizer,
    all_findings,
    contains_pii,
    has_findings,
    may_have_findings,
    positioned_findings,
)


def find_pii(
    df: DataFrame,
    column: str,
    keep: Sequence[str] = (),
    recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS,
    positions: bool = False,
) -> DataFrame:
    """One row per finding, with the ``keep`` columns of the row it was found in.

    Rows that fail the cheap tests are filtered at the scan, and each other text is read once;
    nothing is shuffled. ``positions`` adds the zero-based start and end, in characters.
    """
    text = F.col(column)
    if positions:
        hit = df.where(has_findings(text, recognizers)).select(*keep, F.explode(positioned_findings(text, recognizers)).alias("f"))
    else:
        hit = df.where(may_have_findings(text, recognizers)).select(*keep, F.explode(all_findings(text, recognizers)).alias("f"))
    return hit.select(*keep, "f.*")


def rows_with_pii(df: DataFrame, column: str) -> DataFrame:
    """The rows whose text has the shape of personal data."""
    return df.where(contains_pii(F.col(column)))
