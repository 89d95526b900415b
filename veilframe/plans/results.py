"""A result as bounded text: header, column line, at most ``max_rows`` rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.cells import cell, markdown_line, tsv_line
from ..operators.redact import annotations


def _form(df: DataFrame, form: str | None) -> str:
    return form or ("tsv" if len(df.columns) > V.MARKDOWN_MAX_COLUMNS else "markdown")


def result_lines(
    df: DataFrame, form: str | None = None, max_cell_chars: int | None = None
) -> DataFrame:
    """One ``line`` per row, built on the executors.

    ``form`` is ``markdown`` or ``tsv``; by default wide results become TSV. Cells are whole
    unless ``max_cell_chars`` cuts them.
    """
    by_position = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cells = [
        cell(F.col(f"c{i}"), f.dataType, max_cell_chars) for i, f in enumerate(df.schema.fields)
    ]
    line = tsv_line(cells) if _form(df, form) == "tsv" else markdown_line(cells)
    return by_position.select(line.alias("line"))


def _column_lines(names: list[str], form: str) -> list[str]:
    if form == "tsv":
        return ["\t".join(names)]
    return ["| " + " | ".join(names) + " |", "| " + " | ".join(["---"] * len(names)) + " |"]


def _header(statuses: list[tuple[str, str]], shown: int, truncated: bool) -> list[str]:
    masked = [f"{name} ({status})" for name, status in statuses if status != "UNMASKED"]
    revealed = [name for name, status in statuses if status == "UNMASKED"]
    out = []
    if masked:
        out.append(V.MASKED_HEADING + ", ".join(masked))
    if revealed:
        out.append(V.REVEALED_HEADING + ", ".join(revealed))
    out.append(f"{shown} rows" + (V.TRUNCATED if truncated else ""))
    return out + [""]


def render(
    df: DataFrame,
    max_rows: int = 1000,
    max_cell_chars: int | None = V.MAX_CELL_CHARS,
    form: str | None = None,
) -> str:
    """The first rows of a redacted DataFrame as text for a reader.

    One row more than allowed is fetched, so "truncated" is said only when it is true. Cells are
    cut at ``max_cell_chars``, or not at all if that is None.
    """
    lines = result_lines(df, form, max_cell_chars)
    rows = [r["line"] for r in lines.limit(max_rows + 1).collect()]
    if not rows:
        return V.NO_ROWS
    shown = rows[:max_rows]
    header = _header(annotations(df), len(shown), len(rows) > max_rows)
    return "\n".join(header + _column_lines(df.columns, _form(df, form)) + shown)
