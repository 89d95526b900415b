"""Masked SQL: tables go in with a policy, queries come out redacted."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..functions import vocabulary as V
from ..functions.sqltext import tables_named
from ..operators.classify import classify_columns, decisions_from_policy, remember, scan_tables
from ..operators.redact import redact
from ..operators.reports import pii_report, rule_text, schema_text
from ..policy import Policy
from ..sources.catalog import columns_of, table_list
from ..sources.readers import read_table
from ..sources.writers import write_with_count
from .gate import ReadOnlyError, require_read_only, require_reading_plan
from .lineage import column_owners, tag_columns
from .results import render
from .tuning import hide_in_plans, tune

_SQL_ON_FILES = "spark.sql.runSQLOnFiles"


class QueryError(RuntimeError):
    """A query failed. Only the error class is passed on, since messages quote values."""


@contextmanager
def _errors_without_values() -> Iterator[None]:
    try:
        yield
    except Exception as error:
        named = isinstance(error, PySparkException) and error.getCondition()
        raise QueryError(named or type(error).__name__) from None


def _rows_written(result: DataFrame) -> int | None:
    """The rows that a statement wrote when it ran, if its plan counts them."""
    plan = result._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() != "CommandResultExec":
        return None
    counts = plan.commandPhysicalPlan().metrics()
    return counts.apply("numOutputRows").value() if counts.contains("numOutputRows") else None


class MaskedSession:
    """SQL over registered tables, with every result masked by policy.

    ``mask_at="output"`` lets predicates, joins and aggregates see raw values and masks
    the result by lineage: a computed column is masked as the strictest of the columns
    it is made of. A column without lineage is looked up by its name in the tables the
    statement names, then judged by the name itself. What a predicate, a count or a
    length tells is not masked. ``mask_at="source"`` masks the tables themselves, so no view shows a raw
    value, at the price of predicates seeing masks. Do not also save the raw tables in
    the session's catalog in that mode.
    """

    def __init__(
        self, spark: SparkSession, policy: Policy | None = None, mask_at: str = "output"
    ) -> None:
        if mask_at not in ("output", "source"):
            raise ValueError("mask_at is 'output' or 'source'")
        self.spark = tune(spark)
        self.policy = policy or Policy()
        if self.policy.seed:
            hide_in_plans(spark)
        self.mask_at = mask_at
        self.tables: dict[str, DataFrame] = {}

    def register(self, table: str, df: DataFrame) -> MaskedSession:
        """Make a table known to queries under its bare name."""
        key = self.policy.table_key(table)
        bare = key.rpartition(".")[2]
        if any(k != key and k.rpartition(".")[2] == bare for k in self.tables):
            raise ValueError(f"a table named {bare} is registered already")
        self.tables[key] = df
        view = tag_columns(df, key)
        if self.mask_at == "source":
            view = redact(view, self.policy)
        view.createOrReplaceTempView(bare)
        return self

    def register_files(
        self, table: str, path: str, fmt: str = "parquet", **options: str
    ) -> MaskedSession:
        """``register`` for files: what is taken out of a struct keeps its lineage, too."""
        key = self.policy.table_key(table)
        return self.register(table, read_table(self.spark, path, fmt, key, **options))

    def add_catalog(self) -> MaskedSession:
        """Make the catalog tables of the allowed schemas known to reports and scans."""
        if self.mask_at == "source":
            raise ValueError("catalog tables can be read raw; register masked views instead")
        for schema in self.policy.allowed_schemas:
            for found in self.spark.catalog.listTables(schema):
                if not found.isTemporary:
                    name = f"{schema}.{found.name}"
                    self.tables[self.policy.table_key(name)] = self.spark.table(name)
        return self

    @contextmanager
    def _no_path_tables(self) -> Iterator[None]:
        # Naming a file in place of a table would go past views, tags and masks.
        before = self.spark.conf.get(_SQL_ON_FILES)
        self.spark.conf.set(_SQL_ON_FILES, "false")
        try:
            yield
        finally:
            self.spark.conf.set(_SQL_ON_FILES, before)

    def _run(self, sql: str, params: Mapping[str, Any] | None = None) -> DataFrame:
        """The unmasked result of a statement that passes the gate."""
        if self.policy.read_only:
            require_read_only(sql, self.spark, params)
        with _errors_without_values(), self._no_path_tables():
            result = self.spark.sql(sql, args=dict(params) if params else None)
        if self.policy.read_only:
            require_reading_plan(result, self.policy.allowed_functions)
        return result

    def sql(
        self,
        sql: str,
        params: Mapping[str, Any] | None = None,
        reveal_columns: Iterable[str] = (),
        reveal_types: Iterable[str] = (),
    ) -> DataFrame:
        """A masked, uncapped DataFrame: write it, join it, or ``render`` it.

        What it raises when it runs is Spark's own error, whose message may quote values that a
        cast or a function failed on; ``query`` and ``write`` pass on its class alone.
        """
        if self.mask_at == "source":
            if reveal_columns or reveal_types:
                raise ValueError("tables masked at the source have nothing to reveal")
            return self._run(sql, params)
        result = self._run(sql, params)
        named = tables_named(sql, self.policy.default_schema)
        made_of = column_owners(result)
        return redact(result, self.policy, named, reveal_columns, reveal_types, made_of)

    def query(
        self,
        sql: str,
        params: Mapping[str, Any] | None = None,
        reveal_columns: Iterable[str] = (),
        reveal_types: Iterable[str] = (),
        max_cell_chars: int | None = V.MAX_CELL_CHARS,
        form: str | None = None,
    ) -> str:
        """The masked result as text, at most ``max_rows`` rows of it; ``form`` as in ``render``."""
        result = self.sql(sql, params, reveal_columns, reveal_types)
        if not result.columns:
            rows = _rows_written(result)
            return V.EXECUTED if rows is None else V.ROWS_AFFECTED.format(rows=rows)
        with _errors_without_values():
            return render(result, self.policy.max_rows, max_cell_chars, form)

    def write(self, sql: str, params: Mapping[str, Any] | None = None, **target: Any) -> int:
        """Write the masked result of a query; returns the rows written."""
        if self.policy.read_only:
            raise ReadOnlyError(f"{V.WRITES_REFUSED}. The session is read-only.")
        result = self.sql(sql, params)
        with _errors_without_values():
            return write_with_count(result, **target)

    def explain(self, sql: str) -> str:
        """The physical plan of a query, as Spark formats it."""
        row = self._run(f"EXPLAIN FORMATTED {sql}").first()
        return row[0]

    def configure(
        self, table: str, column: str, masking_style: str = "partial", pii_type: str | None = None
    ) -> str:
        """Override a column for the queries that follow; not persisted."""
        self.policy = self.policy.with_rule(table, column, masking_style, pii_type)
        key = self.policy.table_key(table)
        if self.mask_at == "source" and key in self.tables:
            self.register(key, self.tables[key])
        told = V.UPDATED.format(key=key, column=column, style=masking_style)
        return told + (f", as {pii_type}" if pii_type else "")

    def scan(self, *tables: str, json_share: float | None = None) -> DataFrame:
        """Classify tables (all by default) by value too, and remember the outcome."""
        keys = [self.policy.table_key(t) for t in tables] or list(self.tables)
        chosen = {k: self.tables[k] for k in keys}
        found = scan_tables(self.spark, chosen, self.policy, json_share)
        found = self.spark.createDataFrame(found.collect(), found.schema)  # one row per column
        self.policy = remember(self.policy, found)
        return found

    def report(self, table: str | None = None) -> DataFrame:
        """One row per column of the registered tables: what it is, how it is masked."""
        columns = columns_of(self.spark, self.tables)
        decisions = decisions_from_policy(self.spark, self.policy)
        classified = classify_columns(columns, decisions, self.policy.auto_detect)
        return pii_report(self.spark, classified, self.policy, table)

    def describe(self, table: str | None = None, show_pii: bool = True) -> str:
        """Names of all tables, or the columns of one."""
        if table is None:
            keys = [r[0] for r in table_list(columns_of(self.spark, self.tables)).collect()]
            return "\n".join([V.TABLES_FOUND.format(count=len(keys)), "", *keys])
        return schema_text(self.report(table), table, show_pii)

    def rules(self) -> str:
        """Every classified or excluded column with its effective style."""
        return rule_text(self.report())
