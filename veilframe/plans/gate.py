"""What a read-only session may run.

Spark runs commands as soon as they are handed over and has no read-only
transaction, so a statement is judged before that, twice: by the plan that Spark's
parser makes of it, and by its text. A query is judged a third time, before any of it
runs: by its analysed plan, in which every name has become what it stands for. There
only what is listed here passes. Each of the three can refuse.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import vocabulary as V

# Opening words of statements that only read.
READ_STATEMENTS = ("SELECT", "FROM", "WITH", "VALUES", "TABLE", "SHOW", "DESCRIBE", "DESC", "EXPLAIN")

_CODE = ("java_method", "reflect", "try_reflect")
_FORBIDDEN = (
    (re.compile(rf"\b({V.WRITE_WORDS}|MERGE)\b", re.I), "it may change data"),
    (re.compile(rf"\b({'|'.join(_CODE)})\b", re.I), "it runs code"),
    (re.compile(r"\bTRANSFORM\b.*\bUSING\b", re.I | re.S), "it runs a script"),
    (
        re.compile(r"\A\s*DESC(RIBE)?\b.*\b(EXTENDED|FORMATTED|PARTITION)\b", re.I | re.S),
        "it shows stored values",
    ),
    (re.compile(r"\A\s*SHOW\s+(PARTITIONS|TABLE\s+EXTENDED)\b", re.I), "it shows stored values"),
)

# Commands whose plans may run: they read the catalog, no stored value.
_READING_COMMANDS = {
    "ShowTables", "ShowColumns", "ShowViews", "ShowFunctions", "ShowNamespaces", "ShowNamespacesCommand",
    "ShowCatalogsCommand", "ShowCurrentNamespaceCommand", "DescribeRelation", "DescribeColumn",
    "DescribeNamespace", "DescribeFunction", "DescribeQueryCommand", "ExplainCommand",
}
_CHANGING = {"Command", "ParsedStatement"}
# The statements that these two hold are inside them, not among their children.
_HOLDING = {"ExplainCommand": "logicalPlan", "DescribeQueryCommand": "plan"}

# Nodes that an analysed query may hold: they read, and change or run nothing.
_READING_NODES = {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "AsOfJoin", "Window", "Sort", "GlobalLimit", "LocalLimit",
    "LimitAll", "Offset", "Tail", "Distinct", "Deduplicate", "Union", "UnionLoop", "UnionLoopRef", "Except", "Intersect",
    "Subquery", "SubqueryAlias", "WithCTE", "CTERelationDef", "CTERelationRef", "Generate", "Expand", "Pivot", "Unpivot",
    "Repartition", "RepartitionByExpression", "RebalancePartitions", "Sample", "ResolvedHint", "OneRowRelation", "Range",
    "LocalRelation", "LogicalRelation", "LogicalRDD", "InMemoryRelation", "HiveTableRelation", "DataSourceV2Relation",
    "DataSourceV2ScanRelation", "StreamingRelation", "StreamingRelationV2", "StreamingDataSourceV2Relation",
    "EventTimeWatermark", "View", "SQLFunctionNode", "PipeOperator",
}
# Spark's own expressions live here; none elsewhere passes.
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
_EXPRESSION_PARTS = ("", "aggregate.", "json.", "xml.", "variant.", "st.")
# Those among them that call code by its name.
_CALLING = {"CallMethodViaReflection", "TryReflect"}


class ReadOnlyError(PermissionError):
    """A statement was refused because the session is read-only."""


class _OpenEnded(ValueError):
    """A comment does not end."""


def _quoted_end(sql: str, start: int, escapes: bool) -> int | None:
    """The place after the quote that opens at ``start``, if it ends; a backslash escapes or does not."""
    quote, i = sql[start], start + 1
    while i < len(sql):
        if sql[i] == "\\" and escapes and quote != "`":
            i += 2
        elif sql[i] == quote:
            return i + 1
        else:
            i += 1
    return None


def _comment_end(sql: str, start: int) -> int:
    """The place after the bracketed comment that opens at ``start``; comments nest."""
    depth, i = 1, start + 2
    while i < len(sql):
        if sql.startswith("*/", i):
            depth, i = depth - 1, i + 2
            if not depth:
                return i
        elif sql.startswith("/*", i):
            depth, i = depth + 1, i + 2
        else:
            i += 1
    raise _OpenEnded


def _line_end(sql: str, start: int) -> int:
    """The end of a line comment: a line feed or a carriage return, unless a backslash carries it on."""
    i = start
    while i < len(sql) and sql[i] not in "\r\n":
        i += 2 if sql.startswith("\\\n", i) else 1
    return i


def _bare(sql: str, escapes: bool) -> str:
    """The statement with comments dropped and literals emptied; a hint (``/*+``) is no comment."""
    out, i = [], 0
    while i < len(sql):
        dollar = re.compile(r"\$[A-Za-z]*\$").match(sql, i)
        if sql.startswith("--", i):
            i = _line_end(sql, i)
            out.append(" ")
        elif sql.startswith("/*", i) and not sql.startswith("/*+", i):
            i = _comment_end(sql, i)
            out.append(" ")
        elif dollar:
            end = sql.find(dollar.group(), dollar.end())
            out.append("''" if end >= 0 else sql[dollar.end() :])
            i = end + len(dollar.group()) if end >= 0 else len(sql)
        elif sql[i] in "'\"`":
            raw = re.search(r"(?<!\w)[rR]\Z", "".join(out[-2:])) is not None
            end = _quoted_end(sql, i, escapes and not raw)
            out.append("''" if end else sql[i + 1 :])  # what follows an open quote counts as SQL
            i = end or len(sql)
        else:
            out.append(sql[i])
            i += 1
    return "".join(out)


def refusal(sql: str) -> str | None:
    """Why the text of a statement is refused, or None."""
    for escapes in (True, False):
        try:
            bare = _bare(sql, escapes)
        except _OpenEnded:
            return "a comment in it does not end"
        first = re.match(r"[\s(]*([A-Za-z]+)", bare)
        if first is None or first.group(1).upper() not in READ_STATEMENTS:
            return "it is not a query"
        if ";" in bare.strip().rstrip(";"):
            return "it is more than one statement"
        for pattern, why in _FORBIDDEN:
            if pattern.search(bare):
                return why
    # The name of a function may be quoted as an identifier.
    if re.search(rf"`\s*({'|'.join(_CODE)})\s*`", sql, re.I):
        return "it runs code"
    return None


def _parts(node, kinds: set[str]) -> Iterator:
    """The plans and expressions directly inside a plan node or an expression."""
    inside = [node.children(), node.innerChildren()]
    if "LogicalPlan" in kinds:
        inside.append(node.expressions())
    if "PlanExpression" in kinds:
        yield node.plan()
    for found in inside:
        yield from (found.apply(i) for i in range(found.size()))


def _named_by(expression, params: Mapping[str, Any]) -> str | None:
    """The name that an identifier clause spells with literals, parameters and joins of them; None if by more."""
    kind = expression.getClass().getSimpleName()
    if kind == "Literal":
        return str(expression.value())
    if kind == "NamedParameter":
        value = params.get(expression.name())
        return value if isinstance(value, str) else None
    if kind != "Concat":
        return None
    parts = [_named_by(part, params) for part in _each(expression.children())]
    return None if None in parts else "".join(parts)


def plan_refusal(spark: SparkSession, sql: str, params: Mapping[str, Any] | None = None) -> str | None:
    """Why the plan that Spark's parser makes of a statement is refused, or None.

    A statement that Spark cannot parse is left to Spark, which reports it.
    """
    session = spark._jsparkSession.sessionState()
    try:
        todo = [session.sqlParser().parsePlan(sql)]
    except Exception:  # noqa: BLE001  the parser's own error is raised when the statement runs
        return None
    while todo:
        node = todo.pop()
        kind, kinds = node.getClass().getSimpleName(), _kinds(node.getClass())
        if kind in _HOLDING:
            todo.append(getattr(node, _HOLDING[kind])())
        if kind == "ScriptTransformation":
            return "it runs a script"
        if kind in ("ExpressionWithUnresolvedIdentifier", "PlanWithUnresolvedIdentifier"):
            # Spark works such a name out while it analyses, so nothing may run in it.
            named = _named_by(node.identifierExpr(), params or {})
            if named is None:
                return "it names something by an expression"
            if named.rpartition(".")[2].strip("` ").lower() in _CODE:
                return "it runs code"
        if kind == "UnresolvedFunction":
            name = node.nameParts()
            if name.apply(name.size() - 1).lower() in _CODE:
                return "it runs code"
        if kind in ("DescribeRelation", "DescribeColumn") and node.isExtended():
            return "it shows stored values"
        if kind == "DescribeRelation" and not node.partitionSpec().isEmpty():
            return "it shows stored values"
        if kind in ("CompoundBody", "UnresolvedExecuteImmediate"):
            return "it is more than one statement"
        if kind not in _READING_COMMANDS and _CHANGING & kinds:
            return "it is not a query"
        todo.extend(_parts(node, kinds))
    return None


def analysed_refusal(plan, allowed_functions: Iterable[str] = ()) -> str | None:
    """Why an analysed query is refused, or None: every node and expression in it has to be a known one.

    ``plan`` is the analysed plan of a query that has not run. Functions that were registered in
    the session pass if they are named in ``allowed_functions``; what views are made of is
    their maker's affair.
    """
    allowed = {name.lower() for name in allowed_functions}
    todo = [plan]
    while todo:
        node = todo.pop()
        kind, kinds, full = node.getClass().getSimpleName(), _kinds(node.getClass()), node.getClass().getName()
        if "LogicalPlan" in kinds:
            if kind not in _READING_NODES:
                return "it is not a query"
            if kind == "View":
                continue
            todo.extend(_each(node.expressions()))
        elif "UserDefinedExpression" in kinds:
            if node.name().rpartition(".")[2].lower() not in allowed:
                return "it calls a function that is not allowed"
        elif kind in _CALLING:
            return "it runs code"
        elif not any(full == _EXPRESSIONS + part + full.rpartition(".")[2] for part in _EXPRESSION_PARTS):
            return "it uses an expression that is not known to read only"
        if "PlanExpression" in kinds:
            todo.append(node.plan())
        # What Spark puts in place of a function is Spark's own; what it is given is not.
        todo.extend(_each(node.parameters() if "InheritAnalysisRules" in kinds else node.children()))
    return None


def _each(items) -> Iterator:
    return (items.apply(i) for i in range(items.size()))


def _kinds(cls) -> set[str]:
    """The simple names of a class, of its parents and of what it implements."""
    found, todo = set(), [cls]
    while todo:
        one = todo.pop()
        if one is not None and one.getSimpleName() not in found:
            found.add(one.getSimpleName())
            todo += [one.getSuperclass(), *one.getInterfaces()]
    return found


def require_read_only(sql: str, spark: SparkSession | None = None, params: Mapping[str, Any] | None = None) -> None:
    """Raise unless the statement only reads, by its text and by what the parser makes of it."""
    why = refusal(sql) or (plan_refusal(spark, sql, params) if spark is not None else None)
    if why is not None:
        raise _refused(why)


def require_reading_plan(df: DataFrame, allowed_functions: Iterable[str] = ()) -> None:
    """Raise unless the analysed plan of a query that has not run only reads."""
    plan = df._jdf.queryExecution().analyzed()
    if {"Command", "CommandResult"} & _kinds(plan.getClass()):
        return  # the parser's plan let it pass, so it is one of the reading commands, and it has run
    why = analysed_refusal(plan, allowed_functions)
    if why is not None:
        raise _refused(why)


def _refused(why: str) -> ReadOnlyError:
    return ReadOnlyError(f"{V.WRITES_REFUSED}: {why}. The session is read-only.")
