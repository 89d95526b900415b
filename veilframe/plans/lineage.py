"""Where an output column came from, carried as column metadata.

The tag follows a column through renames, joins, grouping, windows, ordering and
common table expressions. What is computed has none; ``column_owners`` reads from the
analysed plan what it is made of.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = "veil"


def tag_columns(df: DataFrame, table_key: str) -> DataFrame:
    """Mark every column of a base table with the table and its own name."""
    return df.select(
        *[
            F.col(quoted(f.name)).alias(
                f.name, metadata={**f.metadata, TAG: {"table": table_key, "column": f.name}}
            )
            for f in df.schema.fields
        ]
    )


def tagged_schema(schema: T.StructType, table_key: str) -> T.StructType:
    """The schema with every field tagged, fields of structs at any depth included.

    A table read with it keeps the tag on what is taken out of a struct, or out of an
    array or map of structs. The owner of a nested field is the path to its struct.
    """

    def tagged(dtype: T.DataType, path: str) -> T.DataType:
        if isinstance(dtype, T.StructType):
            return T.StructType(
                [
                    T.StructField(
                        f.name,
                        tagged(f.dataType, f"{path}.{f.name.lower()}"),
                        f.nullable,
                        {**(f.metadata or {}), TAG: {"table": path, "column": f.name}},
                    )
                    for f in dtype.fields
                ]
            )
        if isinstance(dtype, T.ArrayType):
            return T.ArrayType(tagged(dtype.elementType, path), dtype.containsNull)
        if isinstance(dtype, T.MapType):
            value = tagged(dtype.valueType, path)
            return T.MapType(dtype.keyType, value, dtype.valueContainsNull)
        return dtype

    return tagged(schema, table_key)


def owner_of(field: T.StructField) -> tuple[str, str] | None:
    """The ``(table, column)`` a result column was read from, if its tag survived."""
    tag = (field.metadata or {}).get(TAG)
    return (tag["table"], tag["column"]) if tag else None


def quoted(name: str) -> str:
    """A column name as an identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


# What these say about a column is not its value: whether and how often it is there, how long
# it is, how it compares.
_TELLING_NOTHING = {
    "Count", "CountIf", "HyperLogLogPlusPlus", "RegrCount", "IsNull", "IsNotNull", "IsNaN", "Length", "Size",
    "OctetLength", "BitLength", "ArraySize", "EqualTo", "EqualNullSafe", "GreaterThan", "GreaterThanOrEqual",
    "LessThan", "LessThanOrEqual", "In", "InSet", "InSubquery", "Exists", "Like", "RLike", "Contains",
    "StartsWith", "EndsWith", "Not", "And", "Or", "BoolAnd", "BoolOr",
}

# Expressions without parts that hold no value of a column.
_EMPTY = {
    "Literal", "CurrentDate", "CurrentTimestamp", "Now", "LocalTimestamp", "CurrentTimestampLike", "CurrentTime",
    "CurrentTimeZone", "CurrentDatabase", "CurrentCatalog", "CurrentUser", "SparkVersion", "Rand", "Randn", "Uuid",
    "MonotonicallyIncreasingID", "SparkPartitionID", "InputFileName", "InputFileBlockStart", "InputFileBlockLength",
    "RowNumber", "Rank", "DenseRank", "PercentRank", "CumeDist", "NTile", "Pi", "EulerNumber", "NamedLambdaVariable",
    "SpecifiedWindowFrame", "UnboundedPreceding$", "UnboundedFollowing$", "CurrentRow$", "UnspecifiedFrame$",
    "VirtualColumn", "GroupingID", "MakeTimestamp",
}
# Nodes whose expressions make up, with what their children put out, every column they put out.
_EXPLAINED = {"Generate", "Expand", "Project", "Aggregate", "Window"}

# What these give back holds whole values, as they were or among others. All else cuts, turns or counts
# them, and may leave a piece of which a partial mask would show all.
_WHOLE = {
    "Alias", "AttributeReference", "OuterReference", "Cast", "AggregateExpression", "WindowExpression", "Max", "Min", "First", "Last",
    "AnyValue", "Mode", "NthValue", "Lag", "Lead", "MaxBy", "MinBy", "CollectList", "CollectSet", "ListAgg", "Coalesce", "If",
    "CaseWhen", "NullIf", "Nvl", "Nvl2", "IfNull", "Least", "Greatest", "Upper", "Lower", "InitCap", "StringTrim", "StringTrimBoth",
    "StringTrimLeft", "StringTrimRight", "StringLPad", "StringRPad", "Concat", "ConcatWs", "CreateArray", "CreateNamedStruct",
    "CreateMap", "MapFromArrays", "MapFromEntries", "StructsToJson", "GetStructField", "GetArrayItem", "GetArrayStructFields",
    "GetMapValue", "ElementAt", "Get", "ArrayJoin", "SortArray", "ArraySort", "ArrayDistinct", "ArrayUnion", "ArraysZip", "Flatten",
    "Slice", "ArrayMax", "ArrayMin", "ArrayFilter", "ArrayTransform", "LambdaFunction", "MapKeys", "MapValues", "Explode",
    "PosExplode", "Inline", "Stack", "Literal", "NamedLambdaVariable", "ScalarSubquery", "LateralSubquery", "ToPrettyString",
    "KnownNotNull", "KnownNullable",
}


class Owners(frozenset[tuple[str, str]]):
    """Base columns ``(table, column)``; ``pieces`` are those of which a part of a value may be left."""

    pieces: frozenset[tuple[str, str]] = frozenset()


def _owners(found: frozenset[tuple[str, str, bool]]) -> Owners:
    owners = Owners((table, column) for table, column, _ in found)
    owners.pieces = frozenset((table, column) for table, column, whole in found if not whole)
    return owners


def column_owners(df: DataFrame) -> list[Owners]:
    """For each output column, the base columns whose values can be in it.

    They are taken from the analysed plan: through computed columns, aggregates, windows,
    generators, subqueries, lateral joins, common table expressions, recursive ones too, and every
    side of a union. A subquery sees the columns of the query around it, as the plan names each
    column by a number of its own. What a node or an expression makes in a way not known here counts
    as made of all that has been read.
    """
    walk = _Walk()
    plan = df._jdf.queryExecution().analyzed()
    walk.visit(plan)
    return [_owners(found) for found in walk.of_output(plan)]


_Found = frozenset[tuple[str, str, bool]]


class _Walk:
    """Owners by the id of an attribute, collected from the leaves of a plan upwards."""

    def __init__(self) -> None:
        self.known: dict[int, _Found] = {}
        self.shared: dict[int, list[_Found]] = {}  # of common table expressions

    def of_output(self, plan) -> list[_Found]:
        return [self.known.get(a.exprId().id(), frozenset()) for a in _each(plan.output())]

    def visit(self, plan) -> None:
        kind = plan.getClass().getSimpleName()
        children = list(_each(plan.children()))
        if kind == "UnionLoop":
            return self._visit_loop(plan)
        for child in children:
            self.visit(child)
        expressions = list(_each(plan.expressions()))
        for expression in expressions:
            self._visit_subqueries(expression)
        for expression in expressions:
            if expression.getClass().getSimpleName() == "Alias":
                self._learn(expression, self._inside(expression))
        if kind == "CTERelationDef":
            self.shared[plan.id()] = self.of_output(plan)
        sides = [self.of_output(c) for c in children] if kind == "Union" else []
        if kind == "CTERelationRef":
            sides = [self.shared.get(plan.cteId(), [])]
        if kind == "UnionLoopRef":
            sides = [self.shared.get(plan.loopId(), [])]
        if sides:
            self._learn_sides(plan, sides)
        for attribute in _each(plan.output()):
            if attribute.exprId().id() not in self.known:
                made_of = frozenset().union(*map(self._inside, expressions)) if children else frozenset()
                if children and kind not in _EXPLAINED:
                    made_of = made_of.union(*(o for c in children for o in self.of_output(c)))
                self._learn(attribute, made_of)

    def _visit_loop(self, plan) -> None:
        """A recursive table: each turn puts out what the turn before did, until nothing is added."""
        anchor, recursion = plan.anchor(), plan.recursion()
        self.visit(anchor)
        self.shared[plan.id()] = self.of_output(anchor)
        while True:
            self.visit(recursion)
            before = self.shared[plan.id()]
            self.shared[plan.id()] = [a | b for a, b in zip(before, self.of_output(recursion), strict=True)]
            if self.shared[plan.id()] == before:
                break
        self._learn_sides(plan, [self.shared[plan.id()]])

    def _learn_sides(self, plan, sides: list[list[_Found]]) -> None:
        for i, attribute in enumerate(_each(plan.output())):
            both = frozenset().union(*(side[i] for side in sides if i < len(side)))
            self.known[attribute.exprId().id()] = both | _tag_of(attribute)

    def _visit_subqueries(self, expression) -> None:
        """The plans inside an expression, whose columns a lateral join puts out."""
        if _is_subquery(expression):
            self.visit(expression.plan())
        for child in _each(expression.children()):
            self._visit_subqueries(child)

    def _learn(self, named, made_of: _Found) -> None:
        """A tag says where a column was read; without one, it is what it is made of."""
        self.known[named.exprId().id()] = _tag_of(named) or made_of

    def _inside(self, expression) -> _Found:
        kind = expression.getClass().getSimpleName()
        if kind in _TELLING_NOTHING or kind in _EMPTY:
            return frozenset()
        if kind == "AttributeReference":
            return self.known.get(expression.exprId().id(), frozenset()) | _tag_of(expression)
        if kind == "OuterReference":
            return self._inside(expression.e())
        if _is_subquery(expression):
            self.visit(expression.plan())
            return frozenset().union(*self.of_output(expression.plan()))
        children = list(_each(expression.children()))
        if not children:
            return frozenset().union(*self.known.values())
        if kind in ("WindowExpression", "AggregateExpression"):
            children = children[:1]  # what orders or filters rows is not in the value
        found = frozenset().union(*map(self._inside, children))
        return found if kind in _WHOLE else frozenset((table, column, False) for table, column, _ in found)


def _is_subquery(expression) -> bool:
    return expression.getClass().getSimpleName() in ("ScalarSubquery", "LateralSubquery", "Exists", "ListQuery", "FunctionTableSubqueryArgumentExpression")


def _each(items):
    return (items.apply(i) for i in range(items.size()))


def _tag_of(named) -> _Found:
    tag = json.loads(named.metadata().json()).get(TAG)
    return frozenset([(tag["table"], tag["column"], True)]) if tag else frozenset()
