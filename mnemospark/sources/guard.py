"""What a caller's SQL text may do: read the tables it is given, by names resolved scope by scope.

The text is parsed by Spark and its tree is walked: only the relational nodes
listed here may stand in it, a relation must be a given table or a CTE that is
visible where it is named, and a function must be one of Spark's own outside
the group that reaches beyond the data (static JVM methods among them).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Relational nodes of a parsed query; commands, scripts, table functions and time travel are none of them.
_NODES = set(
    "Project Filter Aggregate Join AsOfJoin LateralJoin SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedWith UnresolvedRelation UnresolvedInlineTable Sort GlobalLimit LocalLimit LimitAll Offset Distinct Union"
    " Intersect Except WithWindowDefinition UnresolvedHaving Generate Pivot UnresolvedPivot Unpivot OneRowRelation LocalRelation UnresolvedHint Sample".split()
)
#: Of Spark's miscellaneous functions only these: the others tell of the session or call into the JVM.
_GROUP, _HARMLESS = "misc_funcs", {"typeof", "equal_null", "assert_true", "raise_error"}


def _seq(items) -> Iterator:
    """The elements of a Scala sequence."""
    at = items.iterator()
    while at.hasNext():
        yield at.next()


def parse(spark: SparkSession, sql: str):
    """The tree of one query text; ValueError if it is none."""
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise ValueError("only queries are allowed") from error


class _Walk:
    def __init__(self, spark: SparkSession, tables: set[str]):
        self.tables, self.markers = {t.lower() for t in tables}, []
        jvm = spark._jvm.org.apache.spark.sql.catalyst
        self.identifier, self.registry = jvm.FunctionIdentifier, jvm.analysis.FunctionRegistry.builtin()

    def function(self, name: str) -> None:
        info = self.registry.lookupFunction(self.identifier(name.lower()))
        if info.isEmpty() or (info.get().getGroup() == _GROUP and name.lower() not in _HARMLESS):
            raise ValueError(f"{name}: this function may not be called")

    def plan(self, node, visible: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in _NODES:
            raise ValueError(f"{kind}: only queries of the given tables are allowed")
        if kind == "UnresolvedWith":
            for relation in _seq(node.cteRelations()):
                own = visible | {relation._1().lower()} if node.allowRecursion() else visible
                self.plan(relation._2(), own)
                visible = visible | {relation._1().lower()}
            self.plan(node.child(), visible)
            return
        if kind == "UnresolvedRelation":
            name = ".".join(_seq(node.multipartIdentifier()))
            if name.lower() not in visible and name.lower() not in self.tables:
                raise ValueError(f"{name}: only {', '.join(sorted(self.tables))} may be read")
        for expression in _seq(node.expressions()):
            self.expression(expression, visible)
        for child in _seq(node.children()):
            self.plan(child, visible)

    def expression(self, node, visible: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            self.function(".".join(_seq(node.nameParts())))
        elif kind == "UnresolvedGenerator":
            self.function(node.name().funcName())
        elif kind == "NamedParameter":
            self.markers.append(node.name())
        elif kind == "PosParameter":
            raise ValueError("only named markers are allowed")
        elif kind.startswith("UnresolvedTableValued") or "UDF" in kind or kind == "CallMethodViaReflection":
            raise ValueError(f"{kind}: this function may not be called")
        elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            self.plan(node.plan(), visible)
        for child in _seq(node.children()):
            self.expression(child, visible)


def check(spark: SparkSession, sql: str, tables: set[str]) -> list[str]:
    """The markers (:name) of a query that reads `tables` only, in the order they stand; ValueError for any other text."""
    walk = _Walk(spark, tables)
    walk.plan(parse(spark, sql), frozenset())
    return walk.markers
