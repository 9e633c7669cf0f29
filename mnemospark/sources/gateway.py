"""Named queries with declared, typed parameters, and a guarded way around them.

A query is checked once, when it is registered: its text may only read the
given tables, and its markers must be the declared ones. A call is checked
before anything runs: the supplied names must be the declared ones, each of
the declared type. Values are bound by Spark, never put into the text.
"""

from __future__ import annotations

import datetime
import decimal
import logging
from collections import Counter
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from mnemospark.sources import guard
from mnemospark.sources.tabular import read_only

_log = logging.getLogger(__name__)

#: Parameter types and the Python values they take (True and False are booleans only).
TYPES: dict[str, tuple[type, ...]] = {"string": (str,), "long": (int,), "double": (float, int), "decimal": (decimal.Decimal, int), "boolean": (bool,), "date": (datetime.date,), "timestamp": (datetime.datetime,)}


@dataclass(frozen=True)
class NamedQuery:
    """One registered text; `sink` names where its rows are written, None for a read."""

    name: str
    sql: str
    params: Mapping[str, str] = field(default_factory=dict)
    sink: str | None = None


class Gateway:
    """Queries by name over a set of tables; sinks take the rows of writing ones."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], sinks: Mapping[str, Callable[[DataFrame], None]] | None = None):
        self.spark, self.tables, self.sinks, self.queries = spark, dict(tables), dict(sinks or {}), {}

    def register(self, query: NamedQuery) -> None:
        """ValueError for a name that is taken, an unknown type or sink, a text that is no read, or markers that aren't the declared ones."""
        if query.name in self.queries:
            raise ValueError(f"{query.name} is registered already")
        if unknown := {t for t in query.params.values() if t not in TYPES}:
            raise ValueError(f"{query.name}: unknown types {sorted(unknown)}")
        if query.sink is not None and query.sink not in self.sinks:
            raise ValueError(f"{query.name}: no sink {query.sink}")
        self._agree(query.name, set(query.params), set(guard.check(self.spark, query.sql, set(self.tables))), ValueError, "the text")
        self.queries[query.name] = query

    @staticmethod
    def _agree(name: str, declared: set[str], given: set[str], error: type[Exception], where: str) -> None:
        missing, more = sorted(declared - given), sorted(given - declared)
        if missing or more:
            raise error(f"{name}: {where} lacks {missing} and has unexpected {more}")

    def run(self, name: str, args: Iterable[tuple[str, object]] = (), **params: object) -> DataFrame | None:
        """The rows of a reading query; a writing one hands them to its sink and returns None.

        KeyError for an unknown name; TypeError, before anything runs, for
        missing, unexpected or doubly given parameters and for wrong types.
        """
        query = self.queries[name]
        given = [*args, *params.items()]
        if twice := sorted(k for k, n in Counter(k for k, _ in given).items() if n > 1):
            raise TypeError(f"{name}: {twice} given twice")
        values = dict(given)
        self._agree(name, set(query.params), set(values), TypeError, "the call")
        for key, value in values.items():
            kind = query.params[key]
            if value is not None and (not isinstance(value, TYPES[kind]) or (isinstance(value, bool) and kind != "boolean")):
                raise TypeError(f"{name}: {key} must be {kind}, not {type(value).__name__}")
        rows = read_only(self.spark, query.sql, self.tables, values)
        if query.sink is None:
            return rows
        self.sinks[query.sink](rows)
        return None

    def raw(self, sql: str, reason: str, **params: object) -> DataFrame:
        """Any read of the tables, under the same guard, for a stated reason that is logged."""
        if not reason.strip():
            raise ValueError("a raw query needs a reason")
        self._agree("raw query", set(guard.check(self.spark, sql, set(self.tables))), set(params), TypeError, "the call")
        _log.info("raw query (%s): %s", reason.strip(), sql)
        return read_only(self.spark, sql, self.tables, params)
