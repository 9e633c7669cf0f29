"""The SQL guard, named queries and chains that don't end."""

import logging

import pytest

from mnemospark.operators import workspace
from mnemospark.sources import tabular
from mnemospark.sources.gateway import Gateway, NamedQuery


@pytest.fixture(scope="module")
def data(spark):
    spark.createDataFrame([(9,)], "s int").createOrReplaceTempView("secret")
    return spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "a int, b string")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT a FROM data WHERE EXISTS (WITH secret AS (SELECT 1) SELECT * FROM secret) AND a < (SELECT max(s) FROM secret)",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home') FROM data",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM data",
        "SELECT try_reflect('java.lang.System', 'getProperty', 'user.home') FROM data",
        "SELECT current_user() FROM data",
        "SELECT a FROM data LATERAL VIEW explode(array((SELECT max(s) FROM secret))) t AS x",
        "SELECT TRANSFORM (a) USING 'cat' AS x FROM data",
        "WITH x AS (SELECT * FROM y), y AS (SELECT 1) SELECT * FROM x",
        "SELECT * FROM data TIMESTAMP AS OF '2020-01-01'",
        "SELECT a FROM data ORDER BY (SELECT max(s) FROM secret)",
        "SELECT no_such(a) FROM data",
        "TABLE secret",
        "SELECT * FROM VALUES (1) AS t(x) JOIN secret",
        "SELECT a, (SELECT s FROM secret WHERE s > outer_.a) FROM data AS outer_",
        "SELECT max(a) OVER (ORDER BY (SELECT max(s) FROM secret)) FROM data",
        "SELECT transform(array(1), x -> x + (SELECT max(s) FROM secret)) FROM data",
    ],
)
def test_refused(data, sql):
    with pytest.raises(ValueError):
        tabular.query(data, sql)


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("WITH x AS (SELECT a FROM data), y AS (SELECT a + 1 AS a FROM x) SELECT sum(a) FROM y", [(9,)]),
        ("SELECT a FROM data WHERE a IN (WITH z AS (SELECT max(a) AS m FROM data) SELECT m FROM z)", [(3,)]),
        ("SELECT upper(b), count(*) FROM DATA GROUP BY 1 HAVING count(*) > 0 ORDER BY 1 LIMIT 1", [(None, 1)]),
        ("SELECT x FROM data LATERAL VIEW explode(array(a, 10)) t AS x WHERE a = 1 ORDER BY x", [(1,), (10,)]),
        ("SELECT a FROM data UNION SELECT 7 EXCEPT SELECT 1 INTERSECT SELECT 1 ORDER BY 1 LIMIT 1", [(2,)]),
        ("SELECT row_number() OVER w FROM data WINDOW w AS (ORDER BY a) ORDER BY 1 LIMIT 1", [(1,)]),
        ("SELECT typeof(a) FROM data WHERE a = 1", [("int",)]),
        ("VALUES (1)", [(1,)]),
    ],
)
def test_allowed(spark, data, sql, rows):
    before = {t.name for t in spark.catalog.listTables()}
    assert [tuple(r) for r in tabular.query(data, sql).collect()] == rows
    assert {t.name for t in spark.catalog.listTables()} == before  # no view is left behind


def test_named_queries(spark, data, caplog):
    kept = []
    gate = Gateway(spark, {"data": data, "other": data}, {"kept": lambda rows: kept.extend(rows.collect())})
    gate.register(NamedQuery("above", "SELECT a FROM data WHERE a > :least AND (b <> :b OR b IS NULL) ORDER BY a", {"least": "long", "b": "string"}))
    gate.register(NamedQuery("keep", "SELECT a FROM other WHERE a = :a", {"a": "long"}, "kept"))
    assert [r.a for r in gate.run("above", least=0, b="a' OR '1' = '1").collect()] == [1, 2, 3]
    assert [r.a for r in gate.run("above", [("least", 1)], b="c").collect()] == [2]
    assert gate.run("keep", a=3) is None and [r.a for r in kept] == [3]
    for bad in ({"least": 1}, {"least": 1, "b": "x", "c": 2}, {}, {"least": "1", "b": "x"}, {"least": True, "b": "x"}):
        with pytest.raises(TypeError):
            gate.run("above", **bad)
    with pytest.raises(TypeError, match=r"lacks \['b'\] and has unexpected \['c'\]"):
        gate.run("above", least=1, c=2)
    with pytest.raises(TypeError, match="twice"):
        gate.run("above", [("least", 1), ("least", 2)], b="x")
    with pytest.raises(KeyError):
        gate.run("none")
    for bad in (
        NamedQuery("above", "SELECT 1"), NamedQuery("x", "SELECT :a", {}), NamedQuery("x", "SELECT 1", {"a": "long"}), NamedQuery("x", "SELECT * FROM secret"), NamedQuery("x", "SELECT :a", {"a": "blob"}),
        NamedQuery("x", "INSERT INTO data SELECT 1"), NamedQuery("x", "SELECT a FROM data", {}, "nowhere"), NamedQuery("x", "SELECT ?", {}),
    ):
        with pytest.raises(ValueError):
            gate.register(bad)
    with caplog.at_level(logging.INFO):
        assert gate.raw("SELECT max(a) AS m FROM data WHERE a < :x", "a count by hand", x=3).collect()[0].m == 2
    assert "a count by hand" in caplog.text
    with pytest.raises(ValueError):
        gate.raw("SELECT 1", " ")
    with pytest.raises(TypeError):
        gate.raw("SELECT :x", "why not")


def test_chains_and_cycles(spark):
    edges = [(1, 2), (2, 1), (3, 1), (9, 9), *((i, i + 1) for i in range(10, 43))]
    got = {r.id: (r.last, r.hops) for r in workspace.chain_end(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {i: (None, None) for i in (1, 2, 3, 9)} | {i: (43, 43 - i) for i in range(10, 43)}
    assert workspace.chain_end(spark.createDataFrame([], "src int, dst int")).count() == 0
