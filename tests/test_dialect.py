"""Results that only the dialect's own expectations pin; small tables, declared here."""

import re
from decimal import Decimal

import pytest

from quernel.engine import Engine
from quernel.errors import NotSupported, QueryError
from quernel.functions.bucket import bucket_id, murmur3


@pytest.fixture(scope="module")
def e(spark):
    out = Engine(spark)

    def table(name, columns, rows, **keys):
        kinds = {"integer": "bigint", "number": "decimal(38,10)", "string": "string", "boolean": "boolean", "double": "double"}
        names = [c for c, *_ in columns]
        frame = out.spark.createDataFrame([tuple(Decimal(str(v)) if k == "number" and v is not None else v for v, (_, k, _) in zip(r, columns, strict=True)) for r in rows], ", ".join(f"`{c}` {kinds[k]}" for c, k, _ in columns))
        out.register(name, frame, primary_key=keys.get("primary_key", tuple(names[:1])), shard_key=keys.get("shard_key", tuple(names[:1])), columns=tuple(columns))

    wide = [("id", "integer", False), *[(c, "integer", False) for c in "abcdef"], ("boolean_col", "boolean", False), ("string_col", "string", False), ("number_col", "number", False)]
    table("arithmetic_space", wide, [(1, 1, 1, 1, 1, 2, 2, True, "a", 3.14), (2, 1, 2, 1, 2, 2, 2, True, "a", 2), (3, 2, 3, 1, 2, 2, 2, True, "c", 3.14), (4, 2, 3, 1, 1, 2, 2, True, "c", 2.14)])
    table("testing_space", [("id", "integer", False), ("name", "string", False), ("product_units", "integer", False)], [(1, "123", 1), (2, "1", 1), (3, "1", 1), (4, "2", 2), (5, "123", 2), (6, "2", 4)], shard_key=("id", "name"))
    nulls = [("na", "integer", False), ("nb", "integer", True), ("nc", "integer", True)]
    table("null_t", nulls, [(1, None, 1), (2, None, None), (3, None, 3), (4, 1, 2), (5, None, 1)])
    table("null_o", nulls, [(1, 2, 1), (2, None, 3), (3, 2, 3), (4, 3, 1), (5, 1, 5), (6, -1, 3), (7, 1, 1), (8, None, -1)])
    return out


def rows(e, text, params=()):
    return e.execute(text, params).rows()


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT avg(c), avg(distinct c), avg(b), avg(distinct b) FROM arithmetic_space", [(1, 1, 2.25, 2)]),
        ("SELECT a, avg(b), avg(distinct b) FROM arithmetic_space GROUP BY a ORDER BY a", [(1, 1.5, 1.5), (2, 3, 3)]),
        ("SELECT group_concat(cast(c as string), ' '), group_concat(distinct cast(c as string)) FROM arithmetic_space", [("1 1 1 1", "1")]),
        ("SELECT a, group_concat(cast(e as string), '|') FROM arithmetic_space GROUP BY a ORDER BY a", [(1, "2|2"), (2, "2|2")]),
        ("SELECT total(id), total(distinct d / 2) FROM arithmetic_space", [(10.0, 1.0)]),
        ("SELECT total(id), sum(id), count(id), group_concat(string_col), group_concat(distinct string_col) FROM arithmetic_space WHERE id < 0", [(0.0, None, 0, None, None)]),
        ("SELECT total(nb) FROM null_t WHERE nb IS NULL", [(0.0,)]),
        ("SELECT count(*) FROM null_t", [(5,)]),
        ("SELECT na, nb FROM null_o ORDER BY nb, na", [(2, None), (8, None), (6, -1), (5, 1), (7, 1), (1, 2), (3, 2), (4, 3)]),
        ("SELECT na, nb FROM null_o ORDER BY nb DESC, na", [(4, 3), (1, 2), (3, 2), (5, 1), (7, 1), (6, -1), (2, None), (8, None)]),
        ("SELECT id FROM testing_space WHERE id = (values (1)) + (values (3)) / (values (2))", [(2,)]),
        ("SELECT trim('a' from trim('  aabb  ')), trim(both 'ab' from 'aabb')", [("bb", "")]),
        ("SELECT to_char(to_date('2020 20', '%Y %d'), '%Y-%m-%d-%H-%M-%S-%z')", [("2020-01-20-00-00-00-+0000",)]),
        ("SELECT t1.a, t2.b FROM (SELECT nb AS a FROM null_t) AS t1 LEFT JOIN (SELECT nc AS b FROM null_t) AS t2 ON t1.a = t2.b ORDER BY a", [(None, None)] * 4 + [(1, 1)] * 2),
        ("SELECT 7 / 2, -7 / 2, 7 / 2.0", [(3, -3, Decimal("3.5"))]),
        ("SELECT (1, null) = (1, null), (1, 2) <> (1, 3), (1, 2) < (1, 3), (2, 1) <= (1, 9)", [(None, True, True, False)]),
        ("SELECT count(*) FROM null_t AS a JOIN null_t AS b ON (a.na, a.nb) = (b.na, b.nb)", [(1,)]),
        ("SELECT na FROM null_t WHERE na NOT IN (SELECT nb FROM null_t)", []),
        ("SELECT na FROM null_t WHERE nb IS NOT TRUE OR true", None),
        ("SELECT name, count(*) FROM testing_space GROUP BY name HAVING count(*) = 2 ORDER BY name", [("1", 2), ("123", 2), ("2", 2)]),
        ("SELECT id FROM testing_space WHERE (id, name) IN (SELECT id, name FROM testing_space WHERE product_units = 4)", [(6,)]),
        ("SELECT \"COLUMN_2\" FROM (VALUES (1), (2)) AS v ORDER BY 1", [(1,), (2,)]),
        ("VALUES ((SELECT count(*) FROM null_t), 'x')", [(5, "x")]),
        ("SELECT 'a\\b' LIKE 'a\\\\b', 'a%' LIKE 'a!%' ESCAPE '!', 'ABC' ILIKE 'abc', NOT 'a' LIKE 'b'", [(True, True, True, True)]),
        ("SELECT id FROM testing_space ORDER BY id UNION ALL SELECT na FROM null_t ORDER BY na LIMIT 0", []),
        ("SELECT coalesce(null, nb, 7) FROM null_t WHERE na < 3", [(7,), (7,)]),
        ("SELECT case id when 1 then 'one' else 'many' end FROM testing_space WHERE id < 3 ORDER BY 1", [("many",), ("one",)]),
    ],
)
def test_results(e, text, expected):
    if expected is None:
        with pytest.raises(QueryError):
            rows(e, text)
    else:
        assert rows(e, text) == expected


@pytest.mark.parametrize(
    ("text", "says"),
    [
        ("SELECT sum(number_col) FROM arithmetic_space", "can't compute sum on argument with type number"),
        ("SELECT total(number_col) FROM arithmetic_space", "can't compute total on argument with type number"),
        ("SELECT avg(number_col) FROM arithmetic_space", "can't compute avg on argument with type number"),
        ("SELECT a.id FROM testing_space AS a JOIN testing_space AS b ON id = 1", "present in both join children"),
        ("SELECT nothing FROM testing_space", "not found"),
        ("SELECT id FROM nowhere", "no such table"),
        ("SELECT id + name FROM testing_space", "takes numbers"),
        ("SELECT boolean_col + 1 FROM arithmetic_space", "takes numbers"),
        ("SELECT id || 'x' FROM testing_space", "takes strings"),
        ("SELECT coalesce(1, 'a')", "one type"),
        ("SELECT count(*) FROM testing_space GROUP BY 1", "must have a column"),
        ("SELECT sum(sum(id)) FROM testing_space", "can't stand here"),
        ("SELECT id FROM testing_space WHERE count(*) > 1", "can't stand here"),
        ("SELECT lower(distinct name) FROM testing_space", "neither"),
        ("SELECT sum(*) FROM testing_space", "doesn't take"),
        ("SELECT id AS x FROM testing_space ORDER BY product_units", "not found"),
        ("SELECT id FROM testing_space ORDER BY 2", "position"),
        ("SELECT id FROM testing_space ORDER BY 'a'", "must have a column"),
        ("SELECT id FROM testing_space UNION SELECT id, name FROM testing_space", "columns"),
        ("WITH testing_space AS (SELECT 1) SELECT 1", "there already"),
        ("WITH c AS (SELECT 1), c AS (SELECT 2) SELECT 1", "there already"),
        ("SELECT (SELECT id, name FROM testing_space)", "isn't a value"),
        ("SELECT id FROM testing_space WHERE lower(name)", "needs a condition"),
        ("SELECT id FROM testing_space WHERE (id, name) = (1, '2', 3)", "compared"),
        ("SELECT nofunc(id) FROM testing_space", "no such function"),
        ("SELECT id FROM testing_space WHERE id IN (SELECT id, name FROM testing_space)", "compares"),
        ("SELECT *", "needs a FROM"),
        ("VALUES (1, 2), (3)", "same length"),
        ("SELECT id FROM testing_space OPTION (vtable_max_rows = 5)", "more than 5 rows"),
    ],
)
def test_errors(e, text, says):
    with pytest.raises(QueryError, match=says):
        rows(e, text)


def test_metadata_and_names(e):
    out = e.execute("SELECT id, id + 1, name AS n, count(*) FROM testing_space GROUP BY id, id + 1, name")
    assert out.metadata == [{"name": "id", "type": "integer"}, {"name": "col_1", "type": "integer"}, {"name": "n", "type": "string"}, {"name": "col_2", "type": "integer"}]
    assert out.df.columns == ["id", "col_1", "n", "col_2"]
    assert e.sql("VALUES (1), (2)").columns == ["COLUMN_2"]
    assert e.sql("SELECT * FROM testing_space").columns == ["id", "name", "product_units"]


def test_parameters(e):
    assert rows(e, "SELECT id FROM testing_space WHERE id > ? AND name = ? ORDER BY 1", (2, "1", "unused")) == [(3,)]
    assert rows(e, "SELECT $1 + $1, $2 FROM testing_space WHERE id = $1", (1, None)) == [(2, None)]
    with pytest.raises(QueryError, match="needed"):
        rows(e, "SELECT ?, ?", (1,))
    assert e.parameter_types("SELECT id FROM testing_space WHERE id = $2 AND name = $1 AND $3 > cast($4 as double)") == ["string", "integer", "double", "double"]
    assert rows(e, "SELECT id FROM testing_space OPTION (vtable_max_rows = ?, vdbe_max_steps = 1)", (6,))


def test_union_of_mixed_types_fails_when_it_runs(e):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        e.sql("SELECT id FROM testing_space UNION SELECT string_col FROM arithmetic_space").collect()


@pytest.mark.parametrize(("text", "bucket"), [("100тесты", 17339), ("1123", 360), ("daymonthyear", 3333), ("18810", 1)])
def test_bucket_vectors(e, text, bucket):
    assert bucket_id(text) == e.calculate_bucket_id(text) == bucket


def test_bucket_column_equals_the_function(e):
    texts = ["", "a", "ab", "abc", "abcd", "abcde", "ünïcödé", "x" * 100, "1123", None]
    e.register("keyed", e.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, k string"), primary_key=("id",), shard_key=("k", "id"))
    assert {i: b for i, b in rows(e, 'SELECT id, "bucket_id" FROM keyed')} == {i: bucket_id([t, i]) for i, t in enumerate(texts)}
    assert rows(e, 'SELECT a."bucket_id" = b."bucket_id" FROM keyed AS a JOIN keyed AS b ON a.id = b.id WHERE a.id = 1') == [(True,)]
    assert e.calculate_bucket_id({"k": "a", "id": 1}, "keyed") == e.calculate_bucket_id((1, "a"), "keyed")
    assert murmur3(b"") == 0


def test_changes(spark):
    e = Engine(spark)
    run = lambda text, params=(): e.execute(text, params).row_count
    run("CREATE TABLE t (id int NOT NULL, a string, b double, u uuid, PRIMARY KEY (id))")
    assert run("INSERT INTO t (id, a) VALUES (1, 'x'), (2, 'y')") == 2
    with pytest.raises(QueryError, match="duplicate key"):
        run("INSERT INTO t (id) VALUES (2), (3)")
    with pytest.raises(QueryError, match="duplicate key"):
        run("INSERT INTO t (id) VALUES (3), (3)")
    assert run("INSERT INTO t (id, a) VALUES (2, 'z'), (3, 'n'), (3, 'm') ON CONFLICT DO NOTHING") == 1
    assert rows(e, "SELECT id, a FROM t ORDER BY id") == [(1, "x"), (2, "y"), (3, "n")]
    assert run("INSERT INTO t (id, a) VALUES (2, 'p'), (2, 'q') ON CONFLICT DO REPLACE") == 2
    assert rows(e, "SELECT a FROM t WHERE id = 2") == [("q",)]
    assert run("UPDATE t SET b = id * 1.5e0") == 3
    assert run("UPDATE t SET a = v.\"COLUMN_4\" FROM (VALUES (1, 'k'), (1, 'l')) AS v WHERE id = v.\"COLUMN_3\"") == 2
    assert rows(e, "SELECT id, a, b FROM t ORDER BY id") == [(1, "l", 1.5), (2, "q", 3.0), (3, "n", 4.5)]
    run("CREATE UNIQUE INDEX ua ON t (a)")
    with pytest.raises(QueryError, match="unique index"):
        run("INSERT INTO t (id, a) VALUES (9, 'q') ON CONFLICT DO REPLACE")
    for text, says in (("UPDATE t SET id = 1", "primary key"), ("UPDATE t SET a = 'x', a = 'y'", "twice"), ("UPDATE t SET a = count(*)", "can't stand"), ("INSERT INTO t (a) VALUES ('x')", "can't be null"), ("INSERT INTO t (id, \"bucket_id\") VALUES (1, 1)", "can't be given"), ("INSERT INTO t (id) VALUES (1, 2)", "columns"), ("UPDATE t SET nothing = 1", "not found")):
        with pytest.raises(QueryError, match=says):
            run(text)
    assert run("DELETE FROM t WHERE a = ?", ("q",)) == 1
    run("CREATE PROCEDURE p (int, string) AS $$INSERT INTO t (id, a) VALUES ($1, $2)$$")
    assert run("CALL p(7, ?)", ("called",)) == 1
    run("ALTER PROCEDURE p RENAME TO q")
    with pytest.raises(QueryError, match="no such procedure"):
        run("CALL p(8, 'x')")
    assert rows(e, "SELECT a FROM t WHERE id = 7") == [("called",)]
    assert run("DELETE FROM t") == 3
    assert rows(e, "SELECT * FROM t") == []
    run("DROP TABLE t")
    with pytest.raises(QueryError, match="no such table"):
        run("DROP TABLE t")
    assert run("DROP TABLE IF EXISTS t") == 0


def test_administration(e):
    for text in ("CREATE USER u WITH PASSWORD 'x'", "GRANT READ ON TABLE t TO u", "DROP ROLE r", "CREATE PLUGIN p 0.1", "ALTER PLUGIN p 0.1 ENABLE"):
        with pytest.raises(NotSupported):
            e.execute(text)
    assert e.execute("SET SESSION x = 1").row_count == 0
    assert rows(e, "") == []
    assert "Physical Plan" in e.explain("SELECT id FROM testing_space WHERE id = 1")


def test_user_functions_and_arrays(e):
    e.register_function("flip", "reverse", "string")
    e.register_function("twice", lambda x: x + x, "string")
    assert rows(e, "SELECT flip(name) FROM testing_space WHERE id = 1") == [("321",)]
    assert rows(e, "SELECT twice(name) FROM testing_space WHERE id = 1") == [("123123",)]
    e.register("arrays", e.spark.createDataFrame([(1, [1, 2])], "id bigint, xs array<bigint>"))
    assert rows(e, "SELECT xs FROM arrays") == [([1, 2],)]
    with pytest.raises(QueryError, match="can't cast"):
        rows(e, "SELECT cast(xs as string) FROM arrays")


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS a", "cast(id as string) AS b").write.parquet(str(tmp_path / "t"))
    e = Engine(spark)
    e.read("t", str(tmp_path / "t"))
    plan = e.explain("SELECT s.a FROM (SELECT * FROM t) AS s WHERE s.id > 90")
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,90)]" in plan
    assert "ReadSchema: struct<id:bigint,a:bigint>" in plan


def test_parameters_of_changes_have_the_types_of_their_columns(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE p (id int NOT NULL, name string, amount double, PRIMARY KEY (id)) DISTRIBUTED BY (id)")
    assert e.parameter_types("INSERT INTO p VALUES ($1, $2, $3)") == ["integer", "string", "double"]
    assert e.parameter_types("INSERT INTO p (amount, id) VALUES ($2, ($1)), (1.5e0, $3)") == ["integer", "double", "integer"]
    assert e.parameter_types("UPDATE p SET name = $1, amount = $2 WHERE id = $3") == ["string", "double", "integer"]
    assert e.parameter_types("DELETE FROM p WHERE name = $1") == ["string"]


def test_state_after_changes_is_read_from_files(spark):
    e = Engine(spark)
    e.execute("CREATE TABLE p (id int NOT NULL, name string, PRIMARY KEY (id)) DISTRIBUTED BY (id)")
    for i in range(20):
        assert e.execute(f"INSERT INTO p VALUES ({i}, 'n{i}')").row_count == 1
    assert e.catalog.table("p").parts < 16
    assert e.execute("INSERT INTO p VALUES (3, 'x'), (20, 'y') ON CONFLICT DO NOTHING").row_count == 1
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,17)]" in e.explain("SELECT id FROM p WHERE id > 17")
    assert e.execute("UPDATE p SET name = 'u' WHERE id > 17").row_count == 3
    assert e.execute("DELETE FROM p WHERE id < 3").row_count == 3
    plan = e.explain("SELECT id FROM p WHERE id > 17")
    assert "GreaterThan(id,17)" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert sorted(e.execute("SELECT id, name FROM p WHERE id > 16").rows()) == [(17, "n17"), (18, "u"), (19, "u"), (20, "u")]
    for text in ("INSERT INTO p SELECT id + 100, name FROM p", "UPDATE p SET name = 'z' WHERE id = 5", "DELETE FROM p WHERE id = 5"):
        assert "Physical Plan" in e.explain(text)
    assert e.execute("SELECT count(*) FROM p").rows() == [(18,)]


def test_order_by_sees_through_scan_names(spark):
    e = Engine(spark)
    e.register("t", e.spark.createDataFrame([(1, "b"), (2, "A"), (3, "c")], "id bigint, name string"), primary_key=("id",))
    assert [r[0] for r in e.execute("SELECT a.name FROM t AS a ORDER BY (lower(a.name))").rows()] == ["A", "b", "c"]
    assert [r[0] for r in e.execute("SELECT a.id FROM t AS a ORDER BY CASE WHEN a.id > 1 THEN a.id * -1 ELSE 5 END").rows()] == [3, 2, 1]


def test_a_row_sub_query_is_planned_once(e):
    text = "SELECT na FROM null_o WHERE (nc, na) < (SELECT max(nc), max(na) FROM null_o)"
    assert sorted(rows(e, text)) == [(i,) for i in range(1, 9)]
    assert rows(e, "SELECT na FROM null_o WHERE (nc, na) = (SELECT nc, na FROM null_o WHERE na = 5)") == [(5,)]
    assert rows(e, "SELECT na FROM null_o WHERE (nc, na) >= (SELECT nc, na FROM null_o WHERE na = 100)") == []
    plan = e.sql(text)
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(set(re.findall(r"subquery#(\d+)", final))) == 1


def test_refresh_follows_a_path(spark, tmp_path):
    own = Engine(spark)
    path = str(tmp_path / "t")
    own.spark.range(3).selectExpr("id", "id * 2 AS x").write.parquet(path)
    own.read("t", path, primary_key=("id",))
    own.execute("CREATE UNIQUE INDEX i ON t (x)")
    assert rows(own, "SELECT count(*) FROM t") == [(3,)]
    own.spark.range(5).selectExpr("id", "id * 2 AS x", "'new' AS y").write.mode("overwrite").parquet(path)
    own.refresh("t")
    assert rows(own, "SELECT y FROM t WHERE id = 4") == [("new",)] and own.catalog.table("t").unique
    own.refresh()
    own.execute("DELETE FROM t WHERE id = 4")
    own.refresh()
    assert rows(own, "SELECT count(*) FROM t") == [(4,)]
    with pytest.raises(QueryError):
        own.refresh("t")
    with pytest.raises(QueryError):
        own.refresh("nowhere")
