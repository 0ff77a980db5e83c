"""Statements end to end, on the standard path and on the compatible one, over tables of a small harbour."""

from __future__ import annotations

import io

import pytest
from pyspark.errors import AnalysisException

from grainmill.plans.database import Database, SqlError
from grainmill.shell import complete, grid, run

SHIPS = [(11, "Alma", 3), (12, "Brisk", 7), (13, "Calypso", 7), (14, "Dory", 1), (15, "Ember", 12)]
CARGO = [(1, 12, 40), (2, 12, 5), (3, 14, 25), (4, 11, 60), (5, 99, 7), (6, 15, 0)]


@pytest.fixture(scope="module")
def db(spark):
    found = Database(spark, compat=True)
    for name in ("ships", "cargo", "codes", "marks"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert found.execute("CREATE TABLE ships (num INT, name VARCHAR(20), decks INT);").message == "Table 'ships' created."
    assert found.execute("CREATE TABLE cargo (lot INT, ship INT, tons INT)").message == "Table 'cargo' created."
    assert found.catalog.insert("ships", SHIPS) == 5
    values = ", ".join(map(str, CARGO))
    assert found.execute(f"INSERT INTO cargo VALUES {values};").message == "Inserted 6 rows."
    return found


def got(db, sql, compat=True):
    return [tuple(r) for r in db.execute(sql, compat).frame.collect()]


@pytest.mark.parametrize("compat", [True, False])
@pytest.mark.parametrize(
    ("condition", "keep"),
    [
        ("decks = 7", lambda s: s[2] == 7), ("decks != 7", lambda s: s[2] != 7), ("3 <= decks AND decks < 12", lambda s: 3 <= s[2] < 12),
        ("NOT decks > 3", lambda s: s[2] <= 3), ("name > 'Brisk' OR num = 11", lambda s: s[1] > "Brisk" or s[0] == 11),
        ("NOT (decks = 7 OR name = 'Dory') AND num <> 15", lambda s: not (s[2] == 7 or s[1] == "Dory") and s[0] != 15), ("num < decks", lambda s: s[0] < s[2]),
    ],
)
def test_conditions_equal_plain_ones(db, condition, keep, compat):
    assert sorted(got(db, f"SELECT num, name, decks FROM ships WHERE {condition}", compat)) == [s for s in SHIPS if keep(s)]


def test_orders(db):
    by = sorted(SHIPS, key=lambda s: (-s[2], s[1]))
    assert got(db, "SELECT name FROM ships ORDER BY decks DESC, name ASC") == [(s[1],) for s in by]
    assert got(db, "SELECT name AS called FROM ships ORDER BY called DESC") == [(s[1],) for s in reversed(SHIPS)]
    assert sorted(got(db, "SELECT num FROM ships ORDER BY 2")) == [(s[0],) for s in SHIPS]  # a constant
    assert db.execute("SELECT * FROM cargo").columns == ["cargo.lot", "cargo.ship", "cargo.tons"]


def test_groups(db):
    tons: dict = {}
    for _, ship, t in CARGO:
        tons.setdefault(ship, []).append(t)
    sql = "SELECT ship, COUNT(*), SUM(tons), AVG(tons), MIN(tons), MAX(tons) FROM cargo GROUP BY ship ORDER BY ship"
    assert got(db, sql) == [(k, len(v), sum(v), sum(v) // len(v), min(v), max(v)) for k, v in sorted(tons.items())]
    assert db.execute(sql).columns == ["ship", "COUNT", "SUM", "AVG", "MIN", "MAX"]
    assert got(db, "SELECT COUNT(tons) AS n, AVG(tons) AS mean FROM cargo") == [(6, 137 // 6)]
    assert got(db, "SELECT decks FROM ships GROUP BY decks ORDER BY decks DESC") == [(12,), (7,), (3,), (1,)]
    assert got(db, "SELECT SUM(tons) AS s, ship FROM cargo GROUP BY ship ORDER BY s DESC")[0] == (60, 11)
    nothing = "SELECT COUNT(*), MAX(tons) FROM cargo WHERE tons > 1000"
    assert got(db, nothing) == [] and got(db, nothing, compat=False) == [(0, None)]


def test_joins(db):
    pairs = sorted((s[1], c[2]) for s in SHIPS for c in CARGO if s[0] == c[1])
    for compat in (True, False):
        assert sorted(got(db, "SELECT s.name, c.tons FROM ships s JOIN cargo c ON s.num = c.ship", compat)) == pairs
    assert sorted(got(db, "SELECT s.name, c.tons FROM ships AS s JOIN cargo c ON c.ship = s.num")) == pairs
    assert len(got(db, "SELECT s.num, c.lot FROM ships s JOIN cargo c ON 2 = 2")) == len(SHIPS) * len(CARGO)
    assert len(got(db, "SELECT s.num FROM ships s JOIN cargo c ON s.num = 14")) == len(CARGO)
    twins = [(a[0], b[0]) for a in SHIPS for b in SHIPS if a[2] == b[2]]
    assert sorted(got(db, "SELECT a.num, b.num FROM ships a JOIN ships b ON a.decks = b.decks")) == sorted(twins)
    heavy = got(db, "SELECT s.name, SUM(c.tons) AS t FROM ships s JOIN cargo c ON s.num = c.ship WHERE c.tons > 0 GROUP BY s.name ORDER BY t DESC")
    assert heavy == [("Alma", 60), ("Brisk", 45), ("Dory", 25)]


def test_keys_of_two_types_meet_by_digits(db):
    db.execute("CREATE TABLE codes (c VARCHAR(5))")
    db.execute("INSERT INTO codes VALUES ('12'), ('012'), (''), ('x')")
    assert got(db, "SELECT s.name, c.c FROM ships s JOIN codes c ON s.num = c.c") == [("Brisk", "12")]


def test_texts_are_cut_at_whole_characters(db):
    db.execute("CREATE TABLE marks (m VARCHAR(3))")
    db.execute("INSERT INTO marks VALUES ('øre'), ('aøø'), ('漢字'), ('😀'), ('abcd'), ('ok')")
    assert sorted(got(db, "SELECT m FROM marks")) == sorted([("ør",), ("aø",), ("漢",), ("",), ("abc",), ("ok",)])


def test_sums_wrap_in_compatible_results_only(db, spark):
    spark.createDataFrame([(2**31 - 5,), (9,)], "v int").createOrReplaceTempView("big_tons")
    assert got(db, "SELECT SUM(v) FROM big_tons") == [(4 - 2**31,)]
    assert got(db, "SELECT SUM(v) FROM big_tons", compat=False) == [(2**31 + 4,)]


@pytest.mark.parametrize(
    ("sql", "error"),
    [
        ("CREATE TABLE ships (num INT)", ValueError), ("CREATE TABLE z (a INT, b INT, a INT)", ValueError), ("CREATE TABLE z (a VARCHAR(70000))", ValueError),
        ("SELECT * FROM piers", AnalysisException), ("SELECT sails FROM ships", ValueError), ("SELECT num FROM ships a JOIN ships b ON a.num = b.num", ValueError),
        ("INSERT INTO ships VALUES (1, 'Fay')", ValueError), ("INSERT INTO ships VALUES (1, 2, 3)", TypeError), ("INSERT INTO cargo VALUES (1, 1, 2147483648)", ValueError),
        ("SELECT name, MAX(decks) FROM ships", SqlError), ("SELECT AVG(*) FROM ships", ValueError), ("SELECT num FROM ships HAVING num", SqlError), ("SELECT num FROM ships WHERE name", SqlError),
        ("SELECT num FROM ships WHERE decks > -3", SqlError), ("DELETE FROM ships", SqlError), ("SELECT s.num FROM ships s JOIN ships s ON s.num = s.num", ValueError),
        ("SELECT s.num FROM ships s JOIN cargo c ON s.num < c.ship", SqlError), ("SELECT num FROM ships; SELECT num FROM ships", SqlError),
    ],
)
def test_errors(db, sql, error):
    with pytest.raises(error):
        db.execute(sql, compat=True).frame.collect()


def test_explain(db):
    lines = [r[0] for r in got(db, "EXPLAIN SELECT c.tons FROM ships s JOIN cargo c ON s.num = c.ship WHERE s.decks = 7")]
    assert lines[:5] == ["Projection [c.tons]", "  Filter [s.decks = 7]", "    HashJoin [s.num = c.ship]", "      SeqScan cargo AS c", "      SeqScan ships AS s"]
    assert any("Scan" in line for line in lines[5:])
    assert any("Filter" in r[0] for r in got(db, "EXPLAIN SELECT num FROM ships WHERE decks > 4", compat=False))


def test_statements_are_planned_twice_alike(db):
    from grainmill.plans import compat
    from grainmill.plans.grammar import parse

    made = parse("SELECT name AS x FROM ships ORDER BY x")
    before = repr(made)
    assert compat.planned(db.catalog, made).collect() == compat.planned(db.catalog, made).collect() and repr(made) == before


def test_shell(db, spark):
    out = io.StringIO()
    typed = "SELECT name, decks\nFROM ships -- which;\nWHERE decks = 12;\nSELECT num FROM piers;\nSELECT num FROM ships WHERE name = 'no--thing; here';\n.exit\nSELECT 1;\n"
    run(db, io.StringIO(typed), out)
    said = out.getvalue()
    assert "| name  | decks |" in said and "| Ember | 12    |" in said and "(1 row)" in said and "Error:" in said and "(0 rows)" in said
    assert complete("SELECT 'a;' ; -- x") and not complete("SELECT 'a;") and not complete("SELECT 1 -- ;")
    spark.range(2500).createOrReplaceTempView("many_rows")
    lines = list(grid(db.execute("SELECT id FROM many_rows", compat=False)))
    assert len(lines) == 2500 + 5 and lines[-1] == "(2500 rows)"  # all rows are printed
