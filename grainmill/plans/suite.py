"""The registered queries: every operator over whole driver tables, each with its oracle."""

from __future__ import annotations

import io
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import semantics
from grainmill.operators import index
from grainmill.operators import relational as rel
from grainmill.plans import compat
from grainmill.plans.database import Database
from grainmill.plans.grammar import parse
from grainmill.plans.registry import register
from grainmill.session import shared_folder
from grainmill.shell import grid, run


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Folder:
    """The driver's tables as a catalog."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return _read(self.spark, self.sf_dir, name)


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register a statement of the small grammar with its compatible results."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compat.planned(_Folder(spark, sf_dir), parse(text))

    query.__doc__ = text
    register(name, text if oracle is None else oracle)(query)


@register(
    "flagship",
    """SELECT c.c_mktsegment AS segment, o.o_orderpriority AS priority, count(*) AS n_orders,
    cast(sum(cast(round(o.o_totalprice * 100) AS bigint)) AS bigint) AS cents
    FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
    WHERE o.o_orderstatus <> 'P' GROUP BY 1, 2""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and revenue in cents by market segment and order priority."""
    orders = _read(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P")
    return (
        orders.join(_read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"))
        .agg(F.count("*").alias("n_orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
        .orderBy("segment", "priority")
    )


# scans, projections and names

@register("scan_star", "SELECT * FROM nation")
def scan_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns and rows."""
    return _read(spark, sf_dir, "nation").select("*")


@register("scan_lineitem", "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def scan_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that reads three columns only."""
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")


@register("parallel_scan", "SELECT o_orderkey, o_custkey FROM orders")
def parallel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan by the files' splits, a task each: nothing is shuffled."""
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")


@register("scan_early_stop", "SELECT count(*) AS n FROM (SELECT * FROM customer LIMIT 5)")
def scan_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that stops after five rows."""
    return _read(spark, sf_dir, "customer").limit(5).agg(F.count("*").alias("n"))


@register("scan_splits", "SELECT count(*) AS n, cast(sum(l_linenumber) AS bigint) AS s FROM lineitem")
def scan_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows counted split by split, then together."""
    each = _read(spark, sf_dir, "lineitem").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))
    return each.agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


_sql("project_alias_literal", "SELECT p_name AS nm, p_size, 1 AS one, 'x' AS tag FROM part")
_sql("output_naming", "SELECT n.n_name, 7 FROM nation n", """SELECT n_name, 7 AS "?" FROM nation""")
_sql("table_alias", "SELECT a.s_suppkey, a.s_nationkey FROM supplier AS a WHERE a.s_nationkey = 3")

# predicates

_sql("filter_eq", "SELECT p_partkey FROM part WHERE p_size = 7")
_sql("filter_ne", "SELECT p_partkey FROM part WHERE p_size <> 7")
_sql("filter_lt", "SELECT p_partkey FROM part WHERE p_size < 7")
_sql("filter_gt", "SELECT p_partkey FROM part WHERE p_size > 40")
_sql("filter_le", "SELECT p_partkey FROM part WHERE p_size <= 7")
_sql("filter_ge", "SELECT p_partkey FROM part WHERE p_size >= 40")
_sql("filter_compare_all", "SELECT p_partkey, p_size FROM part WHERE p_size >= 5 AND p_size <= 45 AND p_size <> 10 AND p_size != 11 AND p_size > 6 AND p_size < 44")
_sql("filter_and", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
_sql("filter_or", "SELECT c_custkey FROM customer WHERE c_nationkey = 1 OR c_nationkey = 24")
_sql("filter_not", "SELECT n_name FROM nation WHERE NOT n_regionkey = 2")
_sql("filter_or_not_paren", "SELECT p_partkey, p_brand FROM part WHERE NOT (p_size = 10 OR p_size > 30) AND NOT p_brand = 'Brand#11'")
_sql("filter_precedence", "SELECT p_partkey FROM part WHERE p_size = 1 OR p_size = 2 AND p_brand <> 'Brand#11' OR NOT p_size < 45")
_sql("filter_string_order", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment < 'FURNITURE'")
_sql("filter_column_pair", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag < l_linestatus")
_sql("comment_semicolon", "SELECT r_name FROM region -- all of them\nWHERE r_regionkey >= 1;")

# joins

_sql("join_inner", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
_sql("join_swapped_on", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey")
_sql(
    "join_chain_3",
    "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_nationkey < 9",
)
_sql("join_self", "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
_sql("join_cross_literal", "SELECT r.r_name, n.n_name FROM region r JOIN nation n ON 1 = 1")
_sql("join_restricted_literal", "SELECT r.r_name, n.n_name FROM region r JOIN nation n ON r.r_regionkey = 3")
_sql("join_many_to_many", "SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey")


@register("join_text_key", "SELECT a.n_nationkey, b.n_name FROM nation a JOIN nation b ON cast(a.n_nationkey AS varchar) = substr(b.n_name, 8)")
def join_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer key meets a text key by its digits."""
    left = _read(spark, sf_dir, "nation").select("n_nationkey")
    right = _read(spark, sf_dir, "nation").select("n_name", F.substr("n_name", F.lit(8)).alias("digits"))
    return rel.join_on(left, right, "n_nationkey", "digits").select("n_nationkey", "n_name")


def _parallel_join(spark: SparkSession, sf_dir: str, hint: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return rel.join_on(orders, customer, "o_custkey", "c_custkey", hint).select("o_orderkey", "c_mktsegment")


_JOINED = "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"


@register("parallel_join", _JOINED)
def parallel_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash join over shuffled partitions."""
    return _parallel_join(spark, sf_dir, "shuffle_hash")


@register("parallel_join_merge", _JOINED)
def parallel_join_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by sorting both sides."""
    return _parallel_join(spark, sf_dir, "merge")


@register("multimap_lookup", "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS orders FROM orders GROUP BY o_custkey")
def multimap_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of each key."""
    return rel.multimap(_read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", F.concat_ws(",", F.col("values").cast("array<string>")).alias("orders"))


# aggregates

_INT_SUM = "cast(((((sum({x}) + 2147483648) % 4294967296) + 4294967296) % 4294967296) - 2147483648 AS int)"
_sql(
    "agg_global_all",
    "SELECT COUNT(*) AS n, COUNT(p_size) AS nc, SUM(p_size) AS s, AVG(p_size) AS a, MIN(p_size) AS lo, MAX(p_size) AS hi FROM part",
    "SELECT count(*) AS n, count(p_size) AS nc, cast(sum(p_size) AS int) AS s, cast(sum(p_size) // count(p_size) AS int) AS a, min(p_size) AS lo, max(p_size) AS hi FROM part",
)
_sql("agg_count_star", "SELECT COUNT(*) AS n FROM lineitem")
_sql("count_expr", "SELECT COUNT(l_returnflag) AS n FROM lineitem")
_sql("agg_min_max", "SELECT l_returnflag, MIN(l_linenumber) AS lo, MAX(l_linenumber) AS hi FROM lineitem GROUP BY l_returnflag")
_sql("agg_min_max_text", "SELECT MIN(c_mktsegment) AS lo, MAX(c_mktsegment) AS hi FROM customer")
_sql("agg_sum_group", "SELECT p_brand, SUM(p_size) AS total FROM part GROUP BY p_brand", "SELECT p_brand, cast(sum(p_size) AS int) AS total FROM part GROUP BY p_brand")
_sql("agg_avg_group", "SELECT p_brand, AVG(p_size) AS mean FROM part GROUP BY p_brand", "SELECT p_brand, cast(sum(p_size) // count(*) AS int) AS mean FROM part GROUP BY p_brand")
_sql("agg_group_multi", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
_sql("group_no_agg", "SELECT p_brand FROM part GROUP BY p_brand")
_sql("agg_layout", "SELECT COUNT(*) AS n, p_brand AS brand FROM part GROUP BY p_brand")
_sql("agg_naming", "SELECT c_nationkey, COUNT(*), MAX(c_custkey) FROM customer GROUP BY c_nationkey", 'SELECT c_nationkey, count(*) AS "COUNT", max(c_custkey) AS "MAX" FROM customer GROUP BY c_nationkey')
_sql("agg_global_empty", "SELECT COUNT(*) AS n, MAX(p_size) AS hi FROM part WHERE p_size < 0", "SELECT count(*) AS n, max(p_size) AS hi FROM part WHERE p_size < 0 HAVING count(*) > 0")
_sql("agg_join_group", "SELECT r.r_name, COUNT(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name ORDER BY n DESC")


@register("agg_sum_wrap", "SELECT " + _INT_SUM.format(x="cast(o_orderkey * 100000 % 2147483647 AS int)") + " AS s FROM orders")
def agg_sum_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum beyond 32 bits wraps."""
    return _read(spark, sf_dir, "orders").agg(semantics.wrapping_sum((F.col("o_orderkey") * 100000 % 2147483647).cast("int")).alias("s"))


@register("int_avg_negative", "SELECT p_brand, cast(sum(p_size - 40) // count(*) AS int) AS mean FROM part GROUP BY p_brand")
def int_avg_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages of negative numbers are truncated toward zero."""
    return _read(spark, sf_dir, "part").groupBy("p_brand").agg(semantics.int_avg(F.col("p_size") - 40).alias("mean"))


@register("agg_cents", "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum(cast(round(l_extendedprice * 100) AS bigint)) AS bigint) AS cents FROM lineitem GROUP BY ALL")
def agg_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of lineitem by flag and status."""
    return _read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))


# sorts; the place of each row is a column, as comparisons ignore order

_SIZE_ORDER = [("p_size", False), ("p_partkey", True)]


@register("sort_rank_probe", "SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rn FROM part")
def sort_rank_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of rows, counted after the sort by two keys."""
    return rel.placed(_read(spark, sf_dir, "part").select("p_partkey", "p_size"), _SIZE_ORDER, "rn")


@register("sort_places", "SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_quantity, l_orderkey, l_linenumber) AS place FROM lineitem")
def sort_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of rows, counted after the sort over ranges."""
    df = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rel.placed(df, [("l_quantity", True), ("l_orderkey", True), ("l_linenumber", True)])


def _sql_places(name: str, text: str, oracle: str) -> None:
    """Register an ordered statement; its rows as text with their places, as they come."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _database(spark, sf_dir).execute(text)
        return _lines(spark, [" | ".join(row) for row in found.rows()])

    query.__doc__ = text
    register(name, oracle)(query)


def _database(spark: SparkSession, sf_dir: str | None = None) -> Database:
    """A database with the compatible results, over the driver's tables if a folder is given."""
    found = Database(spark, compat=True)
    if sf_dir is not None:
        found.catalog = _Folder(spark, sf_dir)
    return found


def _lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lines)), "line int, said string")


_sql_places(
    "sort_hidden_places", "SELECT s.s_name FROM supplier s WHERE s.s_nationkey < 6 ORDER BY s.s_nationkey DESC, s.s_suppkey",
    "SELECT cast(row_number() OVER (ORDER BY s_nationkey DESC, s_suppkey) - 1 AS int) AS line, s_name AS said FROM supplier WHERE s_nationkey < 6",
)
_sql_places(
    "sort_aggregate_places", "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand",
    "SELECT cast(row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS int) AS line, p_brand || ' | ' || count(*) AS said FROM part GROUP BY p_brand",
)
_sql("sort_hidden_column", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC")
_sql("sort_after_aggregate", "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand")
_sql("sort_constant", "SELECT r_name FROM region ORDER BY 1", "SELECT r_name FROM region")


@register("parallel_sort", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity, l_orderkey, l_linenumber")
def parallel_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global sort: ranges dealt by sampled bounds, each sorted in its task."""
    df = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rel.order_by(df, [("l_quantity", True), ("l_orderkey", True), ("l_linenumber", True)])


# access by key

@register("index_point", "SELECT p_partkey, p_name FROM part WHERE p_partkey = 42 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey = -1")
def index_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit and a miss."""
    found = index.KeyIndex(spark, f"{sf_dir}/part.parquet", "p_partkey")
    return found.lookup(42).select("p_partkey", "p_name").union(found.lookup(-1).select("p_partkey", "p_name"))


@register("index_range", "SELECT p_partkey, p_name FROM part WHERE p_partkey BETWEEN 10 AND 120 ORDER BY p_partkey")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range, both ends included."""
    return index.KeyIndex(spark, f"{sf_dir}/part.parquet", "p_partkey").range(10, 120).select("p_partkey", "p_name")


@register("index_upsert", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each key."""
    return index.latest(_read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("seq")), "o_custkey", "seq").select("o_custkey", "o_orderkey")


# sinks and text

@register("varchar_truncate", "SELECT c_custkey, left(c_name, 12) AS c_name FROM customer")
def varchar_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cut to twelve bytes."""
    return _read(spark, sf_dir, "customer").select("c_custkey", semantics.fit_bytes(F.col("c_name"), 12).alias("c_name"))


def _fresh(name: str) -> str:
    """A table name that no other run has: managed tables leave folders behind."""
    return f"{name}_{uuid.uuid4().hex}"


@register("insert_rows", "SELECT 12 AS berth, 'Quay' AS kind UNION ALL SELECT 40, 'Møre' UNION ALL SELECT 7, 'Pier'")
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table declared, two inserts (texts cut to five bytes), and its rows."""
    db, name = _database(spark), _fresh("berths")
    db.execute(f"CREATE TABLE {name} (berth INT, kind VARCHAR(5))")
    db.execute(f"INSERT INTO {name} VALUES (12, 'Quay'), (40, 'Møreø')")
    db.execute(f"INSERT INTO {name} VALUES (7, 'Pier')")
    return db.execute(f"SELECT t.berth, t.kind FROM {name} t").frame


@register("append_rows", "SELECT cast(s_suppkey AS int) AS k, substr(s_name, 1, 4) AS label FROM supplier")
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A DataFrame appended to a declared table, in two parts."""
    db, name = _database(spark), _fresh("labels")
    db.execute(f"CREATE TABLE {name} (k INT, label VARCHAR(4))")
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("k"), F.col("s_name").alias("label"))
    for part in (F.col("k") % 2 == 0, F.col("k") % 2 != 0):
        db.catalog.append(name, rows.where(part))
    return db.execute(f"SELECT g.k, g.label FROM {name} g").frame


@register(
    "statement_messages",
    """SELECT * FROM (VALUES (0, 'Table ''docks'' created.'), (1, 'Inserted 1 row.'), (2, 'Inserted 2 rows.'), (3, '3 | East'), (4, '9 | West')) AS t(line, said)""",
)
def statement_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statements say, and the rows that they leave."""
    db, name = _database(spark), _fresh("docks")
    said = [db.execute(sql).message.replace(name, "docks") for sql in (
        f"CREATE TABLE {name} (dock INT, side VARCHAR(8));", f"INSERT INTO {name} VALUES (9, 'West')", f"insert into {name} values (3, 'East'), (1, '')",
    )]
    found = db.execute(f"SELECT dock, side FROM {name} WHERE side > '' -- named ones\nORDER BY dock;")
    return _lines(spark, said + [" | ".join(row) for row in found.rows()])


@register("result_text", "SELECT cast(n_nationkey AS varchar) AS n_nationkey, n_name, cast(n_regionkey AS varchar) AS n_regionkey FROM nation")
def result_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a result as text, as they are printed."""
    found = _database(spark, sf_dir).execute("SELECT n.n_nationkey, n.n_name, n.n_regionkey FROM nation n")
    return spark.createDataFrame(list(found.rows()), ", ".join(f"{c} string" for c in found.columns))


@register(
    "result_grid",
    """WITH w AS (SELECT greatest(8, max(length(r_name))) AS n FROM region), b AS (SELECT '+-----+' || repeat('-', cast(n + 2 AS int)) || '+' AS rule, n FROM w),
    r AS (SELECT '| ' || rpad(cast(r_regionkey AS varchar), 3, ' ') || ' | ' || rpad(r_name, cast(n AS int), ' ') || ' |' AS t, row_number() OVER (ORDER BY r_regionkey) + 2 AS i FROM region, b)
    SELECT cast(i AS int) AS line, t AS said FROM (SELECT 0 AS i, rule AS t FROM b UNION ALL SELECT 1, '| key | ' || rpad('the_name', cast(n AS int), ' ') || ' |' FROM b UNION ALL SELECT 2, rule FROM b
    UNION ALL SELECT i, t FROM r UNION ALL SELECT (SELECT count(*) + 3 FROM region), rule FROM b UNION ALL SELECT (SELECT count(*) + 4 FROM region), (SELECT '(' || count(*) || ' rows)' FROM region))""",
)
def result_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shell's grid of a result."""
    found = _database(spark, sf_dir).execute("SELECT r.r_regionkey AS key, r.r_name AS the_name FROM region r ORDER BY r.r_regionkey")
    return _lines(spark, list(grid(found)))


@register(
    "shell_session",
    """SELECT * FROM (VALUES (0, '+---+'), (1, '| n |'), (2, '+---+'), (3, '| 3 |'), (4, '+---+'), (5, '(1 row)'), (6, 'Error: UNRESOLVED_COLUMN: nothing'),
    (7, '(0 rows)')) AS t(line, said)""",
)
def shell_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session at the shell: a statement over two lines with a text that looks like a comment, an error, no rows, the end."""
    out = io.StringIO()
    typed = "SELECT r_regionkey AS n FROM region -- all;\nWHERE r_regionkey = 3 AND r_name <> 'a--b;';\nSELECT nothing FROM region;\nSELECT r_name FROM region WHERE r_regionkey > 99;\n.quit\nSELECT 1;\n"
    run(_database(spark, sf_dir), io.StringIO(typed), out)
    lines = [re.sub(r"^(grain> |   \.\.\.> )+", "", line) for line in out.getvalue().split("\n")]
    return _lines(spark, [line for line in lines if line and not re.fullmatch(r"[0-9.]+ s", line)])


@register("index_built", "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey BETWEEN 30 AND 90 OR p_partkey = 7")
def index_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built from keys in descending order, each written twice: the later write is found."""
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").withColumn("seq", F.lit(2)).orderBy(F.desc("p_partkey"))
    earlier = part.withColumn("p_name", F.lit("overwritten")).withColumn("seq", F.lit(1))
    folder = f"{shared_folder(spark)}/grainmill/index-{uuid.uuid4().hex}"
    found = index.KeyIndex.build(earlier.union(part), "p_partkey", folder, seq="seq")
    return found.range(30, 90).union(found.lookup(7)).union(found.lookup(-5)).drop("seq")


@register(
    "explain_select",
    """SELECT * FROM (VALUES (0, 'Projection [p_name]'), (1, '  Sort [p_name DESC]'), (2, '    Filter [p_size > 25 AND NOT (p_brand = ''Brand#11'')]'),
    (3, '      SeqScan part AS part')) AS t(line, plan)""",
)
def explain_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operators of a query, one row each."""
    found = _database(spark, sf_dir).execute("EXPLAIN SELECT p_name FROM part WHERE p_size > 25 AND NOT p_brand = 'Brand#11' ORDER BY p_name DESC")
    lines = [row[0] for row in found.rows()]
    return spark.createDataFrame(list(enumerate(lines[: lines.index("")])), "line int, plan string")
