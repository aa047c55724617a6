"""The registered queries and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyjoin import storage
from tallyjoin.functions import bounds
from tallyjoin.operators import aggregates, columns, expand, joins, packing, padding, partitioning, scan
from tallyjoin.sources import tables
from tallyjoin.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus")
#: A total order of lineitem: order and line number are not a key.
LINES = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def query(sql: str) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def orders(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*ORDERS, *more)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINES)


# Sources


@query("SELECT r_regionkey, r_name FROM region")
def scan_table(spark, d):
    return tables.scan_table(spark, f"{d}/region.parquet").select("r_regionkey", "r_name")


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_custkey * 7 - 3 AS x FROM customer")
def scan_text(spark, d):
    """A table written as text under header lines, in several files, and read back."""
    made = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey"), (F.col("c_custkey") * 7 - 3).alias("x"))
    path = storage.new_path(spark, "text")
    tables.write_text(made.repartition(3), path)
    return tables.scan_text(spark, path, made.schema, strict=True)


@query("SELECT i AS c0, i + 1 AS c1, i + 2 AS c2 FROM range(1000) t(i)")
def generate_data(spark, d):
    return tables.generate_data(spark, 3, 1000)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10")
def print_limit(spark, d):
    return columns.print_limit(orders(spark, d), 10, "o_orderkey")


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, d):
    return aggregates.row_count(table(spark, d, "lineitem"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def copy_table(spark, d):
    return columns.copy_table(orders(spark, d), "o")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 = 3")
def sample(spark, d):
    return columns.sample_modulus(orders(spark, d), "o_orderkey", 10, 3)


# Columns


@query("SELECT c_nationkey, c_custkey, c_nationkey AS c_nationkey_2 FROM customer")
def project(spark, d):
    return columns.project(table(spark, d, "customer"), ["c_nationkey", "c_custkey", "c_nationkey"])


@query("SELECT c_nationkey, c_custkey, c_name FROM customer")
def join_cols_first(spark, d):
    return columns.join_cols_first(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_nationkey"])


@query("SELECT c_custkey, c_name, 7 AS v FROM customer")
def append_col(spark, d):
    return columns.append_col(table(spark, d, "customer").select("c_custkey", "c_name"), "v", 7)


@query("SELECT c_custkey, 7 AS v, c_name FROM customer")
def insert_col(spark, d):
    return columns.insert_col(table(spark, d, "customer").select("c_custkey", "c_name"), "v", 7, 1)


@query("SELECT c_custkey, c_nationkey, c_custkey AS again FROM customer")
def copy_col(spark, d):
    return columns.copy_col(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "again")


@query("SELECT c_custkey, c_name FROM customer")
def delete_col(spark, d):
    return columns.delete_col(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 4 AS BIGINT) AS part FROM orders")
def assign_round_robin(spark, d):
    return partitioning.assign_round_robin(orders(spark, d), ["o_orderkey"], 4)


# Rows that go


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def remove_dummy(spark, d):
    o = orders(spark, d).withColumn("part", F.col("o_orderkey") % 4)
    return padding.remove_dummy(padding.pad_to_size(o, "part", 10_000)).drop("part")


@query("SELECT o_orderkey, o_custkey, CAST(o_orderkey % 3 = 0 AS INTEGER) AS mark FROM orders WHERE o_orderkey % 3 = 0")
def compact(spark, d):
    return columns.compact(orders(spark, d).select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3 == 0).cast("int").alias("mark")), "mark")


@query("SELECT o_orderkey, CAST(unnest(range(1, o_orderkey % 4 + 1)) AS BIGINT) AS copy FROM orders WHERE o_orderkey % 4 > 0")
def expand_zero_drop(spark, d):
    return expand.expansion(orders(spark, d).select("o_orderkey", (F.col("o_orderkey") % 4).alias("d")), "d")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1")
def dedup_last_of_run(spark, d):
    keys = ("l_linenumber", "l_partkey", "l_suppkey")
    return aggregates.dedup_last_of_run(table(spark, d, "lineitem").select("l_orderkey", *keys), ["l_orderkey"], keys)


@query("SELECT count(*) = count(DISTINCT o_orderkey) AS is_unique FROM orders")
def is_key_unique(spark, d):
    return aggregates.is_key_unique(table(spark, d, "orders"), ["o_orderkey"])


# Joins


@query("SELECT c_custkey, o_orderkey, o_orderstatus, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def pk_join(spark, d):
    o = orders(spark, d).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return joins.pk_join(o, table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"])


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, n FROM lineitem JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) USING (l_partkey, l_suppkey)")
def pk_join_multi_key(spark, d):
    keys = ["l_partkey", "l_suppkey"]
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *keys)
    return joins.pk_join(line, line.groupBy(*keys).agg(F.count("*").alias("n")), keys)


@query("SELECT a.o_custkey, a.o_orderkey AS a_orderkey, b.o_orderkey AS b_orderkey FROM orders a JOIN orders b USING (o_custkey)")
def inner_join_m2m(spark, d):
    o = table(spark, d, "orders")
    return joins.inner_join(o.select("o_custkey", F.col("o_orderkey").alias("a_orderkey")), o.select("o_custkey", F.col("o_orderkey").alias("b_orderkey")), ["o_custkey"])


@query(
    "SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(a.event_id) AS BIGINT) AS r_sum, CAST(sum(b.event_id) AS BIGINT) AS s_sum FROM (SELECT user_id, event_id FROM events) a JOIN (SELECT user_id, event_id FROM events) b USING (user_id) GROUP BY user_id"
)
def inner_join_m2m_events(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return joins.join_by_sums(e, e, ["user_id"], "event_id", "event_id")


@query(
    "WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem) SELECT a.src, b.dst, count(*) AS paths FROM e a JOIN e b ON a.dst = b.src GROUP BY a.src, b.dst"
)
def two_hop_paths(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return joins.two_hop(e, "src", "dst", distinct=True)


@query(
    "SELECT c_custkey, c_nationkey, deg_r, deg_s FROM (SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_custkey) AS deg_r FROM customer) JOIN (SELECT o_custkey, count(*) AS deg_s FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"
)
def join_degrees(spark, d):
    return joins.join_degrees(table(spark, d, "customer").select("c_custkey", "c_nationkey"), orders(spark, d).select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT CAST(sum(n * n) AS BIGINT) AS join_size FROM (SELECT count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)")
def join_size(spark, d):
    return joins.join_size(orders(spark, d), orders(spark, d), ["o_custkey"])


@query("SELECT max(n) AS a1, max(n) AS a2, CAST(sum(n * n) AS BIGINT) AS join_size FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def join_max_degree(spark, d):
    return joins.join_max_degree(orders(spark, d), orders(spark, d), ["o_custkey"])


_BLOCKS = """WITH r AS (SELECT c_custkey, c_nationkey FROM customer), s AS (SELECT s_suppkey, s_nationkey AS c_nationkey FROM supplier),
    j AS (SELECT c_nationkey, c_custkey, s_suppkey, row_number() OVER (ORDER BY c_nationkey, c_custkey, s_suppkey) - 1 AS place, count(*) OVER () AS m FROM r JOIN s USING (c_nationkey))
    SELECT c_nationkey, c_custkey, s_suppkey, m, CAST(place // b AS BIGINT) AS block, CAST(place % b AS BIGINT) AS "offset" FROM (SELECT *, greatest(CAST(ceil(m / 8.0) AS BIGINT), 1) AS b FROM j)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"))


@query(_BLOCKS)
def join_blocks(spark, d):
    """Customers with the suppliers of their nation: few keys, each with many rows on both sides."""
    return joins.join_blocks(*_sides(spark, d), ["c_nationkey"], ["c_custkey"], ["s_suppkey"], 8)


@query(_BLOCKS)
def positional_join(spark, d):
    return joins.positional_join(*_sides(spark, d), ["c_nationkey"], ["c_custkey"], ["s_suppkey"], 8)


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS deg FROM orders),
    x AS (SELECT o_custkey, o_orderkey, deg, CAST(unnest(range(1, deg + 1)) AS BIGINT) AS copy FROM o),
    n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, copy) AS i, row_number() OVER (ORDER BY o_custkey, o_orderkey, copy) AS g FROM x),
    j AS (SELECT *, min(g) OVER (PARTITION BY o_custkey) AS j FROM n),
    l AS (SELECT o_custkey, o_orderkey, copy, i, j, (i - 1) // deg + ((i - 1) % deg) * deg + j - 1 AS l FROM j)
    SELECT o_custkey, o_orderkey, copy, i, j, l, l // 1000 AS T, l % 1000 AS P FROM l"""
)
def join_alignment(spark, d):
    """The self-join of orders on the customer: every copy of an S row gets the place of its partner among R's copies.

    Numbers and first places are those of rows and keys before they are expanded, so the copies are neither sorted nor shuffled.
    Null customers are a key here, the last in order.
    """
    o = orders(spark, d).select("o_custkey", "o_orderkey")
    n = scan.row_number_by_key_split(o, ["o_custkey"], ["o_orderkey"], "r")
    keys = joins.degrees(o, ["o_custkey"], "deg").withColumn("none", F.col("o_custkey").isNull()).withColumn("rows", F.col("deg") * F.col("deg"))
    starts = scan.prefix_sum_global(keys, ["none", "o_custkey"], "rows", "upto").select(F.col("o_custkey").alias("key"), "deg", (F.col("upto") - F.col("rows") + 1).alias("j"))
    x = expand.with_numbers(n.join(starts, F.col("o_custkey").eqNullSafe(F.col("key"))), F.lit(1), F.col("deg"), "copy")
    aligned = joins.join_alignment(x.withColumn("i", (F.col("r") - 1) * F.col("deg") + F.col("copy")), "i", "j", "deg", "deg", 1000)
    return aligned.select("o_custkey", "o_orderkey", "copy", "i", "j", "l", "T", "P")


# Aggregates


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def sum_col(spark, d):
    return aggregates.sum_col(table(spark, d, "lineitem"), "l_linenumber")


@query("SELECT max(-o_orderkey) AS largest FROM orders")
def max_col(spark, d):
    return aggregates.max_col(orders(spark, d).select((-F.col("o_orderkey")).alias("x")), "x")


def _grouped(name: str, how: str, sql: str, source: str, keys: list[str], column: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return aggregates.group(table(spark, d, source), keys, how, column, how if how != "count" else "n")

    run.__name__ = name
    query(sql)(run)


_grouped("group_sum", "sum", "SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS sum FROM lineitem GROUP BY l_orderkey", "lineitem", ["l_orderkey"], "l_linenumber")
_grouped("group_count", "count", "SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL", "lineitem", ["l_partkey", "l_suppkey"], "l_linenumber")
_grouped("group_product", "product", "SELECT l_orderkey, product(l_linenumber) AS product FROM lineitem GROUP BY l_orderkey", "lineitem", ["l_orderkey"], "l_linenumber")
_grouped("group_max", "max", "SELECT o_custkey, max(o_orderkey) AS max FROM orders GROUP BY o_custkey", "orders", ["o_custkey"], "o_orderkey")
_grouped("group_min", "min", "SELECT o_custkey, min(o_orderkey) AS min FROM orders GROUP BY o_custkey", "orders", ["o_custkey"], "o_orderkey")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_keys(spark, d):
    return aggregates.distinct_keys(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def group_count_broadcast(spark, d):
    return aggregates.group_count_broadcast(orders(spark, d), ["o_custkey"], "n")


# Prefixes


def _prefix(name: str, how: str, sql: str, reverse: bool = False, split: bool = False) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        o = orders(spark, d).select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 5 + 1).alias("x"))
        return (scan.by_key_split if split else scan.by_key)(o, ["o_custkey"], ["o_orderkey"], how, "x", "y", reverse)

    run.__name__ = name
    query(f"SELECT o_custkey, o_orderkey, o_orderkey % 5 + 1 AS x, {sql} OVER (PARTITION BY o_custkey ORDER BY o_orderkey{' DESC' * reverse} ROWS UNBOUNDED PRECEDING){'::BIGINT' * (how == 'sum')} AS y FROM orders")(run)


_prefix("prefix_sum_by_key", "sum", "sum(o_orderkey % 5 + 1)")
_prefix("prefix_min_by_key", "min", "min(o_orderkey % 5 + 1)")
_prefix("prefix_max_by_key", "max", "max(o_orderkey % 5 + 1)")
_prefix("prefix_product_by_key", "product", "product(o_orderkey % 5 + 1)")
_prefix("suffix_max_by_key", "max", "max(o_orderkey % 5 + 1)", reverse=True)
_prefix("prefix_sum_by_key_split", "sum", "sum(o_orderkey % 5 + 1)", split=True)
_prefix("suffix_max_by_key_split", "max", "max(o_orderkey % 5 + 1)", reverse=True, split=True)


@query("SELECT o_orderkey, o_custkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM orders")
def prefix_sum_global(spark, d):
    return scan.prefix_sum_global(orders(spark, d).select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey", "running")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS row_number FROM orders")
def row_number_by_key(spark, d):
    return scan.row_number_by_key(orders(spark, d).select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_number FROM orders")
def row_number_by_key_split(spark, d):
    return scan.row_number_by_key_split(orders(spark, d).select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


def _fill(name: str, backward: bool, split: bool = False) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("x"))
        return (scan.fill_split if split else scan.fill)(e, ["user_id"], ["event_id"], "x", "filled", backward)

    run.__name__ = name
    made = "first_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)" if backward else "last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
    query(f"SELECT user_id, event_id, x, {made} AS filled FROM (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS x FROM events)")(run)


_fill("forward_fill", False)
_fill("backward_fill", True)
_fill("forward_fill_split", False, split=True)
_fill("backward_fill_split", True, split=True)


# Sorting and placing


@query("SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rank FROM orders")
def sort_multi(spark, d):
    return partitioning.rank_in_order(orders(spark, d).select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"])


@query("SELECT o_orderkey, o_custkey, CAST(o_orderkey % 4 AS INTEGER) AS part, CAST(row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_custkey, o_orderkey) AS INTEGER) AS place FROM orders")
def sort_within(spark, d):
    o = orders(spark, d).select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 4).cast("int").alias("part"))
    placed = partitioning.sort_within(partitioning.shuffle_by_col(o, 4, "part"), "part", "o_custkey", "o_orderkey")
    return partitioning.within_part(placed, "part", ["o_custkey", "o_orderkey"])


@query("SELECT CAST(bucket AS BIGINT) AS bucket, min(o_orderkey) AS o_orderkey FROM (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) AS bucket FROM orders) WHERE bucket > 1 GROUP BY bucket")
def quantile_pivots(spark, d):
    return partitioning.quantile_pivots(orders(spark, d).select("o_orderkey"), ["o_orderkey"], 7)


@query("SELECT o_orderkey, o_custkey, CAST((o_custkey >= 100) AS BIGINT) + CAST((o_custkey >= 500) AS BIGINT) + CAST((o_custkey >= 1000) AS BIGINT) AS part FROM orders")
def range_partition(spark, d):
    o = partitioning.range_partition(orders(spark, d).select("o_orderkey", "o_custkey"), 4, "o_custkey")
    return partitioning.by_pivots(o, "o_custkey", [100, 500, 1000])


@query("SELECT count(*) AS n, 4 AS parts, TRUE AS apart FROM orders")
def range_placement(spark, d):
    """Where the rows really are after range_partition(): no two partitions' ranges of keys overlap."""
    at = partitioning.placement(partitioning.range_partition(orders(spark, d), 4, "o_custkey"), "o_custkey")
    after = F.lead("low").over(Window.orderBy("low"))  # one row a partition
    return at.withColumn("next", after).agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("parts"), F.every(F.col("next").isNull() | (F.col("high") < F.col("next"))).alias("apart"))


@query("SELECT count(*) AS n, 8 AS parts, TRUE AS even FROM orders")
def random_placement(spark, d):
    """Where the rows really are after shuffle_random(): no partition has over 1.3 times its share."""
    at = partitioning.placement(partitioning.shuffle_random(orders(spark, d), 8), "o_orderkey")
    return at.agg(F.sum("n").alias("n"), F.count("*").cast("int").alias("parts"), (F.max("n") <= 1.3 * F.sum("n") / 8).alias("even"))


@query("SELECT count(DISTINCT o_custkey) AS keys, TRUE AS together FROM orders")
def key_placement(spark, d):
    """Where the rows really are after shuffle_by_key(): no key is in two partitions."""
    at = partitioning.shuffle_by_key(orders(spark, d), 8, "o_custkey").withColumn("part", F.spark_partition_id())
    per = at.groupBy("o_custkey").agg(F.min("part").alias("a"), F.max("part").alias("b"))
    return per.agg(F.count("*").alias("keys"), F.every(F.col("a") == F.col("b")).alias("together"))


_SAME = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"


@query(_SAME)
def shuffle_random(spark, d):
    return partitioning.shuffle_random(orders(spark, d), 8)


@query(_SAME)
def shuffle_by_key(spark, d):
    return partitioning.shuffle_by_key(orders(spark, d), 8, "o_custkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderkey % 8 AS INTEGER) AS part FROM orders")
def shuffle_by_col(spark, d):
    return partitioning.shuffle_by_col(orders(spark, d).withColumn("part", (F.col("o_orderkey") % 8).cast("int")), 8, "part")


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys, TRUE AS together FROM orders")
def key_hash_partition(spark, d):
    """Rows and keys are all there, and no key has two partitions."""
    o = partitioning.key_hash_partition(orders(spark, d), 8, ["o_custkey"])
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("part").alias("a"), F.max("part").alias("b"))
    return per.agg(F.sum("n").alias("n"), F.count("o_custkey").alias("keys"), F.every(F.col("a") == F.col("b")).alias("together"))


# Unions


@query("SELECT o_orderkey AS k, o_custkey AS v FROM orders UNION ALL SELECT c_custkey, c_nationkey FROM customer")
def union_all(spark, d):
    return columns.union_all(orders(spark, d).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v")), table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("v")))


@query("SELECT o_custkey AS k, o_orderkey, NULL AS c_nationkey FROM orders UNION ALL SELECT c_custkey, NULL, c_nationkey FROM customer")
def union_aligned(spark, d):
    return columns.union_aligned(orders(spark, d).select(F.col("o_custkey").alias("k"), "o_orderkey"), table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey"))


# Expansion


@query("SELECT l_orderkey, l_partkey, CAST(unnest(range(1, l_linenumber + 1)) AS BIGINT) AS copy FROM lineitem")
def expansion(spark, d):
    return expand.expansion(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "l_linenumber")


@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS d FROM orders WHERE o_orderkey % 4 > 0), m AS (SELECT greatest(CAST(ceil(sum(d) / 8.0) AS BIGINT), 1) AS m FROM o),
    x AS (SELECT o_orderkey, d, CAST(unnest(range(e - d, e)) AS BIGINT) AS place FROM (SELECT *, CAST(sum(d) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM o))
    SELECT o_orderkey, d, place // m AS block, place % m AS "offset" FROM x, m"""
)
def expansion_blocks(spark, d):
    return expand.expansion_blocks(orders(spark, d).select("o_orderkey", (F.col("o_orderkey") % 4).alias("d")), ["o_orderkey"], "d", 8)


# Padding


@query(
    """WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS part FROM orders), n AS (SELECT part, greatest(20000 - count(*), 0) AS lack FROM o GROUP BY part)
    SELECT o_orderkey, part, FALSE AS _is_dummy FROM o UNION ALL SELECT NULL, part, TRUE FROM (SELECT part, unnest(range(lack)) FROM n)"""
)
def pad_to_size(spark, d):
    return padding.pad_to_size(orders(spark, d).select("o_orderkey", (F.col("o_orderkey") % 4).alias("part")), "part", 20_000)


@query(
    """SELECT n, p, CAST(ceil((1 + (b + sqrt(b * b + 8 * b)) / 2) * n / p) AS BIGINT) AS bound
    FROM (SELECT n, p, (40 * ln(2) + 2 * ln(p)) * p / n AS b FROM (SELECT count(*) AS n FROM orders), (SELECT unnest([4, 16, 64]) AS p))"""
)
def padding_bounds(spark, d):
    n = table(spark, d, "orders").agg(F.count("*").alias("n"))
    return n.select("n", F.explode(F.array(F.lit(4), F.lit(16), F.lit(64))).alias("p")).withColumn("bound", bounds.size_bound_column(F.col("n"), F.col("p")))


@query(
    """SELECT total, p, sample, n, CAST(least(n, ceil(u * (1 + (c + sqrt(c * c + 8 * c)) / 2) * n / p)) AS BIGINT) AS bound
    FROM (SELECT *, (40 * ln(2) + 1 + 2 * ln(p)) * u * p / n AS c FROM (SELECT *, 1 + (b + sqrt(b * b + 4 * b)) / 2 AS u FROM (
        SELECT *, 2 * (40 * ln(2) + 1 + ln(total)) * p / sample AS b FROM (SELECT count(*) AS total, CAST(count(*) // 3 AS BIGINT) AS sample, CAST(count(*) // 2 AS BIGINT) AS n FROM orders), (SELECT unnest([4, 16, 64]) AS p))))"""
)
def sort_bounds(spark, d):
    n = F.count("*")
    of = table(spark, d, "orders").agg(n.alias("total"), F.floor(n / 3).cast("long").alias("sample"), F.floor(n / 2).cast("long").alias("n"))
    of = of.select("total", F.explode(F.array(F.lit(4), F.lit(16), F.lit(64))).alias("p"), "sample", "n")
    return of.withColumn("bound", bounds.sort_size_bound_column(*map(F.col, ("total", "p", "sample", "n"))))


@query(
    """WITH d AS (SELECT count(*) AS n1, (SELECT count(*) FROM customer) AS n2, (SELECT max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey)) AS degree1, CAST(1 AS BIGINT) AS degree2 FROM orders),
    b AS (SELECT *, (n1 + n2) // (degree1 + degree2) AS fewest, (n1 + n2) // CAST(ceil((degree1 + degree2) / 2.0) AS BIGINT) AS bins FROM d, (SELECT unnest([2, 4, 8]) AS p)),
    x AS (SELECT *, (40 * ln(2) + 2 * ln(p)) * p * p / fewest AS b FROM b)
    SELECT n1, n2, degree1, degree2, p, CAST(least(n1 + n2, ceil((1 + (b + sqrt(b * b + 8 * b)) / 2) * bins * (degree1 + degree2) / p / p)) AS BIGINT) AS bound FROM x"""
)
def bin_bounds(spark, d):
    n1 = joins.degrees(orders(spark, d), ["o_custkey"], "c").agg(F.sum("c").alias("n1"), F.max("c").alias("degree1"))
    n2 = table(spark, d, "customer").agg(F.count("*").alias("n2"), F.lit(1).cast("long").alias("degree2"))
    of = n1.crossJoin(n2).select("n1", "n2", "degree1", "degree2", F.explode(F.array(F.lit(2), F.lit(4), F.lit(8))).alias("p"))  # one row each
    return of.withColumn("bound", bounds.bin_size_bound_column(*map(F.col, ("n1", "n2", "degree1", "degree2", "p")), F.col("n1") + F.col("n2")))


@query("SELECT count(*) AS n FROM orders")
def real_rows(spark, d):
    """Rows that are no dummies, after padding."""
    o = orders(spark, d).select("o_orderkey", (F.col("o_orderkey") % 4).alias("part"))
    return padding.real_rows(padding.pad_to_size(o, "part", 20_000))


@query(
    """WITH RECURSIVE d AS (SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY c_nationkey) AS r FROM customer GROUP BY c_nationkey),
    b AS (SELECT c_nationkey, n, r, CAST(0 AS BIGINT) AS bin, n AS held FROM d WHERE r = 1
    UNION ALL SELECT d.c_nationkey, d.n, d.r, CAST(CASE WHEN held + d.n > 150 THEN bin + 1 ELSE bin END AS BIGINT), CASE WHEN held + d.n > 150 THEN d.n ELSE held + d.n END FROM b JOIN d ON d.r = b.r + 1)
    SELECT c_nationkey, n, bin FROM b"""
)
def greedy_bins(spark, d):
    degrees = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return packing.greedy_bins(degrees, ["c_nationkey"], "n", 150)
