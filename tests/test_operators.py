import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyjoin.functions import bounds
from tallyjoin.metrics import Phases, exchanges, plan_of
from tallyjoin.operators import aggregates, columns, expand, joins, padding, partitioning, scan
from tallyjoin.sources import tables


def frame(spark, rows, names="a b c d"):
    return spark.createDataFrame(rows, " , ".join(f"{n} int" for n in names.split()))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    return [(rnd.randrange(12), rnd.randrange(30), rnd.randrange(-50, 50), rnd.randrange(5)) for _ in range(300)]


def multiset(df):
    return Counter(map(tuple, df.collect()))


# Sources


def test_text_tables(spark, tmp_path):
    for i, text in enumerate(["src  dst\n 1 2 \n\n3\t4", "src dst\n-5   6"]):
        (tmp_path / f"t_p{i}").write_text(text)
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())])
    got = tables.scan_text(spark, str(tmp_path / "t"), schema, parts=2)
    assert multiset(got) == Counter([(1, 2), (3, 4), (-5, 6)])
    (tmp_path / "bad").write_text("src dst\n1 2 3\n4\n")
    assert multiset(tables.scan_text(spark, str(tmp_path / "bad"), schema)) == Counter([(1, 2), (4, None)])
    with pytest.raises(Exception, match="arity"):
        tables.scan_text(spark, str(tmp_path / "bad"), schema, strict=True).collect()


def test_partition_files(spark, tmp_path):
    for i in range(3):
        tables.write_table(spark.range(i * 10, i * 10 + 2), f"{tmp_path}/t_p{i}")
    assert sorted(r.id for r in tables.scan_table(spark, f"{tmp_path}/t", 3).collect()) == [0, 1, 10, 11, 20, 21]
    assert multiset(tables.generate_data(spark, 2, 3)) == Counter([(0, 1), (1, 2), (2, 3)])


# Columns


def test_columns(spark, rows):
    df = frame(spark, rows)
    assert columns.project(df, ["d", "a", "d"]).columns == ["d", "a", "d_2"]
    assert columns.join_cols_first(df, ["b", "d"]).columns == ["b", "d", "a", "c"]
    assert columns.join_cols_first(df, ["a"]) is df
    assert columns.insert_col(df, "v", 7, 1).columns == ["a", "v", "b", "c", "d"] and columns.append_col(df, "v", 7).first().v == 7
    assert columns.copy_col(df, "c", "again").filter("c != again").isEmpty()
    assert columns.delete_col(df).columns == ["a", "b", "c"] and columns.delete_col(df, "a").columns == ["b", "c", "d"]
    with pytest.raises(ValueError):
        columns.union_all(df, df.drop("a"))
    aligned = columns.union_aligned(df.select("a", "b"), df.select("a", "c"))
    assert aligned.columns == ["a", "b", "c"] and aligned.count() == 2 * len(rows)
    assert columns.print_limit(df, 3, "a", "b", "c", "d").count() == 3


# Aggregates


def test_groups(spark, rows):
    df = frame(spark, [*rows, (None, 1, None, 2), (None, 2, 4, 2)])
    by = defaultdict(list)
    for r in [*rows, (None, 1, None, 2), (None, 2, 4, 2)]:
        if r[2] is not None:
            by[r[0]].append(r[2])
    assert {r.a: r.s for r in aggregates.group(df, ["a"], "sum", "c", "s").collect()} == {k: sum(v) for k, v in by.items()}
    assert {r.a: r.s for r in aggregates.group(df, ["a"], "max", "c", "s").collect()} == {k: max(v) for k, v in by.items()}
    assert aggregates.max_col(df.filter("c < 0"), "c").first().largest == max(r[2] for r in rows if r[2] < 0)
    assert aggregates.sum_col(frame(spark, [(2**31 - 1,)] * 3, "a"), "a").first().total == 3 * (2**31 - 1)
    assert not aggregates.is_key_unique(df, ["a"]).first()[0] and aggregates.is_key_unique(df.limit(0), ["a"]).first()[0]
    last = aggregates.dedup_last_of_run(df.filter("a IS NOT NULL"), ["a"], ["b", "c", "d"])
    assert multiset(last) == Counter(max(r for r in rows if r[0] == k) for k in {r[0] for r in rows}) and last.columns == df.columns
    counts = aggregates.group_count_broadcast(df, ["a"], "n")
    assert multiset(counts) == multiset(aggregates.group_count_window(df, ["a"], "n"))


def test_partial_aggregation_before_the_shuffle(spark, rows):
    assert "partial_sum" in plan_of(aggregates.group(frame(spark, rows), ["a"], "sum", "c", "s"))


# Prefixes


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_global_prefix_is_the_same_for_any_partitions(spark, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        unique = [(i, r[2]) for i, r in enumerate(rows)]
        got = scan.prefix_sum_global(frame(spark, unique, "k v").repartition(5), ["k"], "v", "run")
        assert parts == 1 or "SinglePartition" not in plan_of(got).split("BroadcastExchange")[0]
        total, want = 0, {}
        for k, v in unique:
            total += v
            want[k] = total
        assert {r.k: r.run for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_prefix_by_key_and_fills(spark):
    df = frame(spark, [(1, 1, 5, 0), (1, 2, None, 0), (1, 3, 2, 0), (2, 1, None, 0), (2, 2, 7, 0)])
    read = lambda out: [r.x for r in out.orderBy("a", "b").collect()]
    assert read(scan.by_key(df, ["a"], ["b"], "sum", "c", "x")) == [5, 5, 7, None, 7]
    assert read(scan.by_key(df, ["a"], ["b"], "max", "c", "x", reverse=True)) == [5, 2, 2, 7, 7]
    assert read(scan.fill(df, ["a"], ["b"], "c", "x")) == [5, 5, 2, None, 7]
    assert read(scan.fill(df, ["a"], ["b"], "c", "x", backward=True)) == [5, 2, 2, 7, 7]
    big = frame(spark, [(1, i, 2**31 - 1, 0) for i in range(3)])
    assert read(scan.by_key(big, ["a"], ["b"], "sum", "c", "x"))[-1] == 3 * (2**31 - 1)


def test_splits_of_keys_over_many_parts(spark):
    rnd = random.Random(5)
    rows = [(None if i % 40 == 3 else rnd.choice([1, 1, 1, 2]), i, rnd.choice([None, None, None, 4, 5]), 0) for i in range(300)]
    df = frame(spark, rows).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        for backward in (False, True):
            assert multiset(scan.fill_split(df, ["a"], ["b"], "c", "x", backward)) == multiset(scan.fill(df, ["a"], ["b"], "c", "x", backward))
        assert multiset(scan.row_number_by_key_split(df, ["a"], ["b"], "x")) == multiset(scan.row_number_by_key(df, ["a"], ["b"], "x"))
        assert [r.x for r in scan.numbered(df, ["b"], "x").orderBy("b").collect()] == list(range(1, 301))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_helpers_never_meet_columns_of_their_names(spark):
    """Columns named like helpers come back as they were, and nothing stays cached."""
    names = ["_part", "_local", "_one", "_n", "_end", "_place", "_total", "_carry", "_at", "_key0", "_chunk", "_last", "_size", "_before", "_every"]
    df = spark.range(20).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"), *(F.lit(i).alias(n) for i, n in enumerate(names)))
    whole = [F.col(n) == i for i, n in enumerate(names)]
    for out, n in (
        (scan.prefix_sum_global(df, ["k"], "c", "x"), 20),
        (scan.by_key_split(df, ["c"], ["k"], "sum", "k", "x"), 20),
        (scan.fill_split(df, ["c"], ["k"], "k", "x"), 20),
        (partitioning.assign_round_robin(df, ["k"], 3), 20),
        (partitioning.quantile_buckets(df, ["k"], 3), 20),
        (partitioning.rank_in_order(df, ["k"]), 20),
        (expand.expansion(df, "c", keep_count=True), 19),
        (expand.expansion_blocks(df, ["k"], "c", 4), 19),
        (aggregates.group_count_broadcast(df, ["c"], "x"), 20),
        (aggregates.dedup_last_of_run(df, ["c"], ["k"]), 3),
        (padding.remove_dummy(padding.pad_to_size(df, "c", 10)), 20),
    ):
        assert set(df.columns) <= set(out.columns) and out.filter(sum((w.cast("int") for w in whole), F.lit(0)) == len(names)).count() == n
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_names_with_dots_and_backticks(spark):
    df = spark.range(6).select(F.col("id").alias("a.b"), (F.col("id") % 2).alias("c`d"))
    assert [r[2] for r in scan.prefix_sum_global(df, ["a.b"], "c`d", "x").collect()] == [0, 1, 1, 2, 2, 3]
    assert expand.expansion(df, "c`d").columns == ["a.b", "copy"] and aggregates.group_count_broadcast(df, ["c`d"], "x").count() == 6


@pytest.mark.parametrize("how", ["sum", "min", "max", "count", "product"])
@pytest.mark.parametrize("reverse", [False, True])
def test_a_key_over_many_parts_has_the_prefix_of_a_window(spark, how, reverse):
    rnd = random.Random(3)
    rows = [(None if i % 50 == 7 else rnd.choice([1, 1, 1, 1, 2, 3]), i, rnd.choice([None, -1, 1, 2]), 0) for i in range(400)]
    df = frame(spark, rows).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        split = scan.by_key_split(df, ["a"], ["b"], how, "c", "x", reverse)
        assert multiset(split) == multiset(scan.by_key(df, ["a"], ["b"], how, "c", "x", reverse))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


# Expansion


def test_expansion(spark, rows):
    df = frame(spark, [*rows, (0, 0, 0, None), (0, 0, 0, -3)])
    assert expand.expansion(df, "d").count() == sum(r[3] for r in rows) == expand.expansion_size(df, "d").first()[0]
    unique = frame(spark, [(i, r[3]) for i, r in enumerate(rows)], "k d")
    got = expand.expansion_blocks(unique, ["k"], "d", 7).collect()
    size = -(-sum(r[3] for r in rows) // 7)
    places = sorted((r.block * size + r.offset, r.k) for r in got)
    assert [p for p, _ in places] == list(range(len(got))) and [k for _, k in places] == sorted(k for _, k in places)


# Joins


def test_joins_against_each_other(spark, rows):
    r, s = frame(spark, rows), frame(spark, [(x[0], x[1], x[2], 1) for x in rows[:120]], "a b e f")
    joined = joins.inner_join(r, s, ["a", "b"])
    assert joined.columns == ["a", "b", "c", "d", "e", "f"]
    want = Counter((x[0], x[1], x[2], x[3], y[2], 1) for x in rows for y in rows[:120] if x[:2] == y[:2])
    assert multiset(joined) == want
    assert joins.join_size(r, s, ["a", "b"]).first()[0] == sum(want.values())
    degree = joins.join_degrees(r, s, ["a", "b"])
    assert degree.agg(F.sum("deg_s")).first()[0] == sum(want.values())
    top = joins.join_max_degree(r, s, ["a", "b"]).first()
    assert top.a1 == max(Counter(y[:2] for y in rows[:120]).values()) and top.a2 == max(Counter(x[:2] for x in rows).values())
    unique = s.dropDuplicates(["a", "b"])
    pk = multiset(joins.pk_join(r, unique, ["a", "b"], validate=True))
    assert not pk - want and sum(pk.values()) == sum((x[:2] in {y[:2] for y in rows[:120]}) for x in rows)
    with pytest.raises(ValueError, match="repeat"):
        joins.pk_join(r, s, ["a", "b"], validate=True)
    assert joins.join_size(r, s.limit(0), ["a"]).first()[0] == 0 and joins.inner_join(r.limit(0), s.drop("b"), ["a"]).isEmpty()


def test_null_keys_match_nothing(spark):
    a = frame(spark, [(None, 1), (1, 2)], "k x")
    assert multiset(joins.inner_join(a, a.withColumnRenamed("x", "y"), ["k"])) == Counter([(1, 2, 2)])


def test_two_hops(spark, rows):
    edges = [(x[0], x[1] % 12) for x in rows]
    want = Counter((a, d) for a, b in edges for c, d in edges if b == c)
    assert {(r.src, r.dst): r.paths for r in joins.two_hop(frame(spark, edges, "src dst"), "src", "dst").collect()} == want


def test_a_small_key_side_is_broadcast_and_a_large_one_is_not(spark, rows):
    r, s = frame(spark, rows), frame(spark, rows).dropDuplicates(["a"]).select("a", F.col("c").alias("e"))
    assert "BroadcastHashJoin" in plan_of(joins.pk_join(r, F.broadcast(s), ["a"]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "SortMergeJoin" in plan_of(joins.pk_join(r, s, ["a"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# Placement


def parts_of(df):
    return df.withColumn("_p", F.spark_partition_id()).collect()


def test_placement(spark, rows):
    df = frame(spark, rows)
    by_key = defaultdict(set)
    for r in parts_of(partitioning.shuffle_by_key(df, 5, "a")):
        by_key[r.a].add(r._p)
    assert all(len(p) == 1 for p in by_key.values())
    assert all(r.d == r._p for r in parts_of(partitioning.shuffle_by_col(df, 5, "d")))
    ranges = defaultdict(list)
    for r in parts_of(partitioning.range_partition(df, 4, "b")):
        ranges[r._p].append(r.b)
    spans = [(min(v), max(v)) for _, v in sorted(ranges.items())]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert multiset(partitioning.shuffle_random(df, 3)) == Counter(rows)
    assert [tuple(r) for r in partitioning.sort_multi(df, "a", "b", "c", "d").collect()] == sorted(rows)
    assert {(r.b, r.part) for r in partitioning.by_pivots(df, "b", [10, 20]).collect()} == {(x[1], (x[1] >= 10) + (x[1] >= 20)) for x in rows}


@pytest.mark.parametrize("n", [0, 1, 5, 23])
def test_quantiles_and_round_robin(spark, n):
    df = frame(spark, [(i * 3,) for i in range(n)], "k")
    small, more = divmod(n, 4)
    want = [b + 1 for b in range(4) for _ in range(small + (b < more))]
    assert [r.bucket for r in partitioning.quantile_buckets(df, ["k"], 4).orderBy("k").collect()] == want
    assert [r.part for r in partitioning.assign_round_robin(df, ["k"], 4).orderBy("k").collect()] == [i % 4 for i in range(n)]


def test_bernoulli_sample(spark):
    df = spark.range(20_000)
    a, b = ({r.id for r in columns.sample(df, 0.3, seed).collect()} for seed in (1, 1))
    assert a == b and abs(len(a) - 6000) < 500 and a != {r.id for r in columns.sample(df, 0.3, 2).collect()}


# Joins in blocks


@pytest.mark.parametrize("make", [joins.join_blocks, joins.positional_join])
@pytest.mark.parametrize("blocks", [1, 7])
def test_joins_in_key_ordered_blocks(spark, make, blocks):
    rnd = random.Random(2)
    r = [(rnd.choice([1, 1, 1, 2, 3, 4, None]), i, 10 + i) for i in range(40)]
    s = [(rnd.choice([1, 2, 2, 3, 5, None]), i, 100 + i) for i in range(30)]
    want = sorted((k, a, b, x, y) for k, a, x in r for j, b, y in s if k == j and k is not None)
    size = max(1, -(-len(want) // blocks))
    got = make(frame(spark, r, "k a x").repartition(3), frame(spark, s, "k b y"), ["k"], ["a"], ["b"], blocks)
    assert got.columns == ["k", "a", "x", "b", "y", "m", "block", "offset"]
    rows = sorted(got.collect(), key=lambda t: (t.block, t.offset))
    assert [(t.k, t.a, t.b, t.x, t.y) for t in rows] == want and {t.m for t in rows} == {len(want)}
    assert [(t.block, t.offset) for t in rows] == [divmod(i, size) for i in range(len(want))]


@pytest.mark.parametrize("make", [joins.join_blocks, joins.positional_join])
def test_joins_in_blocks_of_nothing(spark, make):
    assert make(frame(spark, [(1, 1)], "k a"), frame(spark, [(2, 1)], "k b"), ["k"], ["a"], ["b"], 4).collect() == []


def shuffled_rows(df):
    """Rows that the shuffles of df's last plan wrote, the most of one shuffle, after running it."""
    df.collect()
    most, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            nodes.append(node.plan())
        if node.metrics().contains("shuffleRecordsWritten"):
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return most


@pytest.mark.parametrize("make", [joins.join_blocks, joins.positional_join])
def test_joins_in_blocks_of_large_keys_in_tiles(spark, make, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 4)
    r = [(i % 3, i) for i in range(40)] + [(7, 40), (8, 41), (None, 42)]
    s = [(i % 2, i) for i in range(21)] + [(7, 21), (None, 22)]
    want = sorted((k, a, b) for k, a in r for j, b in s if k == j and k is not None)
    size = -(-len(want) // 5)
    got = make(frame(spark, r, "k a"), frame(spark, s, "k b"), ["k"], ["a"], ["b"], 5).collect()
    assert sorted((t.block, t.offset, t.k, t.a, t.b) for t in got) == [(*divmod(i, size), *w) for i, w in enumerate(want)]


def test_positional_join_shuffles_no_copies(spark):
    r, s = (frame(spark, [(1, i) for i in range(300)], f"k {c}").repartition(3) for c in "ab")
    got = joins.positional_join(r, s, ["k"], ["a"], ["b"], 8)
    assert got.count() == 90_000 and shuffled_rows(got) <= 1_000


def test_join_blocks_deals_a_large_key_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 32, raising=False)
    monkeypatch.setattr(joins, "TASK_ROWS", 1 << 13, raising=False)
    r, s = (frame(spark, [(1, i) for i in range(300)], f"k {c}") for c in "ab")
    got = joins.join_blocks(r, s, ["k"], ["a"], ["b"], 8)
    at = Counter(t._p for t in parts_of(got))
    assert sum(at.values()) == 90_000 and max(at.values()) <= 45_000 and shuffled_rows(got) <= 10_000


@pytest.mark.parametrize("distinct", [False, True])
def test_two_hop_in_many_ranges_and_lists(spark, monkeypatch, distinct):
    monkeypatch.setattr(joins, "TASK_PATHS", 16, raising=False)
    monkeypatch.setattr(joins, "ENDS", 4, raising=False)
    rnd = random.Random(3)
    e = [(rnd.choice([0, 1, 2, 3, 4, None]), rnd.choice([0, 1, 2, 7, None])) for _ in range(60)] + [(1, i) for i in range(30)] + [(i, 1) for i in range(30, 50)]
    e = list(set(e)) if distinct else e
    want = Counter((a, d) for a, b in e for c, d in e if b == c and b is not None)
    got = joins.two_hop(frame(spark, e * 2 if distinct else e, "src dst"), "src", "dst", distinct=distinct).collect()
    assert {(t.src, t.dst): t.paths for t in got} == want and len(got) == len(want)


def test_two_hop_shuffles_no_paths(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for second edges that are not small
    try:
        got = joins.two_hop(frame(spark, [(i, 1000) for i in range(200)] + [(1000, 2000 + i) for i in range(200)], "src dst"), "src", "dst")
        assert got.count() == 40_000 and shuffled_rows(got) <= 1_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("spread", [False, True])
def test_long_expansions_are_made_in_chunks(spark, spread):
    df = frame(spark, [(1, 200_000), (2, 0), (3, None), (4, 65_536), (5, 1), (6, -3)], "k n")
    got = expand.expansion(df, "n", spread=spread).groupBy("k").agg(F.count("*"), F.min("copy"), F.max("copy"), F.count_distinct("copy")).collect()
    assert sorted(map(tuple, got)) == [(k, n, 1, n, n) for k, n in ((1, 200_000), (4, 65_536), (5, 1))]


# Padding


def test_padding(spark, rows):
    df = frame(spark, rows)
    padded = padding.pad_to_size(df, "d", 100)
    assert all(r["count"] == 100 for r in padded.groupBy("d").count().collect())
    assert multiset(padding.remove_dummy(padded)) == Counter(rows)
    assert multiset(padding.remove_dummy(padding.pad_to_size(df, "d", 1))) == Counter(rows)


def test_bounds():
    vectors = {(9, 4): 37, (30, 4): 50, (10**4, 4): 2907, (10**6, 4): 253921, (10**5, 16): 6912, (10**6, 16): 64557}
    assert all(abs(bounds.size_bound(*k) - v) <= 1 for k, v in vectors.items())
    sorts = {(37, 4, 9, 9): 9, (4 * 10**4, 4, 10**4, 10**4): 3526, (4 * 10**6, 4, 10**6, 10**6): 258829, (1_600_000, 16, 10**5, 10**5): 7830}
    assert all(abs(bounds.sort_size_bound(*k) - v) <= 1 for k, v in sorts.items())
    assert bounds.bin_size_bound(10**5, 10**5, 3, 5, 4, 10**9) > 2 * 10**5 / 16 and bounds.bin_size_bound(10**5, 10**5, 3, 5, 4, 99) == 99


def test_bounds_of_nothing():
    assert bounds.size_bound(0, 4) == bounds.sort_size_bound(0, 4, 0, 0) == bounds.bin_size_bound(0, 0, 0, 0, 4, 9) == 0
    assert bounds.bin_size_bound(2, 3, 4, 5, 4, 99) == 5 and bounds.bin_size_bound(2, 3, 4, 5, 4, 3) == 3


# Streams and metrics


def test_streams(spark, tmp_path):
    from tallyjoin.streaming import incremental

    frame(spark, [(i % 3, i) for i in range(30)], "k v").write.parquet(f"{tmp_path}/in")
    s = frame(spark, [(0, 100), (1, 101)], "k w")
    stream = spark.readStream.schema("k int, v int").parquet(f"{tmp_path}/in")
    q = incremental.group_sum_stream(incremental.pk_join_stream(stream, s, ["k"]), ["k", "w"], "v", "total").writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    assert multiset(spark.table("sums")) == Counter([(0, 100, sum(range(0, 30, 3))), (1, 101, sum(range(1, 30, 3)))])


def test_metrics(spark, rows):
    phases = Phases()
    with phases.phase("x"):
        n = exchanges(frame(spark, rows).groupBy("a").count())
    assert n == 1 and phases.total == phases.seconds["x"] > 0
