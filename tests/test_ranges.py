"""Joins with tables of ranges, scenarios from tables, and values of varying type as rows."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import export, lookup, scenarios


def test_ten_thousand_ranges_of_all_widths(spark):
    random.seed(1)
    ranges = []
    for i in range(10_000):
        lo = random.randint(-(1 << 40), 1 << 40) if i % 3 else random.randint(-1000, 1000)
        ranges.append((i, lo, lo + random.choice([0, 1, 2, 3, 7, 100, 1 << 20, 1 << 39])))
    ranges += [(-1, 5, 4), (-2, None, 3), (-3, 1, None), (-4, -(1 << 62), 1 << 62)]
    points = [(i, random.choice([random.randint(-1000, 1000), random.randint(-(1 << 40), 1 << 40)])) for i in range(200)] + [(200, None), (201, 0), (201, 0)]
    p = spark.createDataFrame(points, "k int, _bin bigint")
    met = lookup.within_ranges(p, spark.createDataFrame(ranges, "_size int, lo bigint, hi bigint"), "_bin")
    assert met.columns == ["k", "_bin", "_size", "lo", "hi"]
    want = sorted((k, x, i) for k, x in points if x is not None for i, lo, hi in ranges if lo is not None and hi is not None and lo <= x <= hi)
    assert sorted((r.k, r._bin, r._size) for r in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_totals_of_ranges_of_all_widths(spark):
    random.seed(2)
    ends = [-(1 << 63), (1 << 63) - 1, -1, 0, 1]
    number = lambda: random.choice([random.randint(-40, 40), random.randint(-(1 << 40), 1 << 40), random.choice(ends)])
    ranges = [(number(), number(), random.randint(0, 9)) for _ in range(600)] + [(x, x, None) for x in ends]
    ranges += [(lo, min(lo + random.choice([0, 1, 2, 3, 5, 8, 13, 30]), ends[1]), 5) for lo in (number() for _ in range(600))] + [(None, 3, 1), (1, None, 1), (ends[0], ends[1], 7)]
    points = [number() for _ in range(200)] + list(range(-45, 45)) + ends + [None]
    p, r = spark.createDataFrame([(x,) for x in points], "k bigint"), spark.createDataFrame(ranges, "from bigint, to bigint, most int")
    met = [(x, [m for lo, hi, m in ranges if None not in (lo, hi) and lo <= x <= hi]) for x in set(points) - {None}]
    want = {x: (len(m), max((v for v in m if v is not None), default=None)) for x, m in met if m}
    assert {row.k: (row.n_ranges, row.most) for row in lookup.range_totals(p, r, "k", "most", "from", "to").collect()} == want
    assert lookup.range_totals(p, r.limit(0), "k", "most", "from", "to").count() == 0


def test_bands_are_counted_without_making_pairs(spark, tmp_path):
    from tessera import queries

    n = 100_000  # ten thousand million pairs
    spark.range(n).selectExpr("id AS o_orderkey", "1000.0D + id % 2 AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(n).selectExpr("id div 2 AS l_orderkey", "1 AS l_linenumber", "1005.5D AS l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    limit = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    limit.start()
    try:
        found = queries.q_range_join_table(spark, str(tmp_path)).groupBy("price", "n_bands", "widest").count().collect()
    finally:
        limit.cancel()
    assert list(map(tuple, found)) == [(1005, 2 * n, 10, n // 2)]


def test_no_ranges(spark):
    none = spark.createDataFrame([], "lo int, hi int")
    assert lookup.within_ranges(spark.createDataFrame([(1,)], "x int"), none, "x").count() == 0


def test_language_votes(spark):
    ranges = spark.createDataFrame([("b", 97, 122), ("a", 65, 122), ("a", 97, 122), ("c", 0x600, 0x6FF)], "language string, lo int, hi int")
    df = spark.createDataFrame([(1, ["one Two سلام", "--x"]), (2, ["12 !!"]), (3, None)], "k int, instances array<string>")
    assert sorted(map(tuple, lookup.language_votes(df, ranges, "k").collect())) == [(1, "a", 3, "a"), (1, "b", 2, "a"), (1, "c", 1, "a")]


def test_products_of_tables(spark):
    columns = {name: spark.createDataFrame([(v,) for v in values], "v string") for name, values in {"topic": ["b", "a", "b", None], "tense": ["y", "x"]}.items()}
    rows = sorted(map(tuple, scenarios.cross_product(columns).collect()))
    assert rows == [(0, "a", "x"), (1, "a", "y"), (2, "b", "x"), (3, "b", "y")]
    lists = {name: columns["topic"] if k % 2 else columns["tense"] for k, name in enumerate(scenarios.LISTS)}
    made = scenarios.product(spark, scenarios.config_of(lists, "Arabic", "English"))
    joined = scenarios.cross_product(lists)
    assert made.select(joined.columns).exceptAll(joined).count() == 0 and made.count() == joined.count() == 2**10
    assert scenarios.cross_product({"x": columns["topic"], "y": columns["tense"].limit(0)}).count() == 0


def test_too_many_values_for_a_list(spark, monkeypatch):
    monkeypatch.setattr(scenarios, "BROADCAST", 3)
    with pytest.raises(ValueError, match="more than 3"):
        scenarios.values_of({"a": spark.range(4)})
    assert scenarios.cross_product({"a": spark.range(4), "b": spark.range(5)}).count() == 20


def test_items_of_any_type(spark):
    df = spark.createDataFrame([(1, '["a", 2, null, {"x": 1}]'), (2, '{"b": "y", "a": [1]}'), (3, "bare text"), (4, "7"), (5, "[]"), (6, None), (7, '"quoted"')], "value int, key string")
    got = sorted((r.value, r.kind, r.place, r.name, r.text) for r in export.items(df.withColumnRenamed("value", "id"), "id", "key").withColumnsRenamed({"value": "text", "id": "value"}).collect())
    assert [g[:1] + g[1:] for g in got if g[0] not in (1, 5)] == [(2, "object", 0, "a", "[1]"), (2, "object", 1, "b", "y"), (3, "text", None, None, "bare text"), (4, "number", None, None, "7"), (7, "text", None, None, '"quoted"')]
    assert [g[2:] for g in sorted(got, key=str) if g[0] == 1] == [(0, None, "a"), (1, None, "2"), (2, None, None), (3, None, '{"x":1}')]
    assert [g for g in got if g[0] == 5] == [(5, "list", None, None, None)]
