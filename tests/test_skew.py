from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.operators import joins, origin, skew

ROWS = 6000


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the rows have one key, a sixth a null sample; the other side has two rows for some keys and none for others."""
    left = spark.range(ROWS).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 6 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("id") % 97)).alias("sample"), F.when(F.col("id") % 3 == 0, F.lit("G")).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 11)).alias("gene"))
    keys = [("hot", "G"), (None, None), (None, "g1"), *((f"s{i}", f"g{i % 11}") for i in range(60)), ("s4", None), ("absent", "G")]
    right = spark.createDataFrame([(s, g, float(k)) for k, (s, g) in enumerate(keys)] + [("hot", "G", -1.0), ("s3", "g3", -2.0)], "who string, what string, value double")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_joins_equal_plain_ones(sides, how):
    left, right = sides
    on = [("sample", "who"), ("gene", "what")]
    rows = lambda df: Counter(map(tuple, df.select("n", "sample", "gene", "who", "what", "value").collect()))
    plain = rows(left.join(right, [F.col(a).eqNullSafe(F.col(b)) for a, b in on], how))
    assert plain and rows(skew.split_join(left, right, on, how, measure=True)) == plain == rows(skew.split_join(left, right, on, how))
    assert skew.split_join(left.limit(0), right, on, how, measure=True).count() == 0


def test_hot_keys_are_those_with_a_share(sides):
    assert {tuple(r) for r in skew.hot_keys(sides[0], [F.col("sample")], 10).collect()} == {("hot",), (None,)}


def test_a_hot_key_is_spread_over_tasks(spark, sides):
    """With one key of a third of the rows, no task gets more than twice the median; a plain join gives one of them a third."""
    left, right = sides
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hot = left.where("sample = 'hot'")
        sizes = lambda df: sorted(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())
        split = sizes(skew.split_join(hot, right.where("value >= 0"), [("sample", "who"), ("gene", "what")], measure=True))
        plain = sizes(skew.split_join(hot, right.where("value >= 0"), [("sample", "who"), ("gene", "what")], measure=False))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(plain) == 1 and len(split) == 8 and split[-1] <= 2 * split[len(split) // 2] and sum(split) == plain[0]


def test_abundance_join_splits_hot_and_null_keys(sides):
    left, right = sides
    variants, proteins = left.withColumn("value", F.lit(1)), right.withColumn("n", F.lit("x"))
    rows = [Counter(map(tuple, joins.join_proteomics(variants, proteins, "gene", "what", "who", split_hot=s).select("n_x", "sample", "gene", "value_x", "value_y", "n_y").collect())) for s in (True, False, None)]
    assert rows[0] == rows[1] == rows[2] and sum(rows[0].values()) > ROWS / 3


def test_group_means_without_a_window(spark, sides):
    left = sides[0].withColumn("x", F.col("n").cast("double"))
    want = {k: v for k, v in ((r[0], r[1]) for r in left.groupBy("sample").agg(F.avg("x")).collect())}
    for measure in (True, False):
        got = skew.with_group_means(left, "sample", ["x"], measure=measure)
        assert got.columns == [*left.columns, "x_mean"] and got.count() == ROWS
        assert all(r.x_mean == pytest.approx(want[r.sample]) for r in got.collect())
    assert "Window" not in origin.group_means(left, "sample", ["x"])._jdf.queryExecution().toString()
