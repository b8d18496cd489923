import pytest
from pyspark.sql import functions as F

from quantgrove.operators import quantizer as Q


def frame(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, x double")


def test_edges_by_interpolation(spark):
    rule = Q.fit(frame(spark, range(1, 9)), ["x"], bits=2, z=None).rules[0]
    assert rule.kind == Q.CONTINUOUS and rule.edges == (2.75, 4.5, 6.25)


def test_coinciding_edges_fall_back_to_equal_width():
    assert Q.settle_edges([5.0, 5.0, 5.0], 1.0, 9.0, 4) == (3.0, 5.0, 7.0)
    assert Q.settle_edges([5.0, 5.0, 5.0], 5.0, 5.0, 4) == (5.0, 5.0, 5.0)


def test_kinds_of_discrete_feature(spark):
    assert Q.fit(frame(spark, [0, 1, 2, 3, 3]), ["x"], 2).rules[0].kind == Q.FULL
    # Truncated values count, so these pass for the full range too.
    assert Q.fit(frame(spark, [0.2, 1.7, 2.1, 3.9]), ["x"], 2).rules[0].kind == Q.FULL
    rule = Q.fit(frame(spark, [1, 5, 9]), ["x"], 2).rules[0]
    assert rule.kind == Q.DICTIONARY and rule.values == (1.0, 5.0, 9.0)
    df = frame(spark, [1, 3, 3.5, 7, 8, 100])
    got = [r["b"] for r in df.orderBy("id").select(Q.bin_of(rule, 4, None, F.col("x")).alias("b")).collect()]
    assert got == [0, 0, 1, 1, 2, 2]  # ties go to the lower entry


def test_256_values_at_8_bits_do_not_wrap(spark):
    rule = Q.fit(frame(spark, [v * 3 for v in range(256)]), ["x"], 8).rules[0]
    assert rule.kind == Q.DICTIONARY and len(rule.values) == 256


def test_constant_and_null_feature(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, x double")
    rule = Q.fit(df, ["x"], 2).rules[0]
    assert rule.values == (0.0,)
    assert Q.fit(df.limit(0), ["x"], 2).rules[0].values == ()


def test_fixed_point_saturates_above_65535(spark):
    rule = Q.fit(frame(spark, [v * 1000 for v in range(500)]), ["x"], 2, z=None).rules[0]
    df = frame(spark, [0, 66_000, 400_000])
    assert [r["b"] for r in df.orderBy("id").select(Q.fixed_point(rule, F.col("x")).alias("b")).collect()] == [0, 3, 3]


def test_remaps():
    rule = Q.Rule("x", Q.CONTINUOUS, 0.0, 8.0, 0.0, 1.0, edges=(2.0, 4.0, 6.0))
    wide, to = Q.expand(rule, 0.0, 16.0, 4)
    assert wide.edges == (4.0, 8.0, 12.0) and to == [0, 0, 1, 1]
    assert Q.expand(rule, 2.0, 6.0, 4)[1] == [0, 1, 2, 3]
    flat = Q.Rule("x", Q.CONTINUOUS, 0.0, 8.0, 0.0, 1.0, edges=(4.0, 4.0, 4.0))
    assert Q.expand(flat, 0.0, 16.0, 4)[1][1] == 0
    smaller, to = Q.shrink(rule, [0, 5, 5, 0], 4)
    assert (smaller.low, smaller.high) == (2.0, 6.0) and to == [0, 0, 1, 2]
    assert Q.shrink(rule, [1, 0, 0, 1], 4)[1] == [0, 1, 2, 3]


def test_signal_counts_bins_outside(spark):
    rule = Q.Rule("x", Q.CONTINUOUS, 0.0, 8.0, 4.0, 1e9, edges=(2.0, 4.0, 6.0))
    df = frame(spark, [-3, 1, 7, 9, 12.5])
    assert [r["s"] for r in df.orderBy("id").select(Q.signal_of(rule, 4, None, F.col("x")).alias("s")).collect()] == [-2, 0, 3, 4, 6]


def test_scan_reads_only_what_it_needs(spark, sf):
    plan = spark.read.parquet(f"{sf}/lineitem.parquet").agg(Q.quantile_edges(F.col("l_tax"), 4))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_tax:double>" in plan


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_bits_round_trip(spark, bits):
    from quantgrove.functions.arithmetic import pack_bits, unpack_bits

    df = spark.range(50).select(*[(F.col("id") * (i + 3) % (1 << bits)).alias(f"b{i}") for i in range(6)])
    cols = [F.col(f"b{i}") for i in range(6)]
    bad = df.select(*cols, pack_bits(cols, bits).alias("w")).select(*[(a == b).alias(f"e{i}") for i, (a, b) in enumerate(zip(cols, unpack_bits(F.col("w"), bits, 6)))])
    assert bad.where(" or ".join(f"not e{i}" for i in range(6))).count() == 0
